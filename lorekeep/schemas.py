"""Declared schemas and fixed value lists of the governed-knowledge tables.

Files never carry a schema of their own choosing: every reader passes one of these.  A column the
data model calls required is enforced by quarantine, not by ``nullable=False`` (Spark ignores that
flag on file reads).
"""

from pyspark.sql import types as T

_S, _D, _L, _B, _F, _TS = (
    T.StringType(), T.DateType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols])


# The closed enums and column lists of the data model.
REVIEW_STATUSES = ["APPROVED", "NEEDS_REVIEW", "EXPIRED"]
CONTENT_STATUSES = ["CURRENT", "STALE"]
SOURCE_STATUSES = ["ACTIVE", "INACTIVE"]
EVENT_TYPES = [
    "QUESTION_ASKED",
    "RESPONSE_GENERATED",
    "SOURCE_OPENED",
    "RELATED_TOPIC_OPENED",
    "FEEDBACK_SUBMITTED",
]
CLIENT_EVENT_TYPES = ["SOURCE_OPENED", "RELATED_TOPIC_OPENED", "FEEDBACK_SUBMITTED"]
RATINGS = ["up", "down"]

TOPIC_REQUIRED = ["topic_id", "topic_name", "parent_category"]
SOURCE_REQUIRED = ["source_id", "source_name", "source_type", "url", "source_status"]
KNOWLEDGE_REQUIRED = [
    "knowledge_id", "topic_id", "source_id", "title", "summary", "review_status",
    "content_status", "published_date", "last_reviewed_date", "content_version",
]
REVIEW_REQUIRED = ["review_id", "knowledge_id", "reviewer_role", "review_date", "review_status"]
EVENT_REQUIRED = ["event_id", "event_type", "session_id", "occurred_at"]

# Raw tables arrive as text; the curated tables carry the typed columns.
RAW_TOPICS = _struct(*[(c, _S) for c in TOPIC_REQUIRED + ["description"]])
RAW_SOURCES = _struct(*[(c, _S) for c in SOURCE_REQUIRED])
RAW_KNOWLEDGE = _struct(*[(c, _S) for c in KNOWLEDGE_REQUIRED])
RAW_REVIEWS = _struct(*[(c, _S) for c in REVIEW_REQUIRED + ["notes"]])

DIM_TOPIC = RAW_TOPICS
DIM_SOURCE = RAW_SOURCES
DIM_KNOWLEDGE = _struct(
    ("knowledge_id", _S), ("topic_id", _S), ("source_id", _S), ("title", _S), ("summary", _S),
    ("review_status", _S), ("content_status", _S), ("published_date", _D),
    ("last_reviewed_date", _D), ("content_version", _L), ("ai_eligible", _B),
)
FACT_REVIEW = _struct(
    ("review_id", _S), ("knowledge_id", _S), ("reviewer_role", _S), ("review_date", _D),
    ("review_status", _S), ("notes", _S),
)
CATALOG = _struct(
    ("knowledge_id", _S), ("topic_id", _S), ("topic_name", _S), ("source_id", _S),
    ("source_name", _S), ("title", _S), ("summary", _S), ("review_status", _S),
    ("content_status", _S), ("ai_eligible", _B), ("published_date", _D),
    ("last_reviewed_date", _D), ("content_version", _L),
)
AGENT_ELIGIBLE = _struct(("knowledge_id", _S), ("topic_id", _S), ("title", _S), ("summary", _S))
TOPIC_SUMMARY = _struct(
    ("topic_id", _S), ("topic_name", _S), ("total_count", _L), ("eligible_count", _L),
    ("approved_count", _L), ("needs_review_count", _L), ("expired_count", _L), ("stale_count", _L),
)
EMBEDDINGS = _struct(
    ("knowledge_id", _S), ("topic_id", _S), ("title", _S), ("summary", _S),
    ("embedding", T.ArrayType(_F, containsNull=False)), ("embedding_model", _S), ("embedded_at", _TS),
)
QUESTION_ANALYTICS = _struct(
    ("metric_name", _S), ("dimension", _S), ("metric_value", _F), ("computed_at", _TS),
)
FACT_EVENT = _struct(
    ("event_id", _S), ("event_type", _S), ("session_id", _S), ("trace_id", _S), ("topic_id", _S),
    ("knowledge_id", _S), ("rating", _S), ("latency_ms", _F), ("source_count", _L),
    ("occurred_at", _TS),
)
EVENT_COLUMNS = FACT_EVENT.names
# On the wire every field is read as text first, so a wrong type becomes a reason, not a crash.
EVENT_WIRE = _struct(*[(c, _S) for c in EVENT_COLUMNS])
QUARANTINED_EVENT = _struct(("reason", _S), ("raw_payload", _S), ("quarantined_at", _TS))

# Counts of some events per topic, which add up; the order of analytics.partial_metrics.
EVENT_METRICS = _struct(
    ("topic_id", _S), ("total_questions_asked", _L), ("total_responses_generated", _L), ("total_source_opens", _L),
    ("total_related_topic_opens", _L), ("feedback_up_count", _L), ("feedback_down_count", _L), ("latency", _F), ("responses", _L),
)
COVERED_BATCHES = _struct(("feed", _S), ("upto", _L))

BENCHMARK_CASE = _struct(
    ("id", _S), ("question", _S), ("style", _S), ("type", _S),
    ("expected_knowledge_ids", T.ArrayType(_S)), ("excluded_knowledge_id", _S),
    ("excluded_reason", _S),
)
FILE_NOTIFICATION = _struct(
    ("bucket", _S), ("name", _S), ("contentType", _S), ("size", _S), ("timeCreated", _S),
)
TOOL_CALL = _struct(
    ("tool", _S), ("args", T.MapType(_S, _S)), ("latency_ms", _F),
    ("result_summary", _struct(("candidate_count", _L),
                               ("candidate_knowledge_ids", T.ArrayType(_S)))),
)
