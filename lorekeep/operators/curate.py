"""Raw -> checked -> curated and semantic tables.

Each ``check_*`` returns every raw row with a ``reason`` (null = valid).  Parents are *valid* rows
only: knowledge under a rejected topic is itself rejected, and so are that knowledge's reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.governance import ai_eligible
from lorekeep.functions.iso import integer, iso_date
from lorekeep.operators import quality as Q
from lorekeep.operators.joins import key_counts, numbered, sized_join


def _judged(df: DataFrame, rules: list[Q.Rule]) -> DataFrame:
    """Duplicates are set aside before any rule is tried."""
    reason = F.coalesce(F.col("duplicate_reason"), Q.first_reason(rules))
    return df.withColumn("reason", reason).drop("duplicate_reason")


def check_topics(raw: DataFrame) -> DataFrame:
    return _judged(Q.annotate_duplicates(raw, "topic_id"), Q.topic_rules())


def check_sources(raw: DataFrame) -> DataFrame:
    return _judged(Q.annotate_duplicates(raw, "source_id"), Q.source_rules())


def check_knowledge(raw: DataFrame, valid_topics: DataFrame, valid_sources: DataFrame) -> DataFrame:
    """Both foreign keys, the rules and the enrichment in one pass over knowledge."""
    topics = valid_topics.select("topic_id", "topic_name")
    sources = valid_sources.select("source_id", "source_name", "source_status")
    joined = Q.annotate_duplicates(numbered(raw), "knowledge_id")
    joined = sized_join(joined, topics, "topic_id", "left", counts=key_counts(raw, "topic_id"))
    joined = sized_join(joined, sources, "source_id", "left", counts=key_counts(raw, "source_id"))
    eligible = ai_eligible(F.col("review_status"), F.col("source_status"), F.col("content_status"))
    return _judged(joined, Q.knowledge_rules()).select(
        *raw.columns, "topic_name", "source_name", eligible.alias("ai_eligible"), "reason"
    )


def check_reviews(raw: DataFrame, valid_knowledge: DataFrame) -> DataFrame:
    """Reviews may hang on ineligible knowledge, not on rejected knowledge."""
    known = valid_knowledge.select("knowledge_id", F.lit(True).alias("knowledge_found"))
    joined = Q.annotate_duplicates(numbered(raw), "review_id")
    joined = sized_join(joined, known, "knowledge_id", "left", counts=key_counts(raw, "knowledge_id"))
    return _judged(joined, Q.review_rules()).select(*raw.columns, "reason")


def valid(checked: DataFrame) -> DataFrame:
    return Q.split(checked)[0]


def _typed(knowledge: DataFrame) -> DataFrame:
    return knowledge.withColumns({
        "published_date": iso_date(F.col("published_date")),
        "last_reviewed_date": iso_date(F.col("last_reviewed_date")),
        "content_version": integer(F.col("content_version").cast("string")),
    })


def dim_topic(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*S.DIM_TOPIC.names)


def dim_source(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*S.DIM_SOURCE.names)


def dim_knowledge(checked: DataFrame) -> DataFrame:
    """The curated form: the flag, but no names copied from the parents."""
    return _typed(valid(checked)).select(*S.DIM_KNOWLEDGE.names)


def fact_review(checked: DataFrame) -> DataFrame:
    return valid(checked).withColumn("review_date", iso_date(F.col("review_date"))).select(*S.FACT_REVIEW.names)


def catalog(checked: DataFrame) -> DataFrame:
    return _typed(valid(checked)).select(*S.CATALOG.names)


def approved(catalog: DataFrame) -> DataFrame:
    """Approved review; stale content or an inactive source may still make it ineligible."""
    return catalog.where(F.col("review_status") == "APPROVED")


def agent_eligible(catalog: DataFrame) -> DataFrame:
    return catalog.where("ai_eligible").select(*S.AGENT_ELIGIBLE.names)


def topic_summary(catalog: DataFrame) -> DataFrame:
    """Counts per topic that has knowledge; partial counts combine before the shuffle, so a topic
    with a third of all rows costs one row per map task."""
    def holds(column: str, value: str):
        return F.count_if(F.col(column) == value)

    return catalog.groupBy("topic_id").agg(
        F.min("topic_name").alias("topic_name"),  # one name per topic_id, so any_value would do
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("ai_eligible").alias("eligible_count"),
        holds("review_status", "APPROVED").alias("approved_count"),
        holds("review_status", "NEEDS_REVIEW").alias("needs_review_count"),
        holds("review_status", "EXPIRED").alias("expired_count"),
        holds("content_status", "STALE").alias("stale_count"),
    )


def quarantine(checked: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``{raw table: (checked frame, its raw columns)}`` -> (table, reason, row as JSON)."""
    parts = [
        Q.split(frame)[1].select(
            F.lit(table).alias("table"),
            "reason",
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"),
        )
        for table, (frame, columns) in checked.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
