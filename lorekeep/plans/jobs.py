"""The jobs of one warehouse folder: load, refresh, index, stream, compact, analytics, search, evaluate, report.

Tables live under ``<warehouse>/raw``, ``/curated`` and ``/semantic``.  Each job reads tables of one
snapshot and writes tables; between jobs nothing is kept in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import schemas as S
from lorekeep.operators import analytics, embedding, evaluation, hybrid, inverted, reports, seed_gate, vector_index
from lorekeep.operators.embedding import HASHED_MODEL, Embedder, hashed_words
from lorekeep.plans.refresh import Refresh
from lorekeep.session import staged
from lorekeep.sources import files
from lorekeep.streaming import compaction, events

RAW = {"topics": S.RAW_TOPICS, "sources": S.RAW_SOURCES, "knowledge": S.RAW_KNOWLEDGE, "reviews": S.RAW_REVIEWS}


def load_raw(spark: SparkSession, feeds: str, warehouse: str, multi_line: bool = True, rules: str | None = None) -> list[str]:
    """Loads ``<feeds>/<name>.csv`` into the raw tables unless the gate finds an error; returns the
    gate's warnings.  All errors go to ``<warehouse>/rejected/<run id>``; ``rules`` is a rules file
    that must load.  The four tables are replaced together."""
    delivered = [
        staged(files.read_csv(spark, f"{feeds}/{name}.csv", schema, multi_line), f"feed_{name}")
        for name, schema in RAW.items()
    ]
    report = f"{warehouse}/rejected/{files.new_run_id()}/errors"
    seed_gate.abort_on_errors(seed_gate.all_errors(*delivered, rules), report)
    topics, sources, knowledge, reviews = delivered
    warnings = [r["warning"] for r in seed_gate.warnings(knowledge, sources).collect()]  # two rows at most
    knowledge = files.cast_on_load(knowledge, ["content_version"])
    files.publish({f"raw/{name}": df for name, df in zip(RAW, (topics, sources, knowledge, reviews))}, warehouse)
    return warnings


def _loaded(schema: T.StructType) -> T.StructType:
    """A raw table's schema as the load leaves it."""
    return T.StructType([T.StructField(f.name, T.LongType() if f.name == "content_version" else f.dataType) for f in schema])


def refresh(spark: SparkSession, warehouse: str, quarantine: str, run_id: str | None = None) -> str:
    now = files.snapshot(spark, warehouse)
    raw = [now.read(f"raw/{name}", _loaded(schema)) for name, schema in RAW.items()]
    return Refresh(*raw).run(warehouse, quarantine, run_id)


ELIGIBLE = "semantic/agent_eligible_knowledge"


def eligible(now: files.Snapshot) -> DataFrame:
    return now.read(ELIGIBLE, S.AGENT_ELIGIBLE)


def index(
    spark: SparkSession, warehouse: str, embedder: Embedder = hashed_words, model: str = HASHED_MODEL, full: bool = False,
) -> None:
    """Embeds what is eligible and new or changed, clusters the vectors and inverts the words, published together.
    ``full`` embeds everything again.  A model that is away fails the run, whether or not a text is new."""
    now = files.snapshot(spark, warehouse)
    current, stamp = eligible(now), F.lit(_now(spark)).cast("timestamp")
    if full or now.version("semantic/knowledge_embeddings") is None:
        built = embedding.build_index(current, stamp, embedder, model)
    else:
        embedding.check_model(spark, embedder)
        built = embedding.refresh_index(current, _embeddings(now), stamp, embedder, model)
    built = staged(built, "embedded")
    words = inverted.build(current)
    words = inverted.InvertedIndex(words.stats.withColumn("built_from", F.lit(now.version(ELIGIBLE))), words.terms, words.postings, words.documents)
    files.publish(
        # Sorted inside each file, so a search within one topic skips most row groups.
        {"semantic/knowledge_embeddings": built.sortWithinPartitions("topic_id"), **words.tables(), **vector_index.build(built).tables()}, warehouse,
        {f"semantic/{name}": columns for name, columns in (inverted.PARTITIONED | vector_index.PARTITIONED).items()},
    )


def stored_vectors(now: files.Snapshot) -> vector_index.VectorIndex | None:
    """The vector index, if it was published with the embeddings of this snapshot."""
    names = [f"semantic/{name}" for name in vector_index.TABLES]
    if any(now.version(name) is None or now.version(name) != now.version("semantic/knowledge_embeddings") for name in names):
        return None
    return vector_index.VectorIndex(*[now.read(name) for name in names])


def stored_words(now: files.Snapshot) -> inverted.InvertedIndex | None:
    """The inverted index, if it was built from the knowledge that is eligible now and can be searched."""
    names = [f"semantic/{name}" for name in inverted.TABLES]
    if any(now.version(name) is None for name in names):
        return None
    found = inverted.InvertedIndex(*[now.read(name) for name in names])
    if found.stats.first()["built_from"] != now.version(ELIGIBLE) or not inverted.bounds_hold(found):
        return None
    return found


def stream(messages: DataFrame, warehouse: str, available_now: bool = False):
    """Starts the event stream into the curated tables."""
    return events.start(
        messages, f"{warehouse}/curated/fact_event", f"{warehouse}/curated/quarantined_events",
        f"{warehouse}/checkpoints/events", available_now, f"{warehouse}/{compaction.METRICS}",
    )


def refresh_analytics(spark: SparkSession, warehouse: str, recompute: bool = False) -> None:
    """All metrics from the partial ones that every batch of events has left; before the first event all
    counts are zero.  ``recompute`` reads the events themselves, for facts older than partial metrics."""
    log = compaction.EventLog(files.snapshot(spark, warehouse))
    parts = analytics.partial_metrics(log.events()) if recompute else analytics.add_up(log.metrics())
    metrics = analytics.merged_analytics(parts, F.lit(_now(spark)).cast("timestamp"))
    files.overwrite_table(metrics, warehouse, "semantic/question_analytics")


def compact(spark: SparkSession, warehouse: str) -> dict[str, int]:
    """Folds closed batches of events into days while the stream runs."""
    return compaction.compact(files.snapshot(spark, warehouse))


def _now(spark: SparkSession) -> str:
    """One stamp per run."""
    return spark.range(1).select(F.current_timestamp().cast("string")).first()[0]


def _embeddings(now: files.Snapshot) -> DataFrame:
    return now.read("semantic/knowledge_embeddings", S.EMBEDDINGS)


def search(
    spark: SparkSession, warehouse: str, questions: DataFrame, top_n: int = 5, topic: str | None = None,
    embedder: Embedder = hashed_words, semantic_weight: float = 0.6, lexical_weight: float = 0.4, fetch_n: int | None = None,
) -> DataFrame:
    """``questions``: (query_id, question).  With a topic both corpora are cut to it first.
    ``fetch_n`` candidates come from each side; by default as many as ``top_n`` may need.

    Without a topic words and vectors are looked up in the stored indexes, words unless knowledge was refreshed since;
    statistics of a topic are its own, so its rows are scanned."""
    now = files.snapshot(spark, warehouse)
    current = eligible(now)
    asked = staged(embedding.embed_queries(questions, embedder), "asked")
    return hybrid.search(
        asked, files.embedding_corpus(_embeddings(now), topic), files.lexical_corpus(current, topic),
        current, top_n, fetch_n or max(10, 2 * top_n), semantic_weight=semantic_weight, lexical_weight=lexical_weight,
        words=None if topic else stored_words(now), vectors=None if topic else stored_vectors(now),
    )


def evaluate(
    spark: SparkSession, warehouse: str, cases: DataFrame, embedder: Embedder = hashed_words
) -> dict[str, DataFrame]:
    """Per-case results, hit and empty counts by style, and the rejection summary."""
    now = files.snapshot(spark, warehouse)
    current = eligible(now)
    asked = cases.select(F.col("id").alias("query_id"), "question")
    asked = staged(embedding.embed_queries(asked, embedder), "asked")
    lists = evaluation.candidates(*hybrid.candidate_lists(asked, _embeddings(now), current, words=stored_words(now), vectors=stored_vectors(now)), current)
    results = staged(evaluation.eval_cases(cases, lists), "results")
    return {
        "cases": results,
        "summary": evaluation.eval_summary(results),
        "rejections": evaluation.rejection_summary(results),
    }


REPORTS = ("quality", "topics", "knowledge", "analytics", "freshness", "sources")


def report(spark: SparkSession, warehouse: str, name: str, topic: str | None = None, ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames of one report over the published tables, by name: ``quality`` (totals, by topic,
    ineligible records), ``topics``, ``knowledge`` of a topic, ``analytics`` (overall and by topic),
    ``freshness`` (age of the newest stamp of each table) or ``sources`` (records by id)."""
    now = files.snapshot(spark, warehouse)
    if name == "quality":
        return reports.quality(now.read("semantic/knowledge_catalog", S.CATALOG), now.read("semantic/topic_knowledge_summary", S.TOPIC_SUMMARY))
    if name == "topics":
        return {"topics": reports.topics(now.read("curated/dim_topic", S.DIM_TOPIC))}
    if name == "knowledge":
        return {"knowledge": reports.knowledge_by_topic(now.read("semantic/knowledge_catalog", S.CATALOG), topic)}
    if name == "analytics":
        overall, by_topic = analytics.metrics_wide(now.read("semantic/question_analytics", S.QUESTION_ANALYTICS))
        return {"overall": overall, "by_topic": by_topic}
    if name == "freshness":
        stamped = {
            "question_analytics": (now.read("semantic/question_analytics", S.QUESTION_ANALYTICS, or_empty=True), "computed_at"),
            "knowledge_embeddings": (now.read("semantic/knowledge_embeddings", S.EMBEDDINGS, or_empty=True), "embedded_at"),
            "fact_event": (compaction.EventLog(now).events(), "occurred_at"),
        }
        return {"freshness": reports.freshness(stamped, F.lit(_now(spark)).cast("timestamp"))}
    if name == "sources":
        return {"sources": reports.lookup_many(now.read("curated/dim_source", S.DIM_SOURCE), ids, "source_id")}
    raise ValueError(f"no report {name!r}; there are {', '.join(REPORTS)}")
