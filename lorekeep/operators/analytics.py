"""Usage metrics over the event fact, in long and wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import staged

# Metric names, in report order.
GLOBAL_METRICS = [
    "total_questions_asked",
    "total_responses_generated",
    "avg_response_latency_ms",
    "total_source_opens",
    "total_related_topic_opens",
    "feedback_up_count",
    "feedback_down_count",
]
TOPIC_METRICS = ["source_open_count", "related_topic_open_count"]


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _counts() -> list[Column]:
    feedback = _is("FEEDBACK_SUBMITTED")
    return [
        F.count_if(_is("QUESTION_ASKED")).alias("total_questions_asked"),
        F.count_if(_is("RESPONSE_GENERATED")).alias("total_responses_generated"),
        F.count_if(_is("SOURCE_OPENED")).alias("total_source_opens"),
        F.count_if(_is("RELATED_TOPIC_OPENED")).alias("total_related_topic_opens"),
        F.count_if(feedback & (F.col("rating") == "up")).alias("feedback_up_count"),
        F.count_if(feedback & (F.col("rating") == "down")).alias("feedback_down_count"),
    ]


def _latency() -> Column:
    return F.when(_is("RESPONSE_GENERATED"), F.col("latency_ms"))


def events_global(fact: DataFrame) -> DataFrame:
    """One row over all events.  The mean ignores responses without a latency."""
    return fact.agg(*_counts(), F.avg(_latency()).alias("avg_response_latency_ms")).select(*GLOBAL_METRICS)


def events_by_topic(fact: DataFrame) -> DataFrame:
    """Per topic named by an event, topics with two zeros included."""
    return fact.where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(
        F.count_if(_is("SOURCE_OPENED")).alias("source_open_count"),
        F.count_if(_is("RELATED_TOPIC_OPENED")).alias("related_topic_open_count"),
    )


def _long(wide: DataFrame, dimension: Column, metrics: list[str]) -> DataFrame:
    values = wide.select(
        dimension.alias("dimension"),
        *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics],
    )
    return values.unpivot("dimension", metrics, "metric_name", "metric_value")


def metrics_long(overall: DataFrame, by_topic: DataFrame, computed_at: Column) -> DataFrame:
    """(metric_name, dimension, metric_value, computed_at); dimension is null for global metrics."""
    rows = _long(overall, F.lit(None).cast("string"), GLOBAL_METRICS).unionByName(
        _long(by_topic, F.col("topic_id"), TOPIC_METRICS)
    )
    return rows.select("metric_name", "dimension", "metric_value", computed_at.alias("computed_at"))


def partial_metrics(fact: DataFrame) -> DataFrame:
    """Counts and latency sums per topic, events without one included; parts of a fact add up."""
    return fact.groupBy("topic_id").agg(*_counts(), F.sum(_latency()).alias("latency"), F.count(_latency()).alias("responses"))


def add_up(partials: DataFrame) -> DataFrame:
    """Partial metrics of several parts of a fact as those of the whole."""
    return partials.groupBy("topic_id").agg(*[F.sum(c).alias(c) for c in PARTIAL_METRICS])


PARTIAL_METRICS = [m for m in GLOBAL_METRICS if m != "avg_response_latency_ms"] + ["latency", "responses"]


def question_analytics(fact: DataFrame, computed_at: Column) -> DataFrame:
    """The whole metric table from one scan of the fact."""
    return merged_analytics(partial_metrics(fact), computed_at)


def merged_analytics(per_topic: DataFrame, computed_at: Column) -> DataFrame:
    """The whole metric table from partial metrics, one row per topic; the global row adds those up."""
    per_topic = staged(per_topic, "topic_metrics")
    totals = [F.sum(m).alias(m) for m in GLOBAL_METRICS if m != "avg_response_latency_ms"]
    mean = F.try_divide(F.sum("latency"), F.sum("responses")).alias("avg_response_latency_ms")
    by_topic = per_topic.where(F.col("topic_id").isNotNull()).select(
        "topic_id",
        F.col("total_source_opens").alias("source_open_count"),
        F.col("total_related_topic_opens").alias("related_topic_open_count"),
    )
    return metrics_long(per_topic.agg(*totals, mean), by_topic, computed_at)


def metrics_wide(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one global row, one row per topic), each with ``computed_at``.  Metric names are declared,
    so the pivot needs no pass to find them."""
    def pivot(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
        return rows.groupBy(*keys, "computed_at").pivot("metric_name", metrics).agg(F.first("metric_value"))

    overall = pivot(long.where(F.col("dimension").isNull()), [], GLOBAL_METRICS)
    topics = long.where(F.col("dimension").isNotNull()).withColumnRenamed("dimension", "topic_id")
    return overall, pivot(topics, ["topic_id"], TOPIC_METRICS)


def log_metrics(logs: DataFrame) -> DataFrame:
    """Two counters over request logs ``(service, status)``: requests by status class, and server
    errors."""
    requests = (
        logs.where(F.col("status") > 0)
        .withColumn("status_class", F.regexp_extract(F.col("status").cast("string"), r"([0-9])\d\d", 1))
        .groupBy("service", "status_class").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("requests").alias("metric"), "service", "status_class", "n")
    )
    errors = (
        logs.where(F.col("status") >= 500).groupBy("service").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("server_errors").alias("metric"), "service", F.lit(None).cast("string").alias("status_class"), "n")
    )
    return requests.unionByName(errors)
