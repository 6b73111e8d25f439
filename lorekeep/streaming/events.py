"""Interaction events: message bytes -> event fact or quarantine table.

``annotate_events`` is stateless, so the same function serves a batch and a stream.  Events are not
deduplicated and nothing is windowed.  Each batch also writes its partial metrics, which add up to those of
the whole fact (``operators.analytics``); ``streaming.compaction`` folds closed batches into days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep import schemas as S
from lorekeep.functions.iso import integer, iso_timestamp, number
from lorekeep.functions.payload import parse_objects
from lorekeep.operators.analytics import partial_metrics
from lorekeep.operators.quality import event_rules, first_reason
from lorekeep.sources.files import batch_path, write_events


def annotate_events(messages: DataFrame) -> DataFrame:
    """``value: binary`` -> the ten wire fields as text, ``reason``, and for rejects the message as
    it came.  Other fields of a message are dropped here, so free text never reaches the fact."""
    read = parse_objects(messages, S.EVENT_WIRE).select(
        F.col("text").alias("raw_payload"), "readable", "is_object", "fields.*"
    )
    reason = F.coalesce(
        F.when(~F.col("readable"), F.lit("unparseable JSON: not one JSON value in UTF-8")),
        F.when(~F.col("is_object"), F.lit("event is not a JSON object")),
        first_reason(event_rules()),
    )
    judged = read.select(*S.EVENT_COLUMNS, "raw_payload", reason.alias("reason"))
    return judged.withColumn("raw_payload", F.when(F.col("reason").isNotNull(), F.col("raw_payload")))


def normalize_events(annotated: DataFrame) -> DataFrame:
    """Valid events with exactly the fact's columns and types."""
    typed: dict[str, Column] = {
        "latency_ms": number(F.col("latency_ms").cast("string")),
        "source_count": integer(F.col("source_count").cast("string")),
        "occurred_at": iso_timestamp(F.col("occurred_at").cast("string")),
    }
    return annotated.where(F.col("reason").isNull()).withColumns(typed).select(*S.EVENT_COLUMNS)


def quarantined_events(annotated: DataFrame, stamp: Column | None = None) -> DataFrame:
    stamp = F.current_timestamp() if stamp is None else stamp
    return annotated.where(F.col("reason").isNotNull()).select(
        "reason", "raw_payload", stamp.alias("quarantined_at")
    )


def start(
    messages: DataFrame, fact_dir: str, quarantine_dir: str, checkpoint: str, available_now: bool = False,
    metrics_dir: str | None = None,
) -> StreamingQuery:
    """Append valid events and rejects, and with ``metrics_dir`` partial metrics.  Each micro-batch is annotated once and written under its
    own ``batch_id``, so a replay after a failure replaces its files instead of doubling them.
    Batch numbers belong to a query, whose id is kept in its checkpoint: a fresh checkpoint, at the
    same path or another, is a feed of its own and replaces nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        feed = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()
        try:
            valid = normalize_events(batch)
            write_events(valid, fact_dir, feed, batch_id)
            if metrics_dir:
                partial_metrics(valid).write.mode("overwrite").parquet(batch_path(metrics_dir, feed, batch_id))
            quarantined_events(batch).write.mode("overwrite").parquet(
                batch_path(quarantine_dir, feed, batch_id))
        finally:
            batch.unpersist()

    writer = (
        annotate_events(messages).writeStream.queryName("events").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_for(query: StreamingQuery, seconds: float) -> None:
    """Let an unbounded query run for a while, then stop it cleanly."""
    query.awaitTermination(seconds)
    query.stop()


def envelope(submitted: DataFrame) -> DataFrame:
    """The ten-field event for accepted submissions: a fresh id and the time of receipt; fields a
    submission lacks are null."""
    made = {"event_id": F.expr("uuid()"), "occurred_at": F.current_timestamp()}
    return submitted.select(*[
        (made[f.name] if f.name in made else F.col(f.name) if f.name in submitted.columns else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in S.FACT_EVENT
    ])


def to_messages(events: DataFrame) -> DataFrame:
    """Events as message bytes, every field present, times in ISO form with their offset."""
    iso = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("occurred_at")
    body = F.struct(*[iso if c == "occurred_at" else F.col(c) for c in S.EVENT_COLUMNS])
    return events.select(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"))
