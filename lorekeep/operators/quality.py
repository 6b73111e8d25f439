"""Data-quality rules: one nullable ``reason`` column, the first failing rule wins.

A rule is ``(failing: Column, message: Column)``.  A row is valid when its reason is null, so a
table is annotated once and split by a filter - no second pass, no row-level Python.  The wording
of reasons is a fixed value: reports and readers match on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.iso import integer, iso_date, iso_timestamp, number
from lorekeep.functions.text import is_blank, quoted
from lorekeep.operators.joins import numbered, sized_join
from lorekeep.session import staged

Rule = tuple[Column, Column]


def first_reason(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*[F.when(failing, message) for failing, message in rules])


def missing_fields(required: Sequence[str]) -> Rule:
    """Blank or absent required fields, listed in declared order as ``['a', 'b']``."""
    names = F.concat_ws(", ", *[F.when(is_blank(F.col(c)), F.lit(f"'{c}'")) for c in required])
    return names != "", F.concat(F.lit("missing required fields: ["), names, F.lit("]"))


def not_in(column: str, allowed: Sequence[str]) -> Rule:
    return ~F.col(column).isin(list(allowed)), quoted(f"invalid {column}", F.col(column))


def unknown_key(column: str, found: str) -> Rule:
    return F.col(found).isNull(), quoted(f"unknown {column}", F.col(column))


def unparseable(column: str, parsed: Column) -> Rule:
    return parsed.isNull(), quoted(f"unparseable {column}", F.col(column).cast("string"))


def topic_rules() -> list[Rule]:
    return [missing_fields(S.TOPIC_REQUIRED)]


def source_rules() -> list[Rule]:
    return [
        missing_fields(S.SOURCE_REQUIRED),
        not_in("source_status", S.SOURCE_STATUSES),
        (~F.col("url").startswith("https://"), quoted("url is not https:", F.col("url"))),
    ]


def knowledge_rules(topic_found: str = "topic_name", source_found: str = "source_status") -> list[Rule]:
    """Expects the parents' columns joined on; a null there means the key has no valid parent."""
    return [
        missing_fields(S.KNOWLEDGE_REQUIRED),
        unknown_key("topic_id", topic_found),
        unknown_key("source_id", source_found),
        not_in("review_status", S.REVIEW_STATUSES),
        not_in("content_status", S.CONTENT_STATUSES),
        unparseable("published_date", iso_date(F.col("published_date"))),
        unparseable("last_reviewed_date", iso_date(F.col("last_reviewed_date"))),
        (
            integer(F.col("content_version").cast("string")).isNull(),
            quoted("invalid content_version", F.col("content_version").cast("string")),
        ),
    ]


def review_rules(knowledge_found: str = "knowledge_found") -> list[Rule]:
    return [
        missing_fields(S.REVIEW_REQUIRED),
        unknown_key("knowledge_id", knowledge_found),
        not_in("review_status", S.REVIEW_STATUSES),
        unparseable("review_date", iso_date(F.col("review_date"))),
    ]


def event_rules() -> list[Rule]:
    latency, sources = F.col("latency_ms").cast("string"), F.col("source_count").cast("string")
    return [
        missing_fields(S.EVENT_REQUIRED),
        not_in("event_type", S.EVENT_TYPES),
        (F.col("rating").isNotNull() & ~F.col("rating").isin(S.RATINGS), quoted("invalid rating", F.col("rating"))),
        unparseable("occurred_at", iso_timestamp(F.col("occurred_at").cast("string"))),
        (latency.isNotNull() & number(latency).isNull(), quoted("invalid latency_ms", latency)),
        (sources.isNotNull() & integer(sources).isNull(), quoted("invalid source_count", sources)),
    ]


def client_event_rules() -> list[Rule]:
    """What a client may submit: three event types, a rating of up or down, a session (which may
    be empty text, but must be there)."""
    return [
        (F.col("event_type").isNull(), F.lit("missing required fields: ['event_type']")),
        (F.col("session_id").isNull(), F.lit("missing required fields: ['session_id']")),
        (
            ~F.col("event_type").isin(S.CLIENT_EVENT_TYPES),
            quoted("event_type not accepted from clients", F.col("event_type")),
        ),
        (F.col("rating").isNotNull() & ~F.col("rating").isin(S.RATINGS), quoted("invalid rating", F.col("rating"))),
    ]


def annotate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("reason", first_reason(rules))


def split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reason, rejected rows with it)."""
    ok = F.col("reason").isNull()
    return annotated.where(ok).drop("reason"), annotated.where(~ok)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, _copies)`` for every key held by more than one row; rows without a key count as one
    group.  Only the key column is shuffled, after a map-side count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")


def annotate_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Adds ``duplicate_reason``: every row of a repeated id is rejected, none is picked as winner.

    A window count would sort whole rows by id and gather a hot id in one task.  Here ids are
    counted alone, the (normally few) repeated ones are staged, and the wide rows meet them through
    a size-checked join, so they usually do not move at all.  A frame that is ``numbered`` already
    keeps its numbers.
    """
    rows = df if "_row" in df.columns else numbered(df)
    repeats = staged(repeated_keys(df, key), "repeated_keys")
    # A null id joins to nothing, so it travels as a flagged empty key.
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")))
    marks = repeats.select(F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")).alias("_key"), "_copies")
    counted = sized_join(keyed, marks, "_key", "left", counts=marks.select("_key", F.col("_copies").alias("_rows")))
    reason = F.format_string("duplicate id: %d rows share this identifier", F.col("_copies"))
    return counted.select(*df.columns, F.when(F.col("_copies").isNotNull(), reason).alias("duplicate_reason"))
