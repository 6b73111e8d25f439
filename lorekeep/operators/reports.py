"""Reporting queries over the curated and semantic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.joins import fits_broadcast, keep_matching, salted_join
from lorekeep.operators.topk import ranked
from lorekeep.session import staged


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup: one row or none.  The equality reaches the Parquet scan."""
    return table.where(F.col(key) == value).limit(1)


def lookup_many(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` (one per id) for a whole list of ids; unknown ids give none."""
    return keep_matching(table, ids, key, unique=True)


def eligibility(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(knowledge_id, ai_eligible)``: true, false, or null when the id does not exist.  The
    catalog is cut to the ids first, so a short list does not make it move."""
    wanted = staged(ids.select("knowledge_id").distinct(), "ids")
    flags = keep_matching(catalog.select("knowledge_id", "ai_eligible"), wanted, "knowledge_id", unique=True)
    return wanted.join(flags, "knowledge_id", "left")


def topics(dim: DataFrame) -> DataFrame:
    return dim.select("topic_id", "topic_name", "parent_category", "description").orderBy("topic_name", "topic_id")


def knowledge_by_topic(catalog: DataFrame, topic_id: str) -> DataFrame:
    return (
        catalog.where(F.col("topic_id") == topic_id)
        .select("knowledge_id", "title", "summary", "review_status", "content_status", "ai_eligible")
        .orderBy("title", "knowledge_id")
    )


def ineligible(catalog: DataFrame) -> DataFrame:
    return (
        catalog.where(~F.col("ai_eligible"))
        .select("knowledge_id", "topic_id", "topic_name", "title", "review_status", "content_status")
        .orderBy("topic_id", "knowledge_id")
    )


def quality_totals(summary: DataFrame) -> DataFrame:
    """Totals over topics; the percentage rounds half to even and is 0.0 when there is nothing."""
    total, eligible = F.col("total_knowledge_count"), F.col("eligible_count")
    sums = summary.agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_knowledge_count"),
        F.coalesce(F.sum("eligible_count"), F.lit(0)).alias("eligible_count"),
    )
    share = F.bround(F.try_divide(100 * eligible, total), 1)
    return sums.select(total, eligible, F.when(total > 0, share).otherwise(F.lit(0.0)).alias("eligible_percentage"))


def quality(catalog: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": quality_totals(summary),
        "by_topic": summary.orderBy("topic_name", "topic_id"),
        "ineligible": ineligible(catalog),
    }


def _others(first: Column, topic_id: Column, limit: int) -> Column:
    return F.slice(F.filter(first, lambda t: t["topic_id"] != topic_id), 1, limit)


def related_lists(dim: DataFrame, topic_ids: DataFrame, limit: int) -> DataFrame:
    """``(for_topic_id, related)``: the first ``limit`` other topics of the same category by name,
    or of all categories when there is none (an unknown id counts as having none).

    Only the first ``limit + 1`` names of a category can ever be an answer - one of them may be the
    topic itself - so each category is reduced to those before anything joins.  No pairs are made.
    """
    entry = F.struct("rank", "topic_id", "topic_name", "parent_category")
    by_name = [F.asc("topic_name"), F.asc("topic_id")]
    siblings = (
        ranked(dim.select("topic_id", "topic_name", "parent_category"), ["parent_category"], by_name, limit + 1)
        .groupBy("parent_category").agg(F.array_sort(F.collect_list(entry)).alias("first"))
    )
    anywhere = (
        dim.orderBy(*by_name).limit(limit + 1)
        .select(F.struct(F.lit(0).alias("rank"), "topic_id", "topic_name", "parent_category").alias("t"))
        .agg(F.array_sort(F.collect_list("t"), lambda a, b: F.when(
            F.struct(a["topic_name"], a["topic_id"]) < F.struct(b["topic_name"], b["topic_id"]), -1).otherwise(1)
        ).alias("first"))
    )
    asked = topic_ids.select(F.col("topic_id").alias("for_topic_id")).distinct()
    own = dim.select(F.col("topic_id").alias("for_topic_id"), "parent_category")
    rows = asked.join(own, "for_topic_id", "left")
    if fits_broadcast(siblings):
        listed = rows.join(F.broadcast(siblings), "parent_category", "left")
    else:  # one short row per category: not worth being cut to what is asked for and written first
        listed = salted_join(rows, siblings, "parent_category", "left", ["for_topic_id"])
    listed = listed.withColumn("any", anywhere.scalar())
    same = F.coalesce(_others(F.col("first"), F.col("for_topic_id"), limit), F.array())
    return listed.select(
        "for_topic_id",
        F.when(F.size(same) > 0, same)
        .otherwise(_others(F.col("any"), F.col("for_topic_id"), limit)).alias("related"),
    )


def related_topics(dim: DataFrame, topic_ids: DataFrame, limit: int = 3) -> DataFrame:
    """``(for_topic_id, rank, topic_id, topic_name, parent_category)``."""
    return related_lists(dim, topic_ids, limit).select(
        "for_topic_id", F.posexplode("related").alias("pos", "t")
    ).select("for_topic_id", (F.col("pos") + 1).cast("long").alias("rank"), "t.topic_id", "t.topic_name", "t.parent_category")


def quality_dimensions(rejects: DataFrame) -> DataFrame:
    """Rejected rows per table and quality dimension (completeness, uniqueness, validity)."""
    reason = F.col("reason")
    dimension = (
        F.when(reason.startswith("missing required fields"), "completeness")
        .when(reason.startswith("duplicate id"), "uniqueness")
        .otherwise("validity")
    )
    return rejects.groupBy("table", dimension.alias("dimension")).agg(F.count(F.lit(1)).alias("rejected"))


def freshness(tables: dict[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """Seconds since the newest stamp of each table: ``{name: (frame, time column)}``."""
    out = None
    for name, (frame, column) in tables.items():
        newest = frame.agg(F.max(column).cast("timestamp").alias("newest"))
        row = newest.select(F.lit(name).alias("table"), "newest", F.timestamp_diff("SECOND", "newest", now).alias("age_seconds"))
        out = row if out is None else out.unionByName(row)
    return out
