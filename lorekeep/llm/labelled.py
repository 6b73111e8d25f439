"""Labelled documents to fit a classifier on, and the folds that keep some of them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """``doc_id, text, label`` of about ``bound`` labelled documents at most, none of the held fold.

    A hash of the id picks them, so the sample does not depend on the layout.  An id with
    several labels takes the smallest, one with several texts the first by value; both reduce
    before they shuffle, so an id that repeats without end is still one row.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held))
    each = usable.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    share, total = 1 << 30, each.count()
    if total > bound:
        each = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < int(share * bound / total))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(each), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
