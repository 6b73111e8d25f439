"""Joins that pick their strategy from a checked size and survive a hot key.

``sized_join`` is the one way big tables meet their parents here:

* the parent is small enough, by its files and by its decoded values -> broadcast it; the big side
  does not move, so a hot key costs nothing;
* the parent is large, but what the big side's keys refer to is small enough -> broadcast that;
* otherwise both sides shuffle, and every key with more rows than one task should have is salted:
  its rows are spread over as many partitions as its count makes shares, and its parents are copied
  as often.

No row is dropped, and no key brings a task more than a share (``heavy_keys``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.session import staged

ROWS_PER_TASK = 1_000_000
MAX_HEAVY = 50_000
NULL_SALTS = 1 << 20  # rows without a key have no parent to copy, so any number does


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; the file size for a plain scan, an over-estimate after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's own broadcast bound in bytes; zero or less switches broadcasting off."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    number = text.rstrip("bBkKmMgG")
    return int(float(number) * units.get(text[len(number):].lower(), 1))


def decoded_bytes(df: DataFrame) -> int:
    """What the values of a frame take once decoded: text by its length, the rest by its type."""
    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.col(field.name))), F.lit(0)) + 16
        return F.lit(8)

    row = sum((width(f) for f in df.schema), F.lit(16))
    return int(df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])


def fits_broadcast(df: DataFrame) -> bool:
    """By Catalyst's estimate first, which is the size of compressed files; only a frame that passes
    is measured, by a scan of no more than that."""
    limit = broadcast_limit(df)
    return estimated_bytes(df) <= limit and decoded_bytes(df) <= limit


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``_row``, a number per row to spread rows by - exact copies included, which no hash of
    their columns could tell apart.  Number a table where it is scanned, before any shuffle: a
    task that is run again reads the same rows in the same order and numbers them alike.
    """
    return df.withColumn("_row", F.monotonically_increasing_id())


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(key, _rows)``; counts combine on the map side, so no group is ever gathered."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))


def heavy_keys(counts: DataFrame, key: str) -> DataFrame:
    """``(key, _salts)`` of the keys with more rows than one task should have.

    A task's share is ``ROWS_PER_TASK``, or a ``MAX_HEAVY``-th of the heavy keys' rows if that is
    more, so the list has at most ``MAX_HEAVY`` keys and may be broadcast.  Each gets as many salts as
    its rows make shares.
    """
    heavy = staged(counts.select(key, "_rows").where(F.col("_rows") > ROWS_PER_TASK), "heavy")
    rows = heavy.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    share = max(ROWS_PER_TASK, rows // MAX_HEAVY)
    return heavy.where(F.col("_rows") > share).select(key, F.ceil(F.col("_rows") / share).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame, parent: DataFrame, key: str, how: str, spread_by: Sequence[str | Column],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on ``key`` with the big side's heavy keys spread over as many partitions as their
    rows need.

    ``spread_by`` names columns that tell rows of one key apart (``_row`` where copies may occur);
    hashing them, not ``rand``, keeps a recomputed task identical to the first run.  ``counts`` may give the
    rows per key where they are known already.  Rows without a key match nothing and are spread as well.
    """
    heavy = heavy_keys(key_counts(big, key) if counts is None else counts, key)
    hashed = F.xxhash64(*spread_by)
    salt = F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(NULL_SALTS))).otherwise(F.pmod(hashed, F.coalesce("_salts", F.lit(1))))
    left = big.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = parent.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame, parent: DataFrame, key: str, how: str = "left",
    spread_by: Sequence[str | Column] = ("_row",), counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to ``parent`` (one row per key, or few) on ``key``; see the module notes.

    Of a large parent only the rows that ``big`` refers to are kept, so wide rows move for it only if
    those are too many as well.  They shuffle by their keys alone, against keys counted once."""
    if fits_broadcast(parent):
        return big.join(F.broadcast(parent), key, how)
    if counts is None:
        counts = key_counts(big, key)
    counts = staged(counts.select(key, "_rows"), "key_counts")
    asked = staged(parent.join(counts.select(key).distinct(), key, "left_semi"), "asked_parents")
    if fits_broadcast(asked):
        return big.join(F.broadcast(asked), key, how)
    return salted_join(big, asked, key, how, spread_by, counts)


def keep_matching(big: DataFrame, wanted: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Rows of ``big`` whose key is in ``wanted`` (left semi): a broadcast when the wanted ids are
    few, else a shuffle, salted unless ``big`` is ``unique`` by key and so cannot be skewed."""
    ids = wanted.select(key).distinct()
    if fits_broadcast(wanted.select(key)):
        return big.join(F.broadcast(ids), key, "left_semi")
    if unique:
        return big.join(ids, key, "left_semi")
    return salted_join(numbered(big), ids, key, "inner", ["_row"]).drop("_row")


def attach(few: DataFrame, table: DataFrame, key: str, spread_by: Sequence[str | Column]) -> DataFrame:
    """Inner join of a short list to a big table that holds each key once.

    The list is staged, so its size is known: when it fits it is broadcast and the table is only
    scanned; else the table is cut down to the wanted keys first, and a key the list repeats
    endlessly is salted.
    """
    few = staged(few, "few")
    if fits_broadcast(few):
        return table.join(F.broadcast(few), key)
    return salted_join(few, keep_matching(table, few, key, unique=True), key, "inner", spread_by)
