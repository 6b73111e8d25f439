"""Pieces the operators share: words, row numbers, private column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import staged

# ASCII white space: what separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
# Private columns carry this prefix, so a caller's own columns may have any plain name.
ROW = "__lk_row"
DOC = "__lk_doc"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of this package and, where SQL can say it, its DuckDB text."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def fold(text: str, *cols: Column) -> Column:
    """128 bits over ``cols``: two 64-bit hashes with different leading text."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(text), *cols).alias("b"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row in ``ROW``, repeated rows included.

    How files are split depends on the cores registered when a scan is planned, so a second scan may
    number rows otherwise.  Rows are numbered in one scan, written to the shared folder with all
    their columns, and only read from there; ``docs`` that have their numbers stay as they are.
    """
    return docs if ROW in docs.columns else staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
