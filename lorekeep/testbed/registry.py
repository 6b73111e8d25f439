"""Registered queries: a Spark side and, where SQL can say it, the oracle's text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.refresh import Refresh
from lorekeep.session import scratch_path, staged
from lorekeep.streaming.events import normalize_events
from lorekeep.operators import inverted, vector_index
from lorekeep.operators.joins import estimated_bytes
from lorekeep.operators.quality import annotate, event_rules
from lorekeep.sources import files
from lorekeep.testbed import bindings

_contexts: dict[tuple[str, str], "Context"] = {}


class Context:
    """Inputs over one data folder.  Raw tables are landed and the curated layer is built once per
    session, as a refresh would, and the reports read it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, str] = {}  # paths of inputs written once
        self._landed: dict[str, DataFrame] = {}

    def bind(self, view: str) -> DataFrame:
        return bindings.bind(self.spark, self.sf_dir, view)

    def table(self, name: str) -> DataFrame:
        return bindings.table(self.spark, self.sf_dir, name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def raw(self, view: str) -> DataFrame:
        """The view landed as a raw table, in as many files as there are cores to read them.  Rows that come from
        as many splits already stay where they are."""
        if view not in self._landed:
            cores = self.spark.sparkContext.defaultParallelism
            rows = self.bind(view)
            self._landed[view] = staged(rows if self.splits(view) >= cores else rows.repartition(cores), view)
        return self._landed[view]

    def splits(self, view: str) -> int:
        """Scan tasks that find rows in the largest table of the view."""
        largest = max(bindings.tables_of(view), key=lambda name: estimated_bytes(self.table(name)))
        return self.table(largest).select(F.spark_partition_id()).distinct().count()

    def new_refresh(self) -> Refresh:
        return Refresh(*[self.raw(v) for v in ("b_topics", "b_sources", "b_knowledge", "b_reviews")])

    @cached_property
    def refresh(self) -> Refresh:
        return self.new_refresh()

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("b_embeddings")

    @cached_property
    def questions(self) -> DataFrame:
        return self.raw("b_questions")

    @cached_property
    def lexical_index(self) -> inverted.InvertedIndex:
        """The inverted index of the eligible knowledge, published once and read back like any table."""
        base = self.scratch("index")
        files.publish(inverted.build(self.refresh.eligible).tables(), base, {f"semantic/{k}": v for k, v in inverted.PARTITIONED.items()})
        now = files.snapshot(self.spark, base)
        return inverted.InvertedIndex(*[now.read(f"semantic/{name}") for name in inverted.TABLES])

    @cached_property
    def vector_index(self) -> vector_index.VectorIndex:
        base = self.scratch("vectors")
        files.publish(vector_index.build(self.embeddings).tables(), base, {f"semantic/{k}": v for k, v in vector_index.PARTITIONED.items()})
        now = files.snapshot(self.spark, base)
        return vector_index.VectorIndex(*[now.read(f"semantic/{name}") for name in vector_index.TABLES])

    @cached_property
    def checked_events(self) -> DataFrame:
        return annotate(self.raw("b_events"), event_rules())

    @cached_property
    def fact(self) -> DataFrame:
        return staged(normalize_events(self.checked_events), "fact")


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Views of the oracle side, on top of the input bindings.
SQL_VIEWS: dict[str, str] = dict(bindings.VIEWS)


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may read the input bindings and ``SQL_VIEWS`` by name."""
    def register(build: Callable[[Context], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, sf_dir: build(context(spark, sf_dir))

    return {name: bound(build) for name, build in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: bindings.with_clause(sql, SQL_VIEWS) + sql for name, sql in ORACLES.items()}


def six(column: str):
    return F.round(column, 6).alias(column)


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates print alike in every client as text."""
    days = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    return df.withColumns({c: F.col(c).cast("string") for c in days})
