"""Readers and writers for files and tables.  Every read names its schema."""

from __future__ import annotations

import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import schemas as S
from lorekeep.functions.iso import integer
from lorekeep.session import drop_folder

LOG = "_published"  # one row per publication: its version and the tables it replaced; or a checkpoint of them
_names = T.ArrayType(T.StringType())
PUBLISHED = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("tables", _names),
    T.StructField("state", T.MapType(T.StringType(), _names)), T.StructField("folded", _names),
])
KEPT = 2  # versions of a table that stay
CHECKPOINT_EVERY = 20  # log rows that are folded into one
READ_ATTEMPTS = 5


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Header CSV, UTF-8, doubled quotes; an empty cell is empty text, not null.

    A quoted cell may hold line breaks, which forbids splitting a file: deliver large feeds as many
    files, or pass ``multi_line=False`` for feeds without such cells.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", multi_line).option("encoding", "UTF-8")
        .option("quote", '"').option("escape", '"').option("enforceSchema", False)
        .csv(path)
    )
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def cast_on_load(df: DataFrame, long_columns: list[str]) -> DataFrame:
    """Text to long; a value that is no integer fails the load, whatever the session's ANSI mode."""
    def strict(name: str) -> Column:
        text = F.col(name).cast("string")
        refuse = F.raise_error(F.concat(F.lit(f"{name} is not an integer: '"), text, F.lit("'"))).cast("long")
        return F.when(text.isNotNull() & integer(text).isNull(), refuse).otherwise(integer(text))

    return df.withColumns({c: strict(c) for c in long_columns})


def read_table(spark: SparkSession, base: str, name: str, schema: T.StructType | None = None, or_empty: bool = False) -> DataFrame:
    """The current version of a published table, or the plain Parquet folder of that name; the column
    list and filters of the query reach the scan.  ``or_empty`` reads an absent table as no rows.

    A job that reads several tables takes one ``snapshot`` and reads them all from it."""
    return snapshot(spark, base).read(name, schema, or_empty)


def read_benchmark(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Benchmark cases from one JSON array (or JSON lines with ``multi_line=False``)."""
    return spark.read.schema(S.BENCHMARK_CASE).option("multiLine", multi_line).json(path)


def param_query(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """A parameterised read: ``:name`` markers bind values, ``{table}`` markers bind frames."""
    return spark.sql(sql, args=args, **tables)


def corpus(table: DataFrame, columns: list[str], topic: str | None = None) -> DataFrame:
    """Retrieval corpus: pruned columns and, unless the topic is empty, one topic.  The filter sits
    below any scoring, so it reaches the Parquet scan."""
    return (table.where(F.col("topic_id") == topic) if topic else table).select(*columns)


def embedding_corpus(embeddings: DataFrame, topic: str | None = None) -> DataFrame:
    return corpus(embeddings, ["knowledge_id", "topic_id", "title", "summary", "embedding"], topic)


def lexical_corpus(eligible: DataFrame, topic: str | None = None) -> DataFrame:
    return corpus(eligible, ["knowledge_id", "topic_id", "title", "summary"], topic)


def file_signals(notifications: DataFrame) -> DataFrame:
    """One signal row per landed file, from object notifications (batch or stream)."""
    return notifications.select(
        F.lit("RAW_FILE_ARRIVED").alias("event_type"),
        "bucket",
        F.col("name").alias("object_name"),
        F.col("contentType").alias("content_type"),
        F.col("size").cast("long").alias("size_bytes"),
        F.col("timeCreated").alias("time_created"),
    )


def new_run_id(now: datetime | None = None) -> str:
    """UTC stamp ``YYYYMMDDTHHMMSSZ`` naming one run."""
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def overwrite_table(df: DataFrame, base: str, name: str) -> None:
    """Full refresh of one table."""
    publish({name: df}, base)


def quarantine_lines(rejects: DataFrame) -> DataFrame:
    """``{"table":..., "reason":..., "row": {...}}`` per reject; ``row`` is spliced in as JSON, so
    tables of any shape share one file."""
    head = F.to_json(F.struct("table", "reason"))
    line: Column = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"row":'), F.col("row"), F.lit("}"))
    return rejects.withColumn("h", head).select(line.alias("value"))


def write_quarantine(rejects: DataFrame, base: str, run_id: str) -> str:
    path = f"{base}/{run_id}/quarantine"
    quarantine_lines(rejects).write.mode("overwrite").text(path)
    return path


def batch_path(base: str, feed: str, batch_id: int) -> str:
    """The folder one micro-batch of one feed owns."""
    return f"{base}/feed={feed}/batch_id={batch_id}"


def write_events(df: DataFrame, base: str, feed: str, batch_id: int) -> None:
    """One micro-batch of the event fact, partitioned by day so metrics over a span read only its
    days.  The batch owns its folder: a replay replaces it instead of appending twice."""
    (
        df.withColumn("event_date", F.to_date("occurred_at"))
        .write.mode("overwrite").partitionBy("event_date").parquet(batch_path(base, feed, batch_id))
    )


@dataclass(frozen=True)
class Snapshot:
    """The tables of a warehouse as they were at one moment: ``state`` has the versions of each that are
    still there, the current one last.  Whatever is published meanwhile, a job reads one state."""

    spark: SparkSession
    base: str
    state: dict[str, list[str]]

    def version(self, name: str) -> str | None:
        """The version of a table; none if it was never published."""
        return self.state[name][-1] if name in self.state else None

    def read(self, name: str, schema: T.StructType | None = None, or_empty: bool = False) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        try:
            return reader.parquet("/".join([self.base, name, *self.state.get(name, [])[-1:]]))
        except AnalysisException as error:
            if or_empty and schema is not None and error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise


def snapshot(spark: SparkSession, base: str) -> Snapshot:
    """The current state of a warehouse, from one read of its log."""
    return Snapshot(spark, base, _state(_entries(spark, base)))


def _entries(spark: SparkSession, base: str) -> list[Row]:
    """The log: at most one checkpoint and the publications since.  A checkpoint removes what it
    stands for, so a read that meets a file on its way out reads again."""
    for attempt in range(READ_ATTEMPTS):
        try:
            return spark.read.schema(PUBLISHED).json(f"{base}/{LOG}").withColumn("file", F.input_file_name()).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        except PySparkException:
            if attempt + 1 == READ_ATTEMPTS:
                raise
    raise AssertionError("unreachable")


def _state(entries: list[Row]) -> dict[str, list[str]]:
    """Per table the last two versions, by the newest checkpoint and all publications it does not hold.
    Publications may be written in another order than they began; versions order them."""
    checkpoint = max((e for e in entries if e["state"] is not None), key=lambda e: e["version"], default=None)
    state = {k: list(v) for k, v in checkpoint["state"].items()} if checkpoint else {}
    folded = set(checkpoint["folded"]) if checkpoint else set()
    for entry in entries:
        if entry["state"] is None and entry["version"] not in folded:
            for name in entry["tables"]:
                state[name] = sorted({*state.get(name, []), entry["version"]})
    return {name: versions[-KEPT:] for name, versions in state.items()}


def publish(tables: dict[str, DataFrame], base: str, partitioned: dict[str, list[str]] | None = None) -> str:
    """Replace tables together, or not at all; returns their version.

    Every table is written to a folder of its own, and only when all are complete does one row of
    the warehouse's log name them current.  That row is one file, committed as a whole, so a snapshot has
    all old tables or all new ones, and a failed run leaves the old ones as they were.  The version
    before stays for jobs that have begun; older ones go.  The writes do not depend on each
    other, so they share the cluster instead of queueing.  ``partitioned`` names the columns whose values
    become folders of a table.
    """
    spark = next(iter(tables.values())).sparkSession
    version = new_version()
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        writes = [
            pool.submit(df.write.partitionBy(*(partitioned or {}).get(name, [])).parquet, f"{base}/{name}/{version}")
            for name, df in tables.items()
        ]
        for done in writes:
            done.result()
    before = _state(_entries(spark, base))
    _log(spark, base, Row(version=version, tables=sorted(tables), state=None, folded=None))
    entries = _entries(spark, base)
    after = _state(entries)
    for name in tables:
        for old in set(before.get(name, [])) - set(after[name]):
            drop_folder(spark, f"{base}/{name}/{old}")
    if len(entries) >= CHECKPOINT_EVERY:
        checkpoint(spark, base)
    return version


def new_version() -> str:
    """Versions sort by the time a publication began."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _log(spark: SparkSession, base: str, entry: Row) -> None:
    """One row, one file, committed as a whole."""
    spark.createDataFrame([entry], PUBLISHED).coalesce(1).write.mode("append").json(f"{base}/{LOG}")


def checkpoint(spark: SparkSession, base: str) -> None:
    """Folds the log into one row with the whole state, then removes the files it stands for.  A
    publication written meanwhile is not among them and stays."""
    entries = _entries(spark, base)
    if not entries:
        return
    folded = sorted({e["version"] for e in entries if e["state"] is None})
    _log(spark, base, Row(version=new_version(), tables=[], state=_state(entries), folded=folded))
    for file in {e["file"] for e in entries}:
        drop_folder(spark, file)


def remove_orphans(spark: SparkSession, base: str, older_than_seconds: float = 86_400) -> list[str]:
    """Removes version folders that no state names: what failed runs have left.  A run that is still
    writing has a young version, so only folders begun ``older_than_seconds`` ago go.  Returns them."""
    state = snapshot(spark, base).state
    named = {f"{name}/{version}" for name, versions in state.items() for version in versions}
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    system, gone = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    root = str(system.makeQualified(path).toString()).rstrip("/")
    limit = time.time_ns() - int(older_than_seconds * 1e9)
    for depth in ("*/*", "*/*/*"):
        for found in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{depth}")) or []:
            name = found.getPath().toString()[len(root) + 1:]
            stamp = re.fullmatch(r"(\d{20})-[0-9a-f]{8}", name.rsplit("/", 1)[-1])
            if stamp and name not in named and int(stamp[1]) < limit:
                drop_folder(spark, f"{root}/{name}")
                gone.append(name)
    return sorted(gone)


def versions(spark: SparkSession, base: str, name: str) -> list[str]:
    """Versions of a table that are still there, oldest first; none if it never was published."""
    return snapshot(spark, base).state.get(name, [])
