"""Session settings and the shared working folder.

Intermediate tables and checkpoints must outlive any single executor, so they go to the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local session (tests, bench) may fall back to a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scope: ContextVar[str] = ContextVar("scratch scope", default="")


def build_session(app: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on.  UTC and AQE are the ones that matter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is named and Spark is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="lorekeep-")
    return _local_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_dir(spark)}/lorekeep/{spark.sparkContext.applicationId}/{_scope.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Within it, intermediate tables go to a folder of their own, which is what it gives.

    For steps that have an end: once a step's result is written, ``drop_folder`` on this folder
    frees what the step needed, and a lost executor reads the result instead."""
    within = f"{_scope.get()}{name}-{uuid.uuid4().hex}/"
    token = _scope.set(within)
    try:
        yield f"{shared_dir(spark)}/lorekeep/{spark.sparkContext.applicationId}/{within}".rstrip("/")
    finally:
        _scope.reset(token)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python workers get and give batches of ``rows`` rows at most.

    Spark keeps idle workers, with what their largest batch took, next to the steps that follow.  Only
    what is written within the scope is bounded: the setting is read when a frame runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark can write one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> None:
    """Removes every intermediate table of this application; for the end of a job."""
    drop_folder(spark, f"{shared_dir(spark)}/lorekeep/{spark.sparkContext.applicationId}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of replaying the job), computes
    the frame once however many readers follow, and gives Catalyst a true size for its join choice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
