"""Folding closed batches of the event stream into days, while the stream runs.

The stream gives every batch a folder of its own, so that a replay replaces it.  A batch is closed once its
feed has begun a later one: only the newest can be replayed.  ``compact`` moves the closed ones:

* events and rejects of a day go to the day's own table, ``curated/event_days/<day>`` and
  ``curated/quarantine_days/<day>``; only days that got something are written again, each with all it had;
* partial metrics go to one small table;
* ``curated/covered_batches`` says up to which batch of each feed that was done.

All of them are published as one version, so a reader of one snapshot sees a batch either in its folder or in
its days.  Folders of covered batches stay until the next compaction, for readers that have begun.  One
compaction runs at a time.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import schemas as S
from lorekeep.operators.analytics import add_up
from lorekeep.session import drop_folder
from lorekeep.sources import files

FACT, QUARANTINE, METRICS = "curated/fact_event", "curated/quarantined_events", "curated/event_metrics"
EVENT_DAYS, QUARANTINE_DAYS = "curated/event_days", "curated/quarantine_days"
FOLDED_METRICS, COVERED = "curated/folded_event_metrics", "curated/covered_batches"


def batches(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Batch numbers per feed that have a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/feed=*/batch_id=*")
    found: dict[str, list[int]] = {}
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        match = re.search(r"feed=([^/]+)/batch_id=(\d+)$", status.getPath().toString())
        if match:
            found.setdefault(match[1], []).append(int(match[2]))
    return {feed: sorted(numbers) for feed, numbers in found.items()}


class EventLog:
    """Events, rejects and partial metrics of a warehouse as of one snapshot: days, and the batches that
    no day has yet."""

    def __init__(self, now: files.Snapshot):
        self.now, self.spark = now, now.spark
        self.covered = {r["feed"]: r["upto"] for r in now.read(COVERED, S.COVERED_BATCHES, or_empty=True).collect()}  # a row per feed

    def open_batches(self, table: str) -> dict[str, list[int]]:
        found = batches(self.spark, f"{self.now.base}/{table}")
        return {feed: [n for n in numbers if n > self.covered.get(feed, -1)] for feed, numbers in found.items()}

    def days(self, prefix: str) -> list[str]:
        """The days that have a table, ascending."""
        return sorted(name.rsplit("/", 1)[1] for name in self.now.state if name.startswith(prefix + "/"))

    def events(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Events from ``first`` to ``last``; of the days only those are listed and read."""
        return self._rows(FACT, EVENT_DAYS, S.FACT_EVENT, F.col("event_date"), first, last)

    def rejects(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self._rows(QUARANTINE, QUARANTINE_DAYS, S.QUARANTINED_EVENT, F.to_date("quarantined_at"), first, last)

    def metrics(self) -> DataFrame:
        """Partial metrics of all events."""
        return self.now.read(FOLDED_METRICS, S.EVENT_METRICS, or_empty=True).unionByName(
            self.batch_rows(METRICS, S.EVENT_METRICS, self.open_batches(METRICS)))

    def batch_rows(self, table: str, schema: T.StructType, wanted: dict[str, list[int]], where: Column | None = None) -> DataFrame:
        """Rows of some batches; ``where`` may read the day that the folders of a batch are named after."""
        paths = [files.batch_path(f"{self.now.base}/{table}", feed, n) for feed, numbers in sorted(wanted.items()) for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.now.base}/{table}").parquet(*paths)
        return (rows if where is None else rows.where(where)).select(*schema.names)

    def _rows(self, table: str, prefix: str, schema: T.StructType, day: Column, first: date | None, last: date | None) -> DataFrame:
        inside = [d for d in self.days(prefix) if (not first or d >= first.isoformat()) and (not last or d <= last.isoformat())]
        where = day.between(F.lit(first or date.min), F.lit(last or date.max)) if first or last else None
        rows = self.batch_rows(table, schema, self.open_batches(table), where)
        paths = [f"{self.now.base}/{prefix}/{d}/{self.now.version(f'{prefix}/{d}')}" for d in inside]
        return rows.unionByName(self.spark.read.schema(schema).parquet(*paths)) if paths else rows


def _near(day: date) -> Column:
    """The folders of a batch that may hold events of ``day``, so that a day does not read all others.  They are
    named in the zone of the session that wrote them, which is less than two days off any other."""
    first, last = max(day.toordinal() - 2, 1), min(day.toordinal() + 2, date.max.toordinal())
    return F.col("event_date").between(F.lit(date.fromordinal(first)), F.lit(date.fromordinal(last)))


def compact(now: files.Snapshot) -> dict[str, int]:
    """Folds all closed batches; returns how many were folded and how many folders of earlier ones went."""
    log, spark, base = EventLog(now), now.spark, now.base
    dropped = 0
    for table in (FACT, QUARANTINE, METRICS):
        for feed, numbers in batches(spark, f"{base}/{table}").items():
            for n in numbers:
                if n <= log.covered.get(feed, -1):
                    drop_folder(spark, files.batch_path(f"{base}/{table}", feed, n))
                    dropped += 1
    # A batch is written to the fact first, so one that has a successor there is whole in all three.
    closed = {feed: numbers[:-1] for feed, numbers in log.open_batches(FACT).items() if len(numbers) > 1}
    if not closed:
        return {"folded": 0, "dropped": dropped}
    tables: dict[str, DataFrame] = {}
    for table, prefix, schema, day in (
        (FACT, EVENT_DAYS, S.FACT_EVENT, F.to_date("occurred_at")), (QUARANTINE, QUARANTINE_DAYS, S.QUARANTINED_EVENT, F.to_date("quarantined_at")),
    ):
        days = log.batch_rows(table, schema, closed).select(day.alias("_day")).distinct()
        for (d,) in days.collect():  # as many rows as the closed batches have days
            name = f"{prefix}/{d.isoformat()}"
            fresh = log.batch_rows(table, schema, closed, _near(d) if table == FACT else None).where(day == F.lit(d))
            tables[name] = now.read(name, schema).unionByName(fresh) if now.version(name) else fresh
    metrics = now.read(FOLDED_METRICS, S.EVENT_METRICS, or_empty=True).unionByName(log.batch_rows(METRICS, S.EVENT_METRICS, closed))
    covered = log.covered | {feed: numbers[-1] for feed, numbers in closed.items()}
    tables[FOLDED_METRICS] = add_up(metrics).select(*S.EVENT_METRICS.names)
    tables[COVERED] = spark.createDataFrame(sorted(covered.items()), S.COVERED_BATCHES)
    files.publish(tables, base)
    return {"folded": sum(map(len, closed.values())), "dropped": dropped}
