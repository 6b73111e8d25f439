"""Snapshots, checkpoints of the log, and what failed runs leave."""

import os

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.plans import jobs
from lorekeep.sources import files


def value(spark, n):
    return spark.range(1).select(F.lit(n).alias("v"))


def read(now, name="a/t"):
    return now.read(name).first()["v"]


def test_a_job_sees_one_state(spark, tmp_path):
    base = str(tmp_path)
    files.publish({"a/t": value(spark, 1), "a/u": value(spark, 1)}, base)
    now = files.snapshot(spark, base)
    assert read(now) == 1
    files.publish({"a/t": value(spark, 2), "a/u": value(spark, 2)}, base)
    assert read(now, "a/u") == 1 and read(now) == 1  # published between the two reads
    assert read(files.snapshot(spark, base), "a/u") == 2 and files.read_table(spark, base, "a/t").first()["v"] == 2


def test_search_reads_one_state(spark, tmp_path, monkeypatch):
    """The index is published anew between a search's reads; the search keeps to what it began with."""
    base, rows = str(tmp_path), [(f"k{i}", "t", f"Title {i}", f"owls number {i}") for i in range(8)]
    files.publish({jobs.ELIGIBLE: spark.createDataFrame(rows, S.AGENT_ELIGIBLE)}, base)
    jobs.index(spark, base)
    asked = spark.createDataFrame([("q", "owls number 7")], "query_id string, question string")
    stored = jobs.stored_words

    def meanwhile(now):
        files.publish({jobs.ELIGIBLE: spark.createDataFrame(rows[:2], S.AGENT_ELIGIBLE)}, base)
        return stored(now)

    monkeypatch.setattr(jobs, "stored_words", meanwhile)
    assert stored(files.snapshot(spark, base)) is not None
    got = jobs.search(spark, base, asked, top_n=3)
    assert got.where("rank = 1").first()["knowledge_id"] == "k7"
    assert stored(files.snapshot(spark, base)) is None  # built from knowledge that is not current any more


def test_the_log_stays_short_and_the_state_right(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHECKPOINT_EVERY", 4)
    base = str(tmp_path)
    for n in range(11):
        files.publish({f"a/{'tu'[n % 2]}": value(spark, n)}, base)
    now = files.snapshot(spark, base)
    assert (read(now, "a/t"), read(now, "a/u")) == (10, 9)
    assert len(files._entries(spark, base)) < 4
    assert sum(e.is_dir() for e in os.scandir(tmp_path / "a" / "t")) == 2


def test_a_publication_during_a_checkpoint_is_kept(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    files.publish({"a/t": value(spark, 1)}, base)
    files.publish({"a/t": value(spark, 2)}, base)
    log = files._log

    def slow(spark_, base_, entry):
        if entry["state"] is not None:
            monkeypatch.setattr(files, "_log", log)
            files.publish({"a/t": value(spark, 3), "a/u": value(spark, 3)}, base)
        log(spark_, base_, entry)

    monkeypatch.setattr(files, "_log", slow)
    files.checkpoint(spark, base)
    now = files.snapshot(spark, base)
    assert (read(now), read(now, "a/u")) == (3, 3)
    # A checkpoint whose old files are still there counts nothing twice.
    assert now.state["a/t"] == sorted(now.state["a/t"]) and len(now.state["a/t"]) == 2


def test_a_late_publication_does_not_hide_a_newer_one(spark, tmp_path):
    """Publications end in another order than they began: the one that began last is current."""
    base, early = str(tmp_path), files.new_version()
    files.publish({"a/t": value(spark, 2)}, base)
    value(spark, 1).write.parquet(f"{base}/a/t/{early}")
    files._log(spark, base, files.Row(version=early, tables=["a/t"], state=None, folded=None))
    assert read(files.snapshot(spark, base)) == 2


def test_orphans_go_and_named_versions_stay(spark, tmp_path):
    base = str(tmp_path)
    files.publish({"a/t": value(spark, 1)}, base)
    refused = value(spark, 1).select(F.raise_error(F.lit("no")).alias("v"))
    with pytest.raises(PySparkException):
        files.publish({"a/t": value(spark, 2), "b/w/x": refused}, base)
    value(spark, 9).write.parquet(f"{base}/a/t/plain")
    assert files.remove_orphans(spark, base) == []  # may still be written
    gone = files.remove_orphans(spark, base, older_than_seconds=0)
    assert any(g.startswith("a/t/") for g in gone) and read(files.snapshot(spark, base)) == 1
    assert (tmp_path / "a" / "t" / "plain").exists()


def test_only_an_absent_table_reads_as_empty(spark, tmp_path):
    base = str(tmp_path)
    assert files.read_table(spark, base, "a/none", S.AGENT_ELIGIBLE, or_empty=True).count() == 0
    with pytest.raises(AnalysisException):
        files.read_table(spark, base, "a/none", S.AGENT_ELIGIBLE)
    (tmp_path / "a").mkdir()
    with pytest.raises(AnalysisException):  # no schema to be empty with
        files.read_table(spark, base, "a/none", or_empty=True)


def test_partitioned_tables(spark, tmp_path):
    files.publish({"a/t": spark.range(6).selectExpr("id", "id % 3 AS part")}, str(tmp_path), {"a/t": ["part"]})
    assert files.read_table(spark, str(tmp_path), "a/t").where("part = 1").count() == 2
    assert len(list(tmp_path.glob("a/t/*/part=*"))) == 3
