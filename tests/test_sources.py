"""File readers and writers, signals, embeddings."""

from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import embedding
from lorekeep.sources import files, streams


def test_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    path = tmp_path / "topics.csv"
    path.write_text('topic_id,topic_name,parent_category,description\n'
                    't1,"a, ""b""",C,"two\nlines"\nt2, spaced ,é,\n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_csv(spark, str(path), S.RAW_TOPICS).collect()]
    assert rows == [("t1", 'a, "b"', "C", "two\nlines"), ("t2", " spaced ", "é", "")]


def test_csv_columns_are_read_by_header(spark, tmp_path):
    path = tmp_path / "sources.csv"
    path.write_text("source_id,source_name,source_type,url,source_status\n1,n,t,u,ACTIVE\n")
    assert files.read_csv(spark, str(path), S.RAW_SOURCES).first()["source_status"] == "ACTIVE"


def test_cast_on_load_fails_on_text(spark):
    assert files.cast_on_load(spark.createDataFrame([("1",)], "v string"), ["v"]).first()["v"] == 1
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(PySparkException):
        files.cast_on_load(df, ["v"]).collect()


def test_benchmark_array(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text('[{"id":"a","question":"q","style":"lexical","type":"grounded","expected_knowledge_ids":["k1","k2"]},'
                    '{"id":"b","question":"r","style":"semantic","type":"governance_reject","expected_knowledge_ids":[],'
                    '"excluded_knowledge_id":"k3","excluded_reason":"stale"}]')
    rows = files.read_benchmark(spark, str(path)).collect()
    assert [(r["id"], r["expected_knowledge_ids"], r["excluded_knowledge_id"]) for r in rows] == [
        ("a", ["k1", "k2"], None), ("b", [], "k3")]


def test_topic_filter_reaches_the_scan(spark, tmp_path):
    rows = [("k1", "t1", "a", "b", "x"), ("k2", "t2", "a", "b", "x")]
    spark.createDataFrame(rows, "knowledge_id string, topic_id string, title string, summary string, other string") \
        .write.parquet(f"{tmp_path}/e")
    corpus = files.lexical_corpus(spark.read.parquet(f"{tmp_path}/e"), "t1")
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic_id,t1)" in plan and "other" not in plan
    assert [r["knowledge_id"] for r in corpus.collect()] == ["k1"]
    assert files.lexical_corpus(spark.read.parquet(f"{tmp_path}/e"), "").count() == 2


def test_file_signal_without_size(spark):
    notes = spark.createDataFrame([("b", "n", None, None, None), ("b", "m", "text/csv", "12", "t")], S.FILE_NOTIFICATION)
    assert [tuple(r) for r in files.file_signals(notes).collect()] == [
        ("RAW_FILE_ARRIVED", "b", "n", None, None, None), ("RAW_FILE_ARRIVED", "b", "m", "text/csv", 12, "t")]


def test_arriving_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("12345")
    signals = files.file_signals(streams.arriving_files(spark, f"{tmp_path}/in"))
    query = (signals.writeStream.format("memory").queryName("signals").trigger(availableNow=True).start())
    query.awaitTermination()
    row = spark.table("signals").first()
    assert (row["event_type"], row["object_name"], row["size_bytes"]) == ("RAW_FILE_ARRIVED", "a.csv", 5)


def test_run_id_format():
    assert files.new_run_id(datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)) == "20260102T030405Z"


def test_param_query_binds_values_not_text(spark):
    df = spark.createDataFrame([("a' or '1'='1", 1), ("b", 2)], "k string, v int")
    out = files.param_query(spark, "select v from {t} where k = :k", {"k": "a' or '1'='1"}, t=df)
    assert [r["v"] for r in out.collect()] == [1]


def test_index_embeds_the_summary_of_every_eligible_row(spark):
    rows = [("k1", "t", "x", "red fish"), ("k2", "t", "y", "red fish"), ("k3", "t", "z", "")]
    eligible = spark.createDataFrame(rows, S.AGENT_ELIGIBLE)
    index = embedding.build_index(eligible, F.lit("2026-01-01").cast("timestamp")).orderBy("knowledge_id").collect()
    assert index[0]["embedding"] == index[1]["embedding"] != index[2]["embedding"]
    assert index[0]["embedding_model"] == "hashed-words" and index[0]["embedded_at"] is not None
    custom = embedding.build_index(eligible, F.current_timestamp(), lambda texts: [[float(len(t))] for t in texts], "len")
    assert sorted(r["embedding"] for r in custom.collect()) == [[0.0], [8.0], [8.0]]
    with pytest.raises(ValueError):
        embedding.build_index(eligible.limit(0), F.current_timestamp())


def test_scratch_scope_holds_and_frees_its_tables(spark):
    from lorekeep import session

    outer = session.staged(spark.range(3), "outer")
    with session.scratch_scope(spark, "step") as folder:
        inner = session.staged(spark.range(4), "inner")
        with session.scratch_scope(spark, "part") as nested:
            assert nested.startswith(folder + "/")
    after = session.staged(spark.range(5), "after")
    assert all(folder in f for f in inner.inputFiles())
    assert not any(folder in f for f in [*outer.inputFiles(), *after.inputFiles()])
    assert inner.count() == 4
    session.drop_folder(spark, folder)
    assert outer.count() == 3 and after.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(folder)
