"""The jobs end to end on a small delivery, as a user would run them."""

import csv
import json

import pytest

from lorekeep import schemas as S
from lorekeep.__main__ import parser, run
from lorekeep.plans import jobs
from lorekeep.sources import files

TOPICS = [["topic_id", "topic_name", "parent_category", "description"],
          ["birds", "Birds", "Nature", ""], ["fish", "Fish", "Nature", "in, water"], ["stars", "Stars", "Sky", ""]]
SOURCES = [["source_id", "source_name", "source_type", "url", "source_status"],
           ["s1", "First", "journal", "https://example.org/1", "ACTIVE"],
           ["s2", "Second", "site", "https://example.org/2", "INACTIVE"]]
KNOWLEDGE = [["knowledge_id", "topic_id", "source_id", "title", "summary", "review_status", "content_status",
              "published_date", "last_reviewed_date", "content_version"]] + [
    [f"k{i}", topic, source, title, text, review, "CURRENT", "2025-01-01", "2025-06-01", "1"]
    for i, (topic, source, title, text, review) in enumerate([
        ("birds", "s1", "Owls", "owls hunt at night and fly\nwithout a sound", "APPROVED"),
        ("birds", "s1", "Swifts", "swifts sleep on the wing", "APPROVED"),
        ("fish", "s1", "Eels", "eels travel far to spawn in the sea", "APPROVED"),
        ("fish", "s2", "Carp", "carp like slow water", "APPROVED"),
        ("stars", "s1", "Dwarfs", "white dwarfs cool for ages", "EXPIRED"),
    ])]
REVIEWS = [["review_id", "knowledge_id", "reviewer_role", "review_date", "review_status", "notes"]] + [
    [f"r{i}", f"k{i}", "editor", "2025-06-01", "APPROVED", ""] for i in range(5)]


def deliver(folder, **tables):
    folder.mkdir()
    for name, rows in {"topics": TOPICS, "sources": SOURCES, "knowledge": KNOWLEDGE, "reviews": REVIEWS, **tables}.items():
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows(rows)
    return str(folder)


@pytest.fixture
def job(spark, tmp_path):
    def call(command, *options):
        return run(parser().parse_args([command, "--warehouse", f"{tmp_path}/lake", *options]), spark)

    return call


def test_from_delivery_to_evaluation(spark, tmp_path, job, capsys):
    lake = f"{tmp_path}/lake"
    assert job("load", "--feeds", deliver(tmp_path / "feeds")) == 0
    assert "ai_eligible preview: 3/5" in capsys.readouterr().out
    assert job("refresh", "--quarantine", f"{tmp_path}/q", "--run-id", "r1") == 0
    eligible = files.read_table(spark, lake, "semantic/agent_eligible_knowledge")
    assert sorted(r["knowledge_id"] for r in eligible.collect()) == ["k0", "k1", "k2"]
    assert "\n" in eligible.where("knowledge_id = 'k0'").first()["summary"]
    assert spark.read.text(f"{tmp_path}/q/r1/quarantine").count() == 0
    assert job("index") == 0

    (tmp_path / "q.jsonl").write_text('{"query_id":"a","question":"owls at night"}\n{"query_id":"b","question":"eels"}\n')
    assert job("search", "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/answers", "--top-n", "2") == 0
    answers = {(r["query_id"], r["rank"]): r["knowledge_id"] for r in spark.read.json(f"{tmp_path}/answers").collect()}
    assert answers[("a", 1)] == "k0" and answers[("b", 1)] == "k2" and len(answers) == 4
    assert job("search", "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/fish", "--topic", "fish") == 0
    assert {r["knowledge_id"] for r in spark.read.json(f"{tmp_path}/fish").collect()} == {"k2"}

    # A review expires after indexing: the index still holds the row, the answer does not.
    changed = [r[:5] + ["EXPIRED"] + r[6:] if r[0] == "k0" else r for r in KNOWLEDGE]
    assert job("load", "--feeds", deliver(tmp_path / "feeds2", knowledge=changed)) == 0
    assert job("refresh", "--quarantine", f"{tmp_path}/q") == 0
    cases = [
        {"id": "c1", "question": "where do eels spawn", "style": "semantic", "type": "grounded", "expected_knowledge_ids": ["k2"]},
        {"id": "c2", "question": "owls at night", "style": "lexical", "type": "governance_reject", "expected_knowledge_ids": [],
         "excluded_knowledge_id": "k0", "excluded_reason": "expired"},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert job("evaluate", "--benchmark", f"{tmp_path}/cases.json", "--out", f"{tmp_path}/eval") == 0
    results = {r["id"]: r for r in spark.read.json(f"{tmp_path}/eval/cases").collect()}
    assert set(results) == {"c1", "c2"} and results["c1"]["type"] == "grounded"
    assert spark.read.json(f"{tmp_path}/eval/summary").count() > 0 and spark.read.json(f"{tmp_path}/eval/rejections").count() == 1


def test_bad_delivery_is_refused_and_changes_nothing(spark, tmp_path, job, capsys):
    bad = [TOPICS[0], TOPICS[1], TOPICS[1]]
    assert job("load", "--feeds", deliver(tmp_path / "feeds", topics=bad)) == 1
    assert "duplicate topic_id 'birds'" in capsys.readouterr().out
    assert [p.name for p in (tmp_path / "lake").iterdir()] == ["rejected"]


def test_every_error_of_a_delivery_is_kept(spark, tmp_path, job, capsys):
    many = [KNOWLEDGE[0]] + [[f"n{i}", *KNOWLEDGE[1][1:4], "", *KNOWLEDGE[1][5:9], "v1" if i == 7 else "2"] for i in range(40)]
    (tmp_path / "rules.json").write_text("{ broken")
    assert job("load", "--feeds", deliver(tmp_path / "feeds", knowledge=many, reviews=REVIEWS[:1]), "--rules", f"{tmp_path}/rules.json") == 1
    assert "42 errors" in capsys.readouterr().out
    (report,) = (tmp_path / "lake" / "rejected").glob("*/errors")
    kept = spark.read.json(str(report))
    assert kept.count() == 42 and kept.where("error like 'content_version is not%' and id = 'n7'").count() == 1
    assert kept.where("`table` = 'rules'").count() == 1


def test_a_failed_write_leaves_published_tables_alone(spark, tmp_path, job):
    from pyspark.errors import PySparkException

    lake = f"{tmp_path}/lake"
    old = spark.createDataFrame([("a", 1)], "k string, v long")
    files.publish({"raw/one": old, "raw/two": old}, lake)
    broken = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(PySparkException):
        files.publish({"raw/one": old.union(old), "raw/two": files.cast_on_load(broken, ["v"])}, lake)
    assert files.read_table(spark, lake, "raw/one").count() == 1 and files.read_table(spark, lake, "raw/two").count() == 1
    for n in (2, 3, 4):
        files.publish({"raw/one": spark.range(n)}, lake)
    assert files.read_table(spark, lake, "raw/one").count() == 4 and files.read_table(spark, lake, "raw/two").count() == 1
    assert sum(p.is_dir() for p in (tmp_path / "lake" / "raw" / "one").iterdir()) <= 3

    assert job("load", "--feeds", deliver(tmp_path / "feeds")) == 0 and job("refresh", "--quarantine", f"{tmp_path}/q") == 0
    jobs.index(spark, lake)
    before = files.read_table(spark, lake, "semantic/knowledge_embeddings", S.EMBEDDINGS).count()

    def failing(batches):
        raise RuntimeError("model is away")
        yield

    with pytest.raises(Exception):  # noqa: B017  whatever the embedder raises
        jobs.index(spark, lake, failing)
    assert files.read_table(spark, lake, "semantic/knowledge_embeddings", S.EMBEDDINGS).count() == before > 0


def test_analytics_before_the_first_event(spark, tmp_path, job):
    assert job("analytics") == 0
    metrics = files.read_table(spark, f"{tmp_path}/lake", "semantic/question_analytics")
    assert metrics.count() > 0 and metrics.where("metric_value <> 0").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("broken\n")
    assert job("stream", "--input", f"{tmp_path}/in", "--available-now") == 0 and job("analytics") == 0


def test_more_answers_than_the_default(spark, tmp_path, job):
    many = [KNOWLEDGE[0]] + [[f"n{i}", *KNOWLEDGE[1][1:3], f"Title {i}", f"owls number {i}", *KNOWLEDGE[1][5:]] for i in range(60)]
    assert job("load", "--feeds", deliver(tmp_path / "feeds", knowledge=many, reviews=REVIEWS[:1])) == 0
    assert job("refresh", "--quarantine", f"{tmp_path}/q") == 0 and job("index") == 0
    (tmp_path / "q.jsonl").write_text('{"query_id":"a","question":"owls"}\n{"query_id":"a","question":"number 7"}\n')
    assert job("search", "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/out", "--top-n", "30") == 0
    assert spark.read.json(f"{tmp_path}/out").count() == 30
    with pytest.raises(ValueError):
        job("search", "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/out2", "--top-n", "30", "--fetch-n", "10")


def test_nothing_to_index(spark, tmp_path, job):
    none = [KNOWLEDGE[0], KNOWLEDGE[5]]
    assert job("load", "--feeds", deliver(tmp_path / "feeds", knowledge=none, reviews=REVIEWS[:1])) == 0
    assert job("refresh", "--quarantine", f"{tmp_path}/q") == 0
    assert job("index") == 1


def test_stream_and_analytics(spark, tmp_path, job):
    (tmp_path / "in").mkdir()
    event = {"event_id": "e", "event_type": "SOURCE_OPENED", "session_id": "s", "topic_id": "fish", "occurred_at": "2026-01-01T00:00:00Z"}
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps(event), json.dumps({**event, "rating": "?"})]) + "\n")
    assert job("stream", "--input", f"{tmp_path}/in", "--available-now") == 0
    assert job("analytics") == 0
    metrics = files.read_table(spark, f"{tmp_path}/lake", "semantic/question_analytics")
    assert metrics.count() == 9 and metrics.select("computed_at").distinct().count() == 1
    assert metrics.where("dimension = 'fish' and metric_name = 'source_open_count'").first()["metric_value"] == 1.0
    assert spark.read.parquet(f"{tmp_path}/lake/curated/quarantined_events").first()["reason"] == "invalid rating '?'"
