"""Rules, duplicates, enrichment and the whole refresh on hand-made rows."""

import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.governance import ai_eligible
from lorekeep.functions.iso import integer, iso_date, iso_timestamp, number
from lorekeep.operators import curate, quality, seed_gate
from lorekeep.plans.refresh import Refresh
from lorekeep.sources import files

TOPIC = {"topic_id": "t1", "topic_name": "Topic one", "parent_category": "A", "description": ""}
SOURCE = {"source_id": "s1", "source_name": "Source one", "source_type": "journal",
          "url": "https://example.org/1", "source_status": "ACTIVE"}
KNOWLEDGE = {"knowledge_id": "k1", "topic_id": "t1", "source_id": "s1", "title": "Tides", "summary": "The moon pulls the sea twice a day",
             "review_status": "APPROVED", "content_status": "CURRENT", "published_date": "2023-03-17",
             "last_reviewed_date": "2024-11-05", "content_version": "4"}
REVIEW = {"review_id": "r1", "knowledge_id": "k1", "reviewer_role": "geologist", "review_date": "2024-10-30",
          "review_status": "APPROVED", "notes": None}


def frame(spark, schema, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def topics(spark, *rows):
    return frame(spark, S.RAW_TOPICS, *rows)


def sources(spark, *rows):
    return frame(spark, S.RAW_SOURCES, *rows)


def knowledge(spark, *rows):
    return frame(spark, S.RAW_KNOWLEDGE, *rows)


def reviews(spark, *rows):
    return frame(spark, S.RAW_REVIEWS, *rows)


def reasons(checked, key):
    return {r[key]: r["reason"] for r in checked.collect()}


def check_one(spark, **changed):
    row = {**KNOWLEDGE, **changed}
    return curate.check_knowledge(knowledge(spark, row), topics(spark, TOPIC), sources(spark, SOURCE)).first()


def test_valid_rows_have_no_reason(spark):
    assert reasons(curate.check_topics(topics(spark, TOPIC)), "topic_id") == {"t1": None}
    assert reasons(curate.check_sources(sources(spark, SOURCE)), "source_id") == {"s1": None}
    assert check_one(spark)["reason"] is None


def test_missing_fields_are_listed_in_order(spark):
    bad = {**TOPIC, "topic_name": " \t", "parent_category": None}
    assert reasons(curate.check_topics(topics(spark, bad)), "topic_id") == {
        "t1": "missing required fields: ['topic_name', 'parent_category']"}


def test_unicode_space_counts_as_blank(spark):
    assert "topic_name" in curate.check_topics(topics(spark, {**TOPIC, "topic_name": "  \x1c"})).first()["reason"]


@pytest.mark.parametrize("change, reason", [
    ({"source_status": "WITHDRAWN"}, "invalid source_status 'WITHDRAWN'"),
    ({"url": "http://example.org"}, "url is not https: 'http://example.org'"),
    ({"url": "HTTPS://example.org"}, "url is not https: 'HTTPS://example.org'"),
    ({"source_status": "X", "url": "ftp://x"}, "invalid source_status 'X'"),
])
def test_source_rules(spark, change, reason):
    assert curate.check_sources(sources(spark, {**SOURCE, **change})).first()["reason"] == reason


@pytest.mark.parametrize("change, reason", [
    ({"topic_id": "nope"}, "unknown topic_id 'nope'"),
    ({"source_id": "nope"}, "unknown source_id 'nope'"),
    ({"topic_id": "nope", "source_id": "nope", "review_status": "?"}, "unknown topic_id 'nope'"),
    ({"review_status": "MAYBE"}, "invalid review_status 'MAYBE'"),
    ({"content_status": "OLD"}, "invalid content_status 'OLD'"),
    ({"published_date": "2025-1-1"}, "unparseable published_date '2025-1-1'"),
    ({"last_reviewed_date": "2025-02-30"}, "unparseable last_reviewed_date '2025-02-30'"),
    ({"content_version": "v1"}, "invalid content_version 'v1'"),
    ({"summary": ""}, "missing required fields: ['summary']"),
])
def test_knowledge_rules(spark, change, reason):
    assert check_one(spark, **change)["reason"] == reason


def test_eligibility_truth_table(spark):
    rows = [(r, s, c) for r in S.REVIEW_STATUSES for s in S.SOURCE_STATUSES for c in S.CONTENT_STATUSES]
    flag = ai_eligible(F.col("r"), F.col("s"), F.col("c")).alias("e")
    got = spark.createDataFrame(rows, "r string, s string, c string").select("r", "s", "c", flag).collect()
    assert [tuple(x)[:3] for x in got if x["e"]] == [("APPROVED", "ACTIVE", "CURRENT")]


def test_every_copy_of_a_repeated_id_is_rejected(spark, either_join):
    rows = knowledge(spark, KNOWLEDGE, {**KNOWLEDGE, "title": "Other"}, {**KNOWLEDGE, "knowledge_id": "k2"})
    marked = quality.annotate_duplicates(rows, "knowledge_id").collect()
    assert sorted((r["knowledge_id"], r["duplicate_reason"]) for r in marked if r["duplicate_reason"]) == [
        ("k1", "duplicate id: 2 rows share this identifier")] * 2
    assert len(marked) == 3


def test_null_ids_form_one_group(spark, either_join):
    rows = topics(spark, {**TOPIC, "topic_id": None}, {**TOPIC, "topic_id": None}, {**TOPIC, "topic_id": ""}, TOPIC)
    marked = quality.annotate_duplicates(rows, "topic_id").collect()
    assert {(r["topic_id"], r["duplicate_reason"] is not None) for r in marked} == {(None, True), ("", False), ("t1", False)}


def test_a_hot_repeated_id_stays_whole(spark, either_join):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    marked = quality.annotate_duplicates(rows, "k")
    got = marked.groupBy(F.col("duplicate_reason").isNotNull().alias("dup")).count().collect()
    assert {r["dup"]: r["count"] for r in got} == {True: 6667, False: 13333}


def test_dates_and_numbers(spark):
    texts = ["2026-01-02", "20260102", "2026-W05-3", "2026W05", "2020-W53-7", "2026", "2026-1-2", "2026-02-30",
             "2026-W54-1", "0000-01-01", "", "12:00"]
    expected = []
    for text in texts:
        try:
            expected.append(date.fromisoformat(text))
        except ValueError:
            expected.append(None)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(iso_date(F.col("t"))).collect()] == expected
    values = spark.createDataFrame([("1", "1.5"), (" +2 ", "1e3"), ("1.0", "1f"), ("x", "NaN")], "i string, n string")
    assert [tuple(r) for r in values.select(integer(F.col("i")), number(F.col("n"))).collect()] == [
        (1, 1.5), (2, 1000.0), (None, None), (None, None)]
    stamps = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02",), ("12:00",), ("2026-01-02T25:00",)], "t string")
    assert [r[0] is not None for r in stamps.select(iso_timestamp(F.col("t"))).collect()] == [True, True, False, False]


def test_plain_timestamps_are_cast_as_they_would_be_taken_apart(spark):
    texts = [f"{day}T{clock}{zone}" for day in ("2026-01-02", "2026-02-30", "0000-01-01", "9999-12-31") for zone in ("", "Z")
             for clock in ("03:04:05", "23:59:59.9", "03:04:05.123456", "24:00:00", "23:59:60", "03:60:00")]
    texts += ["2026-01-02 03:04:05\n", "2026-01-02 03:04:05.1234567", "2026-01-02 03:04:05 "]
    df = spark.createDataFrame([(t, t[:10] + "_" + t[11:]) for t in texts], "plain string, apart string")  # any separator may stand there
    got = df.select(iso_timestamp(F.col("plain")).alias("p"), iso_timestamp(F.col("apart")).alias("a")).collect()
    assert [r["p"] for r in got] == [r["a"] for r in got] and sum(r["p"] is not None for r in got) >= 12


def test_plain_timestamps_are_not_taken_apart(spark):
    def seconds(separator):
        text = F.concat(F.lit(f"2026-01-02{separator}03:04:05."), F.lpad(F.col("id").cast("string"), 6, "0"))
        begun = time.monotonic()
        spark.range(0, 40_000, 1, 4).select(iso_timestamp(text).alias("t")).agg(F.count("t")).collect()
        return time.monotonic() - begun

    seconds("T")
    assert 2 * seconds("T") < seconds("_")


def test_native_dates_are_accepted(spark):
    row = knowledge(spark, KNOWLEDGE).withColumn("published_date", F.col("published_date").cast("date"))
    assert curate.check_knowledge(row, topics(spark, TOPIC), sources(spark, SOURCE)).first()["reason"] is None


def small_refresh(spark):
    return Refresh(
        topics(spark, TOPIC, {**TOPIC, "topic_id": "t2", "topic_name": ""}, {**TOPIC, "topic_id": "t3"}, {**TOPIC, "topic_id": "t3"}),
        sources(spark, SOURCE, {**SOURCE, "source_id": "s2", "source_status": "INACTIVE"}),
        knowledge(
            spark, KNOWLEDGE, {**KNOWLEDGE, "knowledge_id": "k2", "topic_id": "t2"},
            {**KNOWLEDGE, "knowledge_id": "k3", "topic_id": "t3"}, {**KNOWLEDGE, "knowledge_id": "k4", "source_id": "s2"},
            {**KNOWLEDGE, "knowledge_id": "k5", "content_status": "STALE"},
            {**KNOWLEDGE, "knowledge_id": "k6", "review_status": "EXPIRED"},
        ),
        reviews(
            spark, REVIEW, {**REVIEW, "review_id": "r2", "knowledge_id": "k2"},
            {**REVIEW, "review_id": "r4", "knowledge_id": "k4"}, {**REVIEW, "review_id": "r5", "review_date": "June"},
        ),
    )


def test_rejection_cascades_to_children(spark, either_join):
    run = small_refresh(spark)
    assert reasons(run.checked_knowledge, "knowledge_id") == {
        "k1": None, "k2": "unknown topic_id 't2'", "k3": "unknown topic_id 't3'", "k4": None, "k5": None, "k6": None}
    # k2 is rejected, so its review is; k4 is merely ineligible, so its review stands.
    assert reasons(run.checked_reviews, "review_id") == {
        "r1": None, "r2": "unknown knowledge_id 'k2'", "r4": None, "r5": "unparseable review_date 'June'"}


def test_refresh_publishes_all_tables(spark, tmp_path, either_join):
    run_id = small_refresh(spark).run(f"{tmp_path}/wh", f"{tmp_path}/q", "20260101T000000Z")
    assert run_id == "20260101T000000Z"

    def read(name, schema):
        return files.read_table(spark, f"{tmp_path}/wh", name, schema)

    catalog = read("semantic/knowledge_catalog", S.CATALOG)
    assert sorted(r["knowledge_id"] for r in catalog.collect()) == ["k1", "k4", "k5", "k6"]
    assert sorted(r["knowledge_id"] for r in read("semantic/approved_knowledge", S.CATALOG).collect()) == ["k1", "k4", "k5"]
    assert [tuple(r) for r in read("semantic/agent_eligible_knowledge", S.AGENT_ELIGIBLE).collect()] == [
        ("k1", "t1", KNOWLEDGE["title"], KNOWLEDGE["summary"])]
    assert [tuple(r) for r in read("semantic/topic_knowledge_summary", S.TOPIC_SUMMARY).collect()] == [
        ("t1", "Topic one", 4, 1, 3, 0, 1, 1)]
    assert read("curated/dim_knowledge", S.DIM_KNOWLEDGE).first()["published_date"] == date(2023, 3, 17)
    assert read("curated/fact_review", S.FACT_REVIEW).count() == 2
    assert read("curated/dim_topic", S.DIM_TOPIC).count() == 1
    assert read("curated/dim_source", S.DIM_SOURCE).count() == 2
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/q/{run_id}/quarantine").collect()]
    assert sorted(x["table"] for x in lines) == ["raw_knowledge"] * 2 + ["raw_reviews"] * 2 + ["raw_topics"] * 3
    assert all(set(x) == {"table", "reason", "row"} and isinstance(x["row"], dict) for x in lines)
    assert {x["row"].get("notes", "absent") for x in lines if x["table"] == "raw_reviews"} == {None}


def test_a_second_run_replaces_the_first(spark, tmp_path):
    small_refresh(spark).run(f"{tmp_path}/wh", f"{tmp_path}/q")
    small_refresh(spark).run(f"{tmp_path}/wh", f"{tmp_path}/q2")
    assert files.read_table(spark, f"{tmp_path}/wh", "semantic/knowledge_catalog").count() == 4


def test_client_rules(spark):
    rows = [("SOURCE_OPENED", "s", None), ("QUESTION_ASKED", "s", None), ("FEEDBACK_SUBMITTED", "s", "neither"),
            ("FEEDBACK_SUBMITTED", "", "up"), ("SOURCE_OPENED", None, None)]
    df = spark.createDataFrame(rows, "event_type string, session_id string, rating string")
    got = [r["reason"] for r in quality.annotate(df, quality.client_event_rules()).collect()]
    assert [g is None for g in got] == [True, False, False, True, False]


# ---- the pre-load gate -------------------------------------------------------------------------

def test_gate_collects_every_error(spark, either_join):
    errors = seed_gate.all_errors(
        topics(spark, TOPIC, TOPIC, TOPIC),
        sources(spark, {**SOURCE, "source_status": "X", "url": "http://x"}),
        knowledge(spark, {**KNOWLEDGE, "topic_id": "no", "review_status": "?", "published_date": "never", "summary": " "}),
        reviews(spark, {**REVIEW, "knowledge_id": "no", "review_status": "?"}),
    )
    assert sorted((r["table"], r["id"], r["error"]) for r in errors.collect()) == sorted([
        ("topics", "t1", "duplicate topic_id 't1'"), ("topics", "t1", "duplicate topic_id 't1'"),
        ("sources", "s1", "invalid source_status 'X'"), ("sources", "s1", "url is not https 'http://x'"),
        ("knowledge", "k1", "unknown topic_id 'no'"), ("knowledge", "k1", "invalid review_status '?'"),
        ("knowledge", "k1", "unparseable published_date 'never'"), ("knowledge", "k1", "empty summary"),
        ("reviews", "r1", "unknown knowledge_id 'no'"), ("reviews", "r1", "invalid review_status '?'"),
    ])
    with pytest.raises(seed_gate.DeliveryRejected, match="refusing to load"):
        seed_gate.abort_on_errors(errors)


def test_gate_checks_keys_against_rows_as_delivered(spark):
    """A parent with its own errors still counts as present here (unlike in the refresh)."""
    errors = seed_gate.all_errors(
        topics(spark, {**TOPIC, "topic_name": ""}), sources(spark, SOURCE), knowledge(spark, KNOWLEDGE), reviews(spark, REVIEW))
    assert errors.count() == 0
    seed_gate.abort_on_errors(errors)


def test_repeats_of_a_hot_key_unfold_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(seed_gate, "REPEAT_CHUNK", 100)
    rows = spark.range(2500).select(F.lit("hot").alias("topic_id"))
    assert seed_gate.repeats(rows, "topics", "topic_id").count() == 2499


def test_warnings(spark):
    got = [r[0] for r in seed_gate.warnings(knowledge(spark, KNOWLEDGE), sources(spark, SOURCE)).collect()]
    assert got == ["knowledge has 1 records, expected 30-50", "ai_eligible preview: 1/1 records"]
    many = knowledge(spark, *[{**KNOWLEDGE, "knowledge_id": f"k{i}"} for i in range(38)])
    assert [r[0] for r in seed_gate.warnings(many, sources(spark, SOURCE)).collect()] == ["ai_eligible preview: 38/38 records"]


def test_rules_file(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{\n "rules": []\n}')
    bad.write_text("{not json")
    assert seed_gate.rules_file_errors(spark, str(good)).count() == 0
    assert seed_gate.rules_file_errors(spark, str(bad)).count() == 1
    assert seed_gate.rules_file_errors(spark, str(tmp_path / "none.json")).count() == 1


def test_ledger_counts_every_key_once(spark, either_join):
    topics = spark.createDataFrame([("t1",), ("t1",), ("t2",), (None,)], "topic_id string")
    sources = spark.createDataFrame([("s1",)], "source_id string")
    knowledge_ = spark.createDataFrame([("k1", "t1", "s1"), ("k2", "t9", "s1"), ("k2", None, "s2")], "knowledge_id string, topic_id string, source_id string")
    reviews = spark.createDataFrame([("r1", "k1"), ("r2", "k9")], "review_id string, knowledge_id string")
    got = {(r["table"], r["key"]): (r["ids"], r["refs"]) for r in seed_gate.key_ledger(topics=topics, sources=sources, knowledge=knowledge_, reviews=reviews).collect()}
    assert got == {
        ("topics", "t1"): (2, 1), ("topics", "t2"): (1, 0), ("topics", None): (1, 1), ("topics", "t9"): (0, 1),
        ("sources", "s1"): (1, 2), ("sources", "s2"): (0, 1), ("knowledge", "k1"): (1, 1), ("knowledge", "k2"): (2, 0),
        ("knowledge", "k9"): (0, 1), ("reviews", "r1"): (1, 0), ("reviews", "r2"): (1, 0)}
    plan = seed_gate.uniqueness_errors(topics, sources, knowledge_, reviews)
    assert sorted((r["table"], r["id"], r["error"]) for r in plan.collect()) == [
        ("knowledge", "k2", "duplicate knowledge_id 'k2'"), ("topics", "t1", "duplicate topic_id 't1'")]
