"""Events in batch and stream, metrics, reports and traces."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import analytics, reports, traces
from lorekeep.sources import streams
from lorekeep.sources.files import write_events
from lorekeep.streaming import events

EVENT = {"event_id": "e1", "event_type": "QUESTION_ASKED", "session_id": "s", "occurred_at": "2026-01-02T03:04:05+00:00"}


def messages(spark, *bodies):
    raw = [b if isinstance(b, bytes) else json.dumps(b).encode() for b in bodies]
    return spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, value binary")


def reason(spark, body):
    return events.annotate_events(messages(spark, body)).first()["reason"]


@pytest.mark.parametrize("body, expected", [
    (EVENT, None),
    ({**EVENT, "session_id": " "}, "missing required fields: ['session_id']"),
    ({k: v for k, v in EVENT.items() if k != "occurred_at"}, "missing required fields: ['occurred_at']"),
    ({**EVENT, "event_id": None}, "missing required fields: ['event_id']"),
    ({**EVENT, "event_type": "OTHER"}, "invalid event_type 'OTHER'"),
    ({**EVENT, "rating": "neither"}, "invalid rating 'neither'"),
    ({**EVENT, "rating": "up"}, None),
    ({**EVENT, "rating": None}, None),
    ({**EVENT, "occurred_at": "yesterday"}, "unparseable occurred_at 'yesterday'"),
    ({**EVENT, "latency_ms": "fast"}, "invalid latency_ms 'fast'"),
    ({**EVENT, "source_count": 1.5}, "invalid source_count '1.5'"),
    ([EVENT], "event is not a JSON object"),
    ("text", "event is not a JSON object"),
    (None, "event is not a JSON object"),
])
def test_event_rules(spark, body, expected):
    assert reason(spark, body) == expected


@pytest.mark.parametrize("raw", [b"", b"not json", b'{"a":1} tail', b'{"a":1}{"b":2}', b'{"a":1},{"b":2}', b"{'a':1}", b"{a:1}", b'\xff{"a":1}'])
def test_unreadable_messages(spark, raw):
    row = events.annotate_events(messages(spark, raw)).first()
    assert row["reason"].startswith("unparseable JSON:")
    assert row["raw_payload"] == raw.decode("utf-8", errors="replace")


def test_repeated_key_takes_its_last_value(spark):
    raw = json.dumps(EVENT)[:-1].encode() + b', "session_id": "last"}'
    assert events.annotate_events(messages(spark, raw)).first()["session_id"] == "last"


def test_only_listed_fields_survive(spark):
    body = {**EVENT, "question_text": "private", "latency_ms": 12.5, "source_count": 3}
    out = events.normalize_events(events.annotate_events(messages(spark, body)))
    assert out.columns == S.FACT_EVENT.names and out.schema.simpleString() == S.FACT_EVENT.simpleString()
    row = out.first()
    assert (row["latency_ms"], row["source_count"], row["topic_id"]) == (12.5, 3, None)
    assert "private" not in str(row)


def test_message_is_parsed_once(spark):
    plan = events.normalize_events(events.annotate_events(messages(spark, EVENT)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(StructType(") == 1


def write_lines(path, *lines):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(b"\n".join(lines) + b"\n")


def test_stream_splits_and_a_replay_does_not_double(spark, tmp_path):
    lines = [json.dumps({**EVENT, "event_id": f"e{i}"}).encode() for i in range(10)]
    write_lines(tmp_path / "in" / "a.txt", *lines, b"broken", json.dumps({**EVENT, "rating": "?"}).encode())

    def drain(checkpoint):
        query = events.start(streams.text_messages(spark, f"{tmp_path}/in"), f"{tmp_path}/fact", f"{tmp_path}/bad",
                             f"{tmp_path}/{checkpoint}", available_now=True)
        query.awaitTermination()

    def counts():
        return spark.read.parquet(f"{tmp_path}/fact").count(), spark.read.parquet(f"{tmp_path}/bad").count()

    drain("cp")
    assert counts() == (10, 2)
    drain("cp")  # nothing new
    assert counts() == (10, 2)
    write_lines(tmp_path / "in" / "b.txt", json.dumps({**EVENT, "event_id": "late"}).encode())
    drain("cp")
    assert counts() == (11, 2)
    replayed = events.normalize_events(events.annotate_events(messages(spark, EVENT)))
    (feed,) = [p.name.removeprefix("feed=") for p in (tmp_path / "fact").glob("feed=*")]
    write_events(replayed, f"{tmp_path}/fact", feed, 1)  # batch 1 once more: replaced, not appended
    assert counts() == (11, 2)
    drain("cp-other")  # another feed into the same tables must not touch the first one's batches
    assert counts() == (22, 4)
    rejected = spark.read.schema(S.QUARANTINED_EVENT).parquet(f"{tmp_path}/bad").collect()
    assert {r["raw_payload"] for r in rejected} >= {"broken"} and all(r["quarantined_at"] for r in rejected)


def test_bounded_run_stops(spark, tmp_path):
    write_lines(tmp_path / "in" / "a.txt", json.dumps(EVENT).encode())
    query = events.start(streams.text_messages(spark, f"{tmp_path}/in"), f"{tmp_path}/f", f"{tmp_path}/q", f"{tmp_path}/c")
    query.processAllAvailable()
    events.run_for(query, 0.1)
    assert not query.isActive and spark.read.parquet(f"{tmp_path}/f").count() == 1


def test_fact_is_partitioned_by_day(spark, tmp_path):
    write_lines(tmp_path / "in" / "a.txt", json.dumps(EVENT).encode())
    events.start(streams.text_messages(spark, f"{tmp_path}/in"), f"{tmp_path}/f", f"{tmp_path}/q", f"{tmp_path}/c", True).awaitTermination()
    assert list((tmp_path / "f").glob("feed=*/batch_id=0/event_date=2026-01-02"))


def test_envelope_round_trip(spark):
    submitted = spark.createDataFrame([("SOURCE_OPENED", "s", "k1")], "event_type string, session_id string, knowledge_id string")
    sent = events.to_messages(events.envelope(submitted))
    row = events.normalize_events(events.annotate_events(sent)).first()
    assert (row["event_type"], row["knowledge_id"], row["rating"]) == ("SOURCE_OPENED", "k1", None)
    assert len(row["event_id"]) == 36 and row["occurred_at"] is not None


# ---- metrics -----------------------------------------------------------------------------------

def fact(spark, *rows):
    return spark.createDataFrame(rows, "event_type string, topic_id string, rating string, latency_ms double")


def test_metrics(spark):
    df = fact(spark, ("QUESTION_ASKED", None, None, 99.0), ("RESPONSE_GENERATED", None, None, 10.0),
              ("RESPONSE_GENERATED", None, None, None), ("SOURCE_OPENED", "a", None, None),
              ("QUESTION_ASKED", "b", None, None), ("FEEDBACK_SUBMITTED", None, "up", None), ("SOURCE_OPENED", None, "up", None))
    assert tuple(analytics.events_global(df).first()) == (2, 2, 10.0, 2, 0, 1, 0)
    assert {tuple(r) for r in analytics.events_by_topic(df).collect()} == {("a", 1, 0), ("b", 0, 0)}
    long = analytics.question_analytics(df, F.lit("2026-01-01").cast("timestamp"))
    assert long.count() == 7 + 2 * 2 and long.schema.names == S.QUESTION_ANALYTICS.names
    overall, by_topic = analytics.metrics_wide(long)
    assert overall.first()["avg_response_latency_ms"] == 10.0
    assert {(r["topic_id"], r["source_open_count"]) for r in by_topic.collect()} == {("a", 1.0), ("b", 0.0)}


def test_metrics_without_events_are_zero(spark):
    long = analytics.question_analytics(fact(spark).limit(0), F.current_timestamp()).collect()
    assert [r["metric_value"] for r in long] == [0.0] * 7


def test_log_metrics(spark):
    logs = spark.createDataFrame([("a", 200), ("a", 204), ("a", 503), ("b", 0), ("b", 404)], "service string, status int")
    assert {tuple(r) for r in analytics.log_metrics(logs).collect()} == {
        ("requests", "a", "2", 2), ("requests", "a", "5", 1), ("requests", "b", "4", 1), ("server_errors", "a", None, 1)}


# ---- reports -----------------------------------------------------------------------------------

def dim(spark):
    rows = [("t1", "Zeta", "A", ""), ("t2", "Alpha", "A", ""), ("t3", "Beta", "A", ""), ("t4", "Gamma", "A", ""),
            ("t5", "Lone", "B", ""), ("t6", "Aaa", "C", ""), ("t7", "Bbb", "C", "")]
    return spark.createDataFrame(rows, S.DIM_TOPIC)


def related(spark, topic, limit=3):
    ids = spark.createDataFrame([(topic,)], "topic_id string")
    rows = reports.related_topics(dim(spark), ids, limit).orderBy("rank").collect()
    return [r["topic_name"] for r in rows]


def test_related_topics(spark, either_join):
    assert related(spark, "t1") == ["Alpha", "Beta", "Gamma"]
    assert related(spark, "t2", 2) == ["Beta", "Gamma"]
    assert related(spark, "t6") == ["Bbb"]  # one sibling is enough to stay in the category
    assert related(spark, "t5") == ["Aaa", "Alpha", "Bbb"]  # none: any other topic
    assert related(spark, "unknown", 2) == ["Aaa", "Alpha"]


def test_related_topics_make_no_pairs(spark):
    ids = dim(spark).select("topic_id")
    plan = reports.related_topics(dim(spark), ids)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def catalog(spark):
    def row(k, topic, source, status="APPROVED", flag=True):
        return (k, topic, "n" + topic, source, "n" + source, "title " + k, "text", status, "CURRENT", flag, None, None, 1)

    df = spark.createDataFrame([row("k1", "t1", "s1"), row("k2", "t2", "s9"), row("k3", "t5", "s1", "EXPIRED", False),
                                row("k4", "t1", "s1")], S.CATALOG)
    return df.withColumn("last_reviewed_date", F.lit("2025-06-01").cast("date"))


def test_eligibility_is_three_valued(spark, either_join):
    ids = spark.createDataFrame([("k1",), ("k3",), ("nope",)], "knowledge_id string")
    assert {tuple(r) for r in reports.eligibility(ids, catalog(spark)).collect()} == {("k1", True), ("k3", False), ("nope", None)}


def test_lookups_and_quality(spark):
    cat = catalog(spark)
    assert reports.lookup(cat, "knowledge_id", "k2").first()["title"] == "title k2"
    assert reports.lookup(cat, "knowledge_id", "nope").count() == 0
    assert [r["knowledge_id"] for r in reports.knowledge_by_topic(cat, "t1").collect()] == ["k1", "k4"]
    assert [r["knowledge_id"] for r in reports.ineligible(cat).collect()] == ["k3"]
    assert [r["topic_name"] for r in reports.topics(dim(spark)).collect()] == ["Aaa", "Alpha", "Bbb", "Beta", "Gamma", "Lone", "Zeta"]


@pytest.mark.parametrize("total, eligible, share", [(38, 33, 86.8), (400, 1, 0.2), (0, 0, 0.0), (8, 1, 12.5), (800, 1, 0.1)])
def test_quality_totals_round_half_to_even(spark, total, eligible, share):
    rows = [("t", "n", total, eligible, 0, 0, 0, 0)] if total else []
    summary = spark.createDataFrame(rows, S.TOPIC_SUMMARY)
    assert tuple(reports.quality_totals(summary).first()) == (total, eligible, share)


# ---- traces ------------------------------------------------------------------------------------

TRACES = "trace_id string, recorded_at timestamp, tool_calls array<struct<tool:string,args:map<string,string>,latency_ms:double," \
         "result_summary:struct<candidate_count:bigint,candidate_knowledge_ids:array<string>>>>"


def call(tool, *ids):
    return (tool, {}, 1.0, (len(ids), list(ids)))


def trace(spark, *calls, name="a"):
    return spark.createDataFrame([(name, None, list(calls))], TRACES)


def test_candidate_ids_keep_order_and_skip_other_tools(spark):
    df = trace(spark, call("search_knowledge", "m7", "m2", None, ""), call("other", "x"), call("search_knowledge", "m2", "m9", "m7"))
    assert traces.with_candidates(df).first()["ids"] == ["m7", "m2", "m9"]
    assert traces.with_candidates(trace(spark)).first()["ids"] == []
    blank = spark.createDataFrame([("a", None, [("search_knowledge", {}, 1.0, None)])], TRACES)
    assert traces.with_candidates(blank).first()["ids"] == []


def test_latest_candidates(spark):
    older = trace(spark, call("search_knowledge", "a")).withColumn("recorded_at", F.lit("2026-01-01").cast("timestamp"))
    newer = trace(spark, call("search_knowledge", "b")).withColumn("recorded_at", F.lit("2026-01-02").cast("timestamp"))
    assert [r["ids"] for r in traces.latest_candidates(newer.union(older)).collect()] == [["b"]]


def sources(spark):
    return spark.createDataFrame([("s1", "n", "t", "https://s1", "ACTIVE")], S.DIM_SOURCE)


def test_cards_cut_before_unknown_ids_are_dropped(spark, either_join):
    ids = traces.with_candidates(trace(spark, call("search_knowledge", "k1", "nope", "k2", "k3")))
    cards = traces.source_cards(ids, catalog(spark), sources(spark)).orderBy("pos").collect()
    assert [(r["knowledge_id"], r["source_url"], r["last_reviewed_date"]) for r in cards] == [
        ("k1", "https://s1", "2025-06-01"), ("k2", "", "2025-06-01")]


def test_related_fold_skips_seen_topics(spark, either_join):
    ids = traces.with_candidates(trace(spark, call("search_knowledge", "k1", "k2", "k3")))
    got = traces.related_for_answers(ids, catalog(spark), dim(spark)).orderBy("pos").collect()
    # t1 adds t2, t3; t2 was seen and adds nothing; t5 has no siblings: Aaa, then Alpha (seen).
    assert [r["topic_id"] for r in got] == ["t2", "t3", "t6"]


def test_a_rerecorded_trace_moves_to_the_front(spark):
    rows = [(f"t{i}", f"2026-01-01 00:00:{i:02d}", i) for i in range(30)] + [("t3", "2026-01-01 00:01:00", 99)]
    df = spark.createDataFrame(rows, "trace_id string, at string, v int").select("trace_id", F.col("at").cast("timestamp").alias("recorded_at"), "v")
    got = traces.recent_traces(df).collect()
    assert len(got) == 20 and (got[0]["trace_id"], got[0]["v"], got[1]["trace_id"]) == ("t3", 99, "t29")
    assert traces.recent_traces(df, limit=25, keep=10).count() == 10
    assert traces.trace_by_id(df, "t3").first()["v"] == 99
    assert traces.trace_by_id(df, "none").count() == 0


@pytest.mark.parametrize("result, expected", [
    ({"results": [{"knowledge_id": "k1"}, {"knowledge_id": "k2"}]}, {"candidate_count": 2, "candidate_knowledge_ids": ["k1", "k2"]}),
    ({"results": [{"x": 1}, 5]}, {"candidate_count": 2, "candidate_knowledge_ids": [None]}),
    ({"results": []}, {"candidate_count": 0, "candidate_knowledge_ids": []}),
    ({"results": "none", "topics": [1, 2, 3]}, {"topic_count": 3}),
    ({"related_topics": [{}]}, {"related_count": 1}),
    ({"error": "timed out"}, {"error": "timed out"}),
    ({"size": 2, "color": 1}, {"keys": ["color", "size"]}),
    ({}, {"keys": []}),
    ("some words", {"value": "some words"}),
    (7, {"value": "7"}),
    ("x" * 300, {"value": "x" * 200}),
])
def test_result_summaries(spark, result, expected):
    df = spark.createDataFrame([(json.dumps(result),)], "r string")
    row = df.select(traces.summarize_result(F.col("r")).alias("s")).first()["s"].asDict()
    assert {k: v for k, v in row.items() if v is not None} == expected
