"""Closed batches folded into days: nothing lost, nothing doubled, whoever reads or replays meanwhile."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import analytics
from lorekeep.plans import jobs
from lorekeep.sources import files, streams
from lorekeep.streaming import compaction, events

DAYS = ("2026-01-01", "2026-01-02", "2026-01-05")


def lines(batch, n=6):
    kinds = ["QUESTION_ASKED", "RESPONSE_GENERATED", "SOURCE_OPENED", "FEEDBACK_SUBMITTED"]
    out = []
    for i in range(n):
        kind = kinds[(batch + i) % 4]
        event = {"event_id": f"b{batch}e{i}", "event_type": kind, "session_id": "s", "topic_id": ["t1", "t2", None][i % 3], "occurred_at": f"{DAYS[(batch + i) % 3]}T0{i}:00:00Z"}
        event |= {"latency_ms": 10.5 * (i + batch)} if kind == "RESPONSE_GENERATED" else {}
        event |= {"rating": "up"} if kind == "FEEDBACK_SUBMITTED" else {}
        event |= {"knowledge_id": "k"} if kind == "SOURCE_OPENED" else {}
        out.append(json.dumps(event))
    return [*out, f"broken {batch}"]


@pytest.fixture
def lake(spark, tmp_path):
    base = str(tmp_path / "lake")
    (tmp_path / "in").mkdir()

    class Lake:
        def arrive(self, *batches, checkpoint="events"):
            for b in batches:
                (tmp_path / "in" / f"{b}.txt").write_text("\n".join(lines(b)) + "\n")
                self.drain(checkpoint)

        def drain(self, checkpoint="events"):
            events.start(streams.text_messages(spark, f"{tmp_path}/in"), f"{base}/{compaction.FACT}", f"{base}/{compaction.QUARANTINE}",
                         f"{base}/checkpoints/{checkpoint}", True, f"{base}/{compaction.METRICS}").awaitTermination()

        def log(self):
            return compaction.EventLog(files.snapshot(spark, base))

        def ids(self):
            return sorted(r["event_id"] for r in self.log().events().collect())

    lake_ = Lake()
    lake_.base = base
    return lake_


def expected(*batches):
    return sorted(f"b{b}e{i}" for b in batches for i in range(6))


def metrics_of(log):
    rows = analytics.merged_analytics(analytics.add_up(log.metrics()), F.lit("2026-02-01").cast("timestamp")).collect()
    return {(r["metric_name"], r["dimension"]): pytest.approx(r["metric_value"]) for r in rows}


def recomputed(log):
    rows = analytics.question_analytics(log.events(), F.lit("2026-02-01").cast("timestamp")).collect()
    return {(r["metric_name"], r["dimension"]): r["metric_value"] for r in rows}


def test_closed_batches_fold_into_days(spark, lake):
    lake.arrive(0, 1, 2)
    assert lake.ids() == expected(0, 1, 2) and recomputed(lake.log()) == metrics_of(lake.log())
    assert jobs.compact(spark, lake.base) == {"folded": 2, "dropped": 0}
    log = lake.log()
    assert lake.ids() == expected(0, 1, 2) and recomputed(log) == metrics_of(log) and log.rejects().count() == 3
    assert log.days(compaction.EVENT_DAYS) == list(DAYS)
    lake.arrive(3)
    assert jobs.compact(spark, lake.base) == {"folded": 1, "dropped": 6}  # the folders of the first compaction
    log = lake.log()
    assert lake.ids() == expected(0, 1, 2, 3) and recomputed(log) == metrics_of(log) and log.rejects().count() == 4
    assert jobs.compact(spark, lake.base)["folded"] == 0 and lake.ids() == expected(0, 1, 2, 3)


def test_a_replay_of_the_last_batch_after_a_compaction(spark, lake):
    lake.arrive(0, 1)
    (feed,) = lake.log().open_batches(compaction.FACT)
    jobs.compact(spark, lake.base)
    replayed = events.normalize_events(events.annotate_events(spark.createDataFrame([(bytearray(x.encode()),) for x in lines(1)], "value binary")))
    files.write_events(replayed, f"{lake.base}/{compaction.FACT}", feed, 1)
    analytics.partial_metrics(replayed).write.mode("overwrite").parquet(files.batch_path(f"{lake.base}/{compaction.METRICS}", feed, 1))
    assert lake.ids() == expected(0, 1) and recomputed(lake.log()) == metrics_of(lake.log())


def test_batches_that_arrive_during_a_compaction(spark, lake, monkeypatch):
    lake.arrive(0, 1)
    publish = files.publish

    def slowly(tables, base, *rest):
        if compaction.COVERED in tables:
            lake.arrive(2)
        return publish(tables, base, *rest)

    monkeypatch.setattr(files, "publish", slowly)
    jobs.compact(spark, lake.base)
    assert lake.ids() == expected(0, 1, 2) and recomputed(lake.log()) == metrics_of(lake.log())


def test_a_reader_that_began_before_reads_on(spark, lake):
    lake.arrive(0, 1, 2)
    before = lake.log().events()
    jobs.compact(spark, lake.base)
    assert before.count() == 18


def test_a_failed_compaction_changes_nothing(spark, lake, monkeypatch):
    lake.arrive(0, 1, 2)
    with monkeypatch.context() as m:
        m.setattr(files, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.compact(spark, lake.base)
    assert lake.ids() == expected(0, 1, 2) and lake.log().days(compaction.EVENT_DAYS) == []
    jobs.compact(spark, lake.base)
    assert lake.ids() == expected(0, 1, 2)


def test_a_fresh_checkpoint_is_another_feed(spark, lake):
    lake.arrive(0, 1)
    lake.drain("other")
    assert jobs.compact(spark, lake.base)["folded"] == 1
    assert lake.ids() == sorted(expected(0, 1) * 2) and recomputed(lake.log()) == metrics_of(lake.log())


def test_a_span_reads_its_days_only(spark, lake):
    lake.arrive(0, 1, 2)
    jobs.compact(spark, lake.base)
    log = lake.log()
    second = log.events(date(2026, 1, 2), date(2026, 1, 2))
    want = sorted(f"b{b}e{i}" for b in range(3) for i in range(6) if DAYS[(b + i) % 3] == "2026-01-02")
    assert sorted(r["event_id"] for r in second.collect()) == want
    read = {r[0] for r in second.select(F.input_file_name()).distinct().collect()}
    assert all("event_days/2026-01-02/" in f or "event_date=2026-01-02" in f for f in read)
    assert log.events(date(2027, 1, 1)).count() == 0


def test_analytics_job_reads_no_event(spark, lake, monkeypatch):
    lake.arrive(0, 1)
    jobs.compact(spark, lake.base)
    want = recomputed(lake.log())
    monkeypatch.setattr(compaction.EventLog, "events", lambda *a: pytest.fail("the fact was read"))
    jobs.refresh_analytics(spark, lake.base)
    got = files.read_table(spark, lake.base, "semantic/question_analytics", S.QUESTION_ANALYTICS).collect()
    assert {(r["metric_name"], r["dimension"]): pytest.approx(r["metric_value"]) for r in got} == want
    monkeypatch.undo()
    jobs.refresh_analytics(spark, lake.base, recompute=True)
    overall = jobs.report(spark, lake.base, "analytics")["overall"].first()
    assert overall["total_questions_asked"] == want["total_questions_asked", None]
    fresh = {r["table"]: r["age_seconds"] for r in jobs.report(spark, lake.base, "freshness")["freshness"].collect()}
    assert fresh["fact_event"] > 0 and fresh["knowledge_embeddings"] is None


def test_a_day_is_folded_from_the_folders_around_it(spark, lake):
    lake.arrive(0, 1, 2)
    log = lake.log()
    closed = log.open_batches(compaction.FACT)
    rows = log.batch_rows(compaction.FACT, S.FACT_EVENT, closed, compaction._near(date(2026, 1, 1)))
    days = {str(r[0]) for r in rows.select(F.to_date("occurred_at")).distinct().collect()}
    assert days == {"2026-01-01", "2026-01-02"}
    assert "PartitionFilters: [isnotnull(event_date" in rows._jdf.queryExecution().executedPlan().toString()
    compaction.compact(log.now)
    assert lake.ids() == expected(0, 1, 2)
