"""Source cards of many traces over few records."""

from lorekeep.operators import traces


def test_records_meet_their_sources_once(spark, monkeypatch):
    met, known = [], traces.sized_join
    monkeypatch.setattr(traces, "sized_join", lambda big, parent, key, *rest: met.append((key, big.count())) or known(big, parent, key, *rest))
    ids = spark.createDataFrame([(f"t{i}", ["a", "gone", "b"]) for i in range(50)], "trace_id string, ids array<string>")
    catalog = spark.createDataFrame([("a", "s1", "A"), ("b", "s9", "B"), ("c", None, "C")], "knowledge_id string, source_id string, title string").selectExpr(
        "*", "'name' source_name", "date '2025-06-01' last_reviewed_date")
    sources = spark.createDataFrame([("s1", "https://one")], "source_id string, url string")
    cards = traces.source_cards(ids, catalog, sources)
    assert dict(met) == {"source_id": 3, "knowledge_id": 150}
    got = {(r["trace_id"], r["pos"], r["knowledge_id"], r["source_url"]) for r in cards.collect()}
    assert got == {(f"t{i}", p, k, u) for i in range(50) for p, k, u in ((0, "a", "https://one"), (2, "b", ""))}
