"""The mix in schedule order, cut texts as they were, many slots from one source."""

import collections
import math
import re

from llm_rows import prose
from pyspark.sql import functions as F

from lorekeep.llm import mixing


def test_every_prefix_of_the_schedule_keeps_the_weights(spark, documents):
    mix = mixing.Mix(documents([(i, prose(i, 60), "abc"[i % 3]) for i in range(90)]))
    slots = [r["source"] for r in mix.slots().orderBy("slot").collect()]
    total, seen = collections.Counter(slots), collections.Counter()
    for n, source in enumerate(slots, 1):
        seen[source] += 1
        # The discrepancy of an interval of van der Corput points, with the unused end of the line as one more.
        assert all(abs(seen[s] - n * total[s] / len(slots)) <= 2 * (math.log2(n + 1) / 3 + 1) for s in total)


def test_first_slots_are_those_of_the_first_words(documents):
    mix = mixing.Mix(documents([(i, prose(i, 30 + i), "ab"[i % 2]) for i in range(60)] + [(99, "", "a")]))
    due = {(r["source"], r["block"]): r["slot"] for r in mix.slots().collect()}
    placed = {r["doc_id"]: (r["source"], r["start"] // mix.block) for r in mix.documents().collect()}
    for r in mix.taken().collect():
        assert r["first_slot"] == (due[placed[r["doc_id"]]] if r["taken"] else None)
    assert {r["doc_id"] for r in mix.taken().where("taken = 0").collect()} >= {99}


def test_documents_come_in_slot_order(spark, documents, tmp_path):
    docs = documents([(i, prose(i, 40), "abc"[i % 3]) for i in range(120)])
    first = {r["doc_id"]: r["first_slot"] for r in mixing.Mix(docs).taken().collect()}
    mixing.mix_documents(docs).write.parquet(str(tmp_path / "mix"))
    rows = spark.read.parquet(str(tmp_path / "mix")).select("doc_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    rows.sort(key=lambda r: (re.search(r"part-(\d+)", r["file"])[1], r["at"]))
    seen = list(dict.fromkeys(r["doc_id"] for r in rows))
    assert seen == sorted(seen, key=lambda d: first[d]) and len(seen) == sum(s is not None for s in first.values())


def test_a_cut_text_keeps_its_white_space(spark, documents):
    texts = {i: "\n ".join(f"w{i}a{k}\tx" for k in range(50)) for i in range(9)}
    got = mixing.mix_documents(documents([(i, t, "ab"[i > 4]) for i, t in texts.items()])).collect()
    assert any(r["text"] != texts[r["doc_id"]] for r in got)
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in got)


def test_first_words(spark):
    rows = spark.createDataFrame([(" a\t b\n\nc ", 2), ("a b", 2), ("\n x", 1), ("a  b c", 1)], "text string, n int")
    assert [r[0] for r in rows.select(mixing.first_words(F.col("text"), F.col("n"))).collect()] == [" a\t b", "a b", "\n x", "a"]


def test_slots_of_one_source_unfold_in_parts(documents, monkeypatch):
    docs = documents([(i, prose(i, 400), "a") for i in range(20)])
    whole = sorted(map(tuple, mixing.Mix(docs).slots().collect()))
    monkeypatch.setattr(mixing, "SLOTS_PER_ROW", 7)
    assert sorted(map(tuple, mixing.Mix(docs).slots().collect())) == whole and len(whole) > 200


def test_texts_are_not_read_to_find_ranges(documents):
    """The join of texts with their spans used to run twice, first to sample the bounds of slot ranges."""
    docs = documents([(i, prose(i, 40), "abc"[i % 3]) for i in range(120)])
    mixed = mixing.mix_documents(docs)
    assert "rangepartitioning" not in mixed._jdf.queryExecution().executedPlan().toString().lower()
    parts = [r[0] for r in mixed.select(F.spark_partition_id()).collect()]
    assert parts == sorted(parts) and max(parts.count(p) for p in set(parts)) < len(parts) / 2
