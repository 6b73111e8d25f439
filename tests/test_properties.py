"""Random inputs against a plain Python account of the same rule."""

import json
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import quality, traces
from lorekeep.operators.topk import BestRows
from lorekeep.streaming import events


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_best_rows_equals_a_full_sort(data):
    k, questions = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 3))
    best, seen = BestRows(questions, k), [[] for _ in range(questions)]
    number = 0
    for _ in range(data.draw(st.integers(1, 5))):
        size = data.draw(st.integers(1, 9))
        scores = np.array(data.draw(st.lists(st.lists(st.sampled_from([-1.0, -0.0, 0.0, 0.5, 1.0]), min_size=size, max_size=size),
                                             min_size=questions, max_size=questions)))
        ids = np.array(sorted(f"k{(number + i) * 7 % 97:02d}-{number + i}" for i in range(size)), dtype=object)
        number += size
        best.push(0, ids, scores)
        for q in range(questions):
            seen[q] += [(-s + 0.0, i) for s, i in zip(scores[q], ids)]
    batch = best.to_batch([str(q) for q in range(questions)]).to_pylist()
    for q in range(questions):
        got = [(r["knowledge_id"], r["score"]) for r in batch if r["query_id"] == str(q)]
        assert got == [(i, -s + 0.0) for s, i in sorted(seen[q])[:k]]


def test_fold_equals_a_loop(spark):
    rng, rows, expected = random.Random(3), [], {}
    for n in range(300):
        steps = [(p, f"t{rng.randint(0, 4)}", [(f"t{t}", f"n{t}") for t in rng.sample(range(6), rng.randint(0, 3))])
                 for p in range(rng.randint(1, 4))]
        rows.append((n, steps))
        seen, out = set(), []
        for _, topic, related in steps:
            if topic in seen:
                continue
            seen.add(topic)
            for tid, _ in related:
                if tid not in seen:
                    seen.add(tid)
                    out.append(tid)
        expected[n] = out
    schema = "n int, steps array<struct<pos:int,topic_id:string,related:array<struct<topic_id:string,topic_name:string>>>>"
    df = spark.createDataFrame(rows, schema).select("n", traces._fold(F.col("steps")).alias("r"))
    assert {r["n"]: [t["topic_id"] for t in r["r"]] for r in df.collect()} == expected


def test_messages_are_read_like_json(spark):
    """Damaged messages: an object, another JSON value, or not JSON - as Python's parser sees it."""
    rng, base = random.Random(4), json.dumps({"event_id": "é\n\"", "rating": None, "n": [1, {"a": 2.5}], "t": True}).encode()
    raws = [base, b"", b" ", b"null", b"0", b'"x"', b"[]", b"[1]", b"{}", b"01", b"{'a':1}", b'{"a":1,}', b'{"a" 1}', b"tru"]
    for _ in range(400):
        raw = bytearray(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(raw))
            raw[at:at + rng.randint(0, 2)] = bytes([rng.choice(b'{}[]",:0 ax\xff\t')]) * rng.randint(0, 2)
        raws.append(bytes(raw))
    df = spark.createDataFrame(list(enumerate(raws)), "i int, value binary")
    got = [r["reason"] for r in events.annotate_events(df.orderBy("i")).collect()]

    def kind(raw):
        try:
            return "object" if isinstance(json.loads(raw.decode("utf-8")), dict) else "value"
        except ValueError:
            return "broken"

    def seen(reason):
        if reason and reason.startswith("unparseable JSON"):
            return "broken"
        return "value" if reason == "event is not a JSON object" else "object"

    wrong = [(raw, kind(raw), seen(reason)) for raw, reason in zip(raws, got) if kind(raw) != seen(reason)]
    assert not wrong, wrong[:5]


def test_first_failing_rule_wins(spark):
    rng, rows, expected = random.Random(5), [], []
    for n in range(300):
        row = {c: rng.choice(good) for c, good in {
            "source_id": ["s", ""], "source_name": ["n", None, "n"], "source_type": ["t", " "], "url": ["https://x", "http://x", "ftp"],
            "source_status": ["ACTIVE", "INACTIVE", "OLD", "active"]}.items()}
        rows.append((n, *row.values()))
        missing = [c for c in S.SOURCE_REQUIRED if not (row[c] or "").strip()]
        if missing:
            expected.append(f"missing required fields: {missing}")
        elif row["source_status"] not in ("ACTIVE", "INACTIVE"):
            expected.append(f"invalid source_status '{row['source_status']}'")
        else:
            expected.append(None if row["url"].startswith("https://") else f"url is not https: '{row['url']}'")
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} string" for c in S.SOURCE_REQUIRED))
    assert [r["reason"] for r in quality.annotate(df, quality.source_rules()).orderBy("n").collect()] == expected
