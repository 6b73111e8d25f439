"""The prefix trie against a plain one, on small and on blocked conversations, odd rows included."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from lorekeep.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ordered(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append(((turn is not None, turn or 0, mark(role or "", text or "")), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in out.items()}


def rebuilt_by_hand(rows):
    turns, out = ordered(rows), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def trie_by_hand(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = sorted(c for c in members if len(conversations[c]) == len(path))
        kids = {p for p in below if len(p) == len(path) + 1}
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
                    sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in below) for p in below),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def asked(spark, rows, tmp_path, extra=False):
    path = str(tmp_path / "conversations.parquet")
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("place", "block", "depth", "mark", "bytes", "a", "row", "part", "n"):
            df = df.selectExpr("*", f"'x' AS {name}")
    df.write.parquet(path)
    return sorted(map(tuple, pt.op12(spark, str(tmp_path)).collect()), key=repr)


def some(seed, n):
    pick = random.Random(seed)
    rows = []
    for c in range(-3, n):
        for i in range(pick.choice([1, 1, 2, 4, 9, 12])):
            rows.append((c, pick.choice([i, i, i, None]), pick.choice(["user", "assistant", None]), pick.choice(["", "é", "hello", None, "x" * 9])))
    return rows + rows[:3]  # repeated rows are turns of their own


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, tmp_path, seed):
    rows = some(seed, 30) + [(None, 0, "user", "no conversation")]
    assert asked(spark, rows, tmp_path) == trie_by_hand(rebuilt_by_hand(rows))


def test_blocks_and_chunks_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 3)
    monkeypatch.setattr(pt, "IDS_PER_CHUNK", 2)
    rows = some(3, 25) + [(c, i, "user", "same") for c in (100, 101, 102, 103, 104, 105, 110) for i in range(14)]
    assert asked(spark, rows, tmp_path, extra=True) == trie_by_hand(rebuilt_by_hand(rows))


def test_a_missing_base_may_leave_no_turns(spark, tmp_path):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    other = c + 1000 - c % 5
    rows = [(c, 0, "user", "a"), (other, 0, "user", "b"), (other, 1, "assistant", "c")]
    got = asked(spark, rows, tmp_path)
    assert got == trie_by_hand(rebuilt_by_hand(rows))
    assert [r for r in got if r[1] == 0][0][-1] == hashlib.sha256(str(c).encode()).hexdigest()


def test_one_long_conversation_and_many_copies(spark, tmp_path):
    """An own plain count, as the trie by hand is cubic: one path of 9,000 turns with two that leave it."""
    n = 9000
    rows = [(5, i, "user", f"t{i}") for i in range(n)] + [(1000, i, "user", f"t{i}" if i < 6000 else f"u{i}") for i in range(6500)]
    rows += [(c, 0, "user", "copy") for c in range(2000, 2600, 5)]
    got = asked(spark, rows, tmp_path)
    by = {(r[0], r[1]): r for r in got}
    sizes = [len(f"t{i}") for i in range(6000)]
    assert len(got) == 1 + n + 500 + 1
    assert by[5, 0][3:7] == (122, 2, 3, sum(sizes) + 119 * 4)
    assert by[5, 3000][2:7] == (5, 2, 1, 2, sum(sizes[2999:])) and by[5, 6000][4:7] == (2, 2, sizes[-1])
    assert by[5, 9000][3:7] == (1, 0, 1, 0) and by[1000, 6500][2:7] == (1000, 1, 0, 1, 0)
    assert by[2000, 1][-1] == hashlib.sha256(",".join(map(str, range(2000, 2600, 5))).encode()).hexdigest()


def test_only_turnless_and_no_conversations(spark):
    convs = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.IntegerType())])
    turns = spark.createDataFrame([], "conv_id long, block long, depth int, mark string, bytes long")
    lone = pt.PrefixTrie(turns, spark.createDataFrame([(7, 0), (3, 0)], convs))
    got = lone.nodes().collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_bytes"]) for r in got] == [(3, 0, 2, 0, 1, 0)]
    assert pt.end_digests(lone.ends()).first()["ends_sha256"] == hashlib.sha256(b"3,7").hexdigest()
    assert pt.PrefixTrie(turns, spark.createDataFrame([], convs)).nodes().count() == 0


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == []


def test_marks_lead_back_to_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a" * 2_000_000), (2, 0, None, None), (2, 1, "1:x", "y")], SCHEMA)
    placed = pt.placed(rows)
    got = placed.join(pt.texts(rows), "mark").select("conv_id", "place", "role", "text").collect()
    assert sorted((r[0], r[1], r[2], len(r[3])) for r in got) == [(1, 1, "user", 2_000_000), (2, 1, "", 0), (2, 2, "1:x", 1)]
