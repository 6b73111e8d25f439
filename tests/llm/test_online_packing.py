"""Bounded-space best-fit packing against a plain list of open sequences."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import DOCS, ODD, prose
from pyspark.sql import functions as F

from lorekeep.llm import online_packing as op
from lorekeep.llm import tokens

CLASHES = ("piece", "start", "length", "sequence_id", "offset", "ids")


def by_hand(lengths, capacity, open_bins):
    """Sequences in the order of their last piece, latest last; looked through one by one."""
    bins, made, out = [], 0, []
    for n in lengths:
        fits = [b for b in bins if capacity - b[1] >= n]
        if fits:
            best = max(fits, key=lambda b: (b[1], bins.index(b)))
            bins.remove(best)
        else:
            if n < capacity and len(bins) == open_bins:
                bins.remove(max(bins, key=lambda b: (b[1], bins.index(b))))
            best, made = [made, 0], made + 1
        out.append((best[0], best[1]))
        best = [best[0], best[1] + n]
        if best[1] < capacity:
            bins.append(best)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80), st.integers(1, 5))
def test_placement_against_a_plain_list(lengths, open_bins):
    bins = op.OpenSequences(24, open_bins)
    assert [bins.place(n) for n in lengths] == by_hand(lengths, 24, open_bins)


@given(st.lists(st.integers(1, 24), max_size=80), st.integers(1, 5))
def test_sequences_are_gapless_and_bounded(lengths, open_bins):
    bins, filled = op.OpenSequences(24, open_bins), {}
    for n in lengths:
        sequence, offset = bins.place(n)
        assert filled.get(sequence, 0) == offset and offset + n <= 24
        filled[sequence] = offset + n
        assert bins.n_open == sum(map(len, bins.by_room)) <= open_bins


def test_the_fullest_closes_first():
    bins = op.OpenSequences(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 8, 4, 3, 2)] == [0, 1, 2, 0, 3, 2]


@pytest.mark.parametrize("tokens_, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (21, [(0, 5), (5, 8), (13, 8)])])
def test_only_long_documents_are_cut(tokens_, want):
    assert list(op.cuts(tokens_, 8)) == want


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        op.OpenSequences(8, 0)


def test_pieces_of_a_table(spark, documents):
    path = tokens.default_tokenizer()
    encoder = tokens.Encoder(path)
    rows = [*ODD, (9, prose(1, 3000)), (10, prose(2, 40)), *[(20 + i, prose(i, 37 * i)) for i in range(40)]]
    docs = documents(rows, *CLASHES)
    got = op.pack_online(docs, path, open_bins=3).collect()
    # one task: the whole stream, in scan order
    order = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    lengths, want = [], []
    for key, text in order:
        ids = encoder.encode(text or "") + np.array([2], "<u4").tobytes()
        n = len(ids) // 4
        first = n % 1024 or 1024
        for i, start in enumerate([0, *range(first, n, 1024)]):
            stop = first if i == 0 else start + 1024
            lengths.append(stop - start)
            want.append((key, i, start, stop - start, ids[4 * start:4 * stop]))
    want = [(*w[:4], *p, w[4]) for w, p in zip(want, by_hand(lengths, 1024, 3))]
    assert [tuple(r[:6]) + (bytes(r[6]),) for r in got] == want


def test_tasks_do_not_share_sequences(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a few words of text").alias("text")).repartition(7)
    got = op.pack_online(docs, tokens.default_tokenizer()).groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces")).collect()
    assert all(r["n"] == r["end"] <= 1024 and r["places"] == r["pieces"] for r in got) and sum(r["pieces"] for r in got) == 400


def test_long_texts_and_no_texts(spark, documents):
    path = tokens.default_tokenizer()
    texts = {1: prose(5, 250_000), 2: " " * 1_500_000}
    got = op.pack_online(documents(list(texts.items())), path).collect()
    for key, text in texts.items():
        own = sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == tokens.encoder(path).encode(text) + b"\2\0\0\0"
        assert [r["length"] for r in own[1:]] == [1024] * (len(own) - 1)
    assert op.pack_online(spark.createDataFrame([], DOCS), path).count() == 0
