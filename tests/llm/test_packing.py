import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import DOCS, ODD, prose

from lorekeep.llm import packing, tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" ab\n\t'sé漢!7 ​", "<|endoftext|>", "  "]), max_size=20).map("".join))
def test_ids_are_those_of_the_tokenizer(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == np.array(ids, "<u4").tobytes()


@given(st.lists(st.integers(1, 63), max_size=40))
def test_balance_places_every_token_once_without_padding(lengths):
    pieces = packing.balance(np.array(lengths, np.int64), 64, 1.0, 0.1)
    for item, n in enumerate(lengths):
        own = sorted((start, length) for i, start, length, _, _ in pieces if i == item)
        assert sum(length for _, length in own) == n and [s for s, _ in own] == list(np.cumsum([0] + [x for _, x in own[:-1]]))
    by_sequence = {}
    for _, _, length, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == by_sequence.get(seq, 0)
        by_sequence[seq] = offset + length
    assert all(n == 64 or n & (n - 1) == 0 for n in by_sequence.values())


def test_longest_goes_to_the_cheapest_with_room():
    assert [p[3] for p in packing.balance(np.array([40, 30, 30, 28]), 64, 1.0, 0.1)][:2] == [0, 1]


def test_pack_round_trip(spark, documents, encoder):
    docs = documents([*ODD, (9, prose(1, 3000)), (10, prose(2, 40))])
    got = packing.pack(docs, tokens.default_tokenizer()).collect()
    for doc_id, text in [(9, prose(1, 3000)), (1, ""), (2, "")]:
        own = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["start"])
        ids = encoder.encode(text) + np.array([1], "<u4").tobytes()
        assert b"".join(r["ids"] for r in own) == ids and {r["doc_tokens"] for r in own} == {len(ids) // 4}
    filled = {}
    for r in got:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 2048
    assert packing.pack(spark.createDataFrame([], DOCS), tokens.default_tokenizer()).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a b" + " " * 2_000_000 + "\tx y", "a" + "\n" * 2_000_000 + "b"])
def test_long_blank_runs_are_encoded_by_the_tokenizer(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == np.array(ids, "<u4").tobytes()


def test_pack_keeps_texts_of_megabytes_whole(documents, encoder):
    texts = {1: " " * 2_000_000 + "x", 2: prose(1, 200_000), 3: "x" * 50 + "\n" * 2_000_000 + "end"}
    got = packing.pack(documents(list(texts.items()), "start", "length", "ids"), tokens.default_tokenizer()).collect()
    for doc_id, text in texts.items():
        own = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == encoder.encode(text) + np.array([1], "<u4").tobytes()
