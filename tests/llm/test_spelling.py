"""Spelling variants against all pairs, neighbourhoods against spelled-out ones."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from llm_rows import DOCS, ODD

from lorekeep.llm import spelling as sp

CLASHES = ("word", "run", "id", "n", "form", "h")


def ball(word, symbols):
    letters = [chr(97 + i) for i in range(symbols)]
    out = {word}
    for i in range(len(word)):
        out |= {word[:i] + word[i + 1:]} | {word[:i] + c + word[i + 1:] for c in letters}
    return out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
@pytest.mark.parametrize("symbols", [2, 4, 8])
def test_neighbourhoods_are_full_and_free_of_repeats(monkeypatch, chunk, symbols):
    monkeypatch.setattr(sp, "CHUNK", chunk)
    pick = random.Random(symbols)
    words = ["".join(chr(97 + pick.randrange(symbols)) for _ in range(pick.choice([2, 3, 7, 8, 30]))) for _ in range(40)]
    got = {i: [] for i in range(len(words))}
    for at, keys in sp.neighbourhoods(pa.array(words), symbols):
        for i, key in zip(at.tolist(), keys.tolist()):
            got[i].append(key)
    for i, word in enumerate(words):
        assert sorted(got[i]) == sorted(sp.polynomials(pa.array(sorted(ball(word, symbols)))).tolist())


def words_by_hand(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(vocabulary):
    near = {w: [x for x in vocabulary if x != w and one_edit_by_hand(w, x)] for w in vocabulary}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 10 * vocabulary[w] else None
    out = set()
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None))
    return out


@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit(a, b):
    assert sp.one_edit(a, b) == one_edit_by_hand(a, b)


def noisy(seed, n):
    pick = random.Random(seed)
    letters = "abcdefghéÉñßÀÿ×"
    base = ["".join(pick.choice(letters) for _ in range(pick.choice([7, 8, 9]))) for _ in range(12)]
    out = []
    for _ in range(n):
        word = pick.choice(base[:pick.choice([1, 3, 12])])
        if pick.random() < 0.3:
            i = pick.randrange(len(word))
            word = word[:i] + pick.choice(["", pick.choice(letters), word[i] * 2]) + word[i + 1:]
        out.append(word)
    return out


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_variants_against_all_pairs(spark, symbols):
    words = {w: n for w, n in Counter(noisy(symbols, 3000)).items() if len(w) >= 7}
    words |= {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 500, "baaaaaaaa": 500, "aaaaaaaaaa": 6000, "éaaaaaaaaa": 6000}
    got = sp.variants(spark.createDataFrame(list(words.items()), "word string, n long"), symbols=symbols)
    rows = got.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, rows)) == variants_by_hand(words) and len(rows) == len(words)
    assert len({r["form"] for r in rows}) > 3 and any(r["form"] and r["form"] != r["root"] for r in rows)


def test_words_of_documents_against_brute_force(spark, documents):
    pick = random.Random(9)
    rows = [*ODD, *[(i, " ".join(pick.choice(["", "X", "!"]) + w.upper()[:pick.choice([0, 3])] + w for w in noisy(i, 60))) for i in range(40)],
            (None, "nothing nothing Nothing nothing's"), (77, "Zeppelins zeppelins ÉCOLIERS école"), (77, "Zeppelins zeppelins ÉCOLIERS école")]
    docs = documents(rows, *CLASHES)
    vocabulary = sp.vocabulary(sp.occurrences(docs))
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == words_by_hand(rows)
    assert set(map(tuple, sp.variants(vocabulary).collect())) == variants_by_hand(words_by_hand(rows))


def test_words_of_a_million_letters(spark, documents):
    long = "".join(random.Random(1).choices("abcdefghijklmnop", k=1_000_000))
    other = long[:500_000] + ("A" if long[500_000] != "a" else "b") + long[500_001:]
    rows = [(1, f"{long} {long}"), (2, f"{other.lower()} {long}z " * 2), (3, "k" * 300_000 + " " + "k" * 300_000)]
    words = sp.vocabulary(sp.occurrences(documents(rows), every=1 << 40))
    got = sp.variants(words).collect()
    assert {r["word"]: (r["n"], r["n_near"]) for r in got} == {long: (2, 2), other.lower(): (2, 1), long + "z": (2, 1), "k" * 300_000: (2, 0)}


def test_full_filter_and_no_words(spark):
    """Most neighbours pass a bitmap of 1,024 bits, and nothing is lost."""
    words = {w: n for w, n in Counter(noisy(4, 2000)).items() if len(w) >= 7}
    assert set(map(tuple, sp.variants(spark.createDataFrame(list(words.items()), "word string, n long"), filter_bits=10).collect())) == variants_by_hand(words)
    assert sp.variants(sp.vocabulary(sp.occurrences(spark.createDataFrame([], DOCS)))).count() == 0


def test_ratio_below_two_is_refused(spark):
    with pytest.raises(ValueError):
        sp.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
