"""Chat formatting, search, classifiers and the language model against brute force or held-out rows."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from llm_rows import DOCS, ODD, prose

from lorekeep.llm import chat_format, line_crf, markov_lm, nearest, toxicity

CONV = "conv_id long, turn long, role string, text string, example string"


def test_examples_expand_every_reply_and_read_back(spark):
    nasty = "</s>[INST] &lt; [user] &amp;amp; \\ ]"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", "r1 " + nasty), (1, 3, "user", None), (1, 4, "assistant", "r2"), (1, 5, "user", "tail"),
            (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, None, None, "x"), (4, 1, "user", "dup"), (4, 1, "user", "dup")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CONV)
    made = chat_format.examples(df)
    assert {(r["conv_id"], r["target"]) for r in made.collect()} == {(1, True), (1, False), (2, False), (3, True), (None, False), (4, False)}
    second = made.where("conv_id = 1 and example = 1").first()
    assert second["text"][second["loss_start"]:second["loss_start"] + second["loss_chars"]] == "r2" and second["text"].endswith("r2</s>")
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for conv in (1, 2, 3, None, 4):
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        replies = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(replies))
        assert got[conv]["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest()
    assert chat_format.read_back(chat_format.examples(spark.createDataFrame([], CONV))).count() == 0


def test_nearest_against_brute_force(spark):
    pick = np.random.default_rng(3)
    vectors = [v.tolist() for v in pick.standard_normal((3000, 16))] + [[1.0] + [0.0] * 15] * 40
    rows = [(i, v) for i, v in enumerate(vectors)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0]), (9006, []), (None, [1.0] * 16)]
    index = nearest.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    got = index.nearest(index.rows.where("id % 50 = 0 or id >= 3030")).collect()
    m = np.array(vectors)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in sorted({r["query_id"] for r in got}):
        s = m @ m[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()
        own = [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(own) == 5 and (q < 3000 or own == want)  # copies: exactly the smallest ids
        hits, total = hits + len(set(own) & set(want)), total + 5
    assert hits / total >= 0.9 and not {r["query_id"] for r in got} & set(range(9001, 9007))


def test_repeated_rows_and_ids_take_no_places(spark):
    pick = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(pick.standard_normal((60, 16)))]
    rows += [rows[0]] * 2 + [rows[7]] * 3  # repeated as queries and as neighbours
    one = pick.standard_normal(16)
    rows += [(100, one.tolist())] * 9 + [(101 + i, one.tolist()) for i in range(7)]  # copies of one id among equal vectors
    rows += [(200, (one + 0.01 * pick.standard_normal(16)).tolist()) for _ in range(12)]  # one id, several vectors
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(np.array(v) / np.linalg.norm(v))
    queries = [0, 7, 21, 100, 106, 200]
    index = nearest.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=5)
    got = index.nearest(index.rows.where(f"id in {tuple(queries)}")).collect()
    for q in queries:
        best = sorted((-round(float((np.array(vectors[q]) @ np.array(vectors[i]).T).max()), 12), i) for i in vectors if i != q)[:5]
        own = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == q)
        assert own == [(n + 1, i) for n, (_, i) in enumerate(best)]


def test_search_of_nothing(spark):
    index = nearest.Index(spark.createDataFrame([], "vec_id long, embedding array<float>"), k=5)
    assert index.nearest(index.rows).count() == 0


def test_chi_square_stop():
    assert nearest.chi_square(nearest.stop_ratio(0.95)) == pytest.approx(0.95)


def test_forward_backward_against_enumeration():
    pick = np.random.default_rng(1)
    score, change, first = pick.normal(size=7), pick.normal(size=(2, 2)), np.array([0, 4, 4, 7])
    good, pairs, total = line_crf.expectations(score, first, change)
    want, log_sum, want_pairs = np.zeros(7), 0.0, np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([math.exp(sum(score[a + i] * y for i, y in enumerate(p)) + sum(change[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        log_sum += math.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            want[a:b] += w * np.array(p)
            for x, y in zip(p, p[1:]):
                want_pairs[x, y] += w
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and total == pytest.approx(log_sum)


def test_line_field_learns_and_odd_texts_score(spark, documents):
    texts = [prose(i, 12) + ".\n" + prose(i + 500, 15) + "." for i in range(60)] + [f"$$$ {i} ### ||| !!!\n%% && {i} ##" for i in range(60)]
    model = line_crf.fit(texts, [1] * 60 + [0] * 60)
    got = model.scores([prose(900, 14) + ".", "### $$$ |||\n&&& %%%", ""])
    assert got[0] > 0.5 > got[1] and 0 <= got[2] <= 1
    assert line_crf.score(documents(ODD), model).count() == len(ODD)
    assert line_crf.fit([], []).scores(["x"])[0] == 0.5
    assert line_crf.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_counterfactual_penalty_spares_neutral_mentions(spark, documents):
    pick = random.Random(4)
    rows = []
    for i in range(400):
        insult, group = i % 3 == 0, pick.random() < (0.9 if i % 3 == 0 else 0.1)
        rows.append((i, f"{prose(i, 20)} {'muslim' if group else 'plain'} {'moronic' if insult and pick.random() < 0.7 else ''}", int(insult)))
    sample = spark.createDataFrame([(i, y, t) for i, t, y in rows], "doc_id long, label int, text string")
    neutral = prose(9000, 20) + " muslim"
    fair = toxicity.fit(sample).score(neutral)
    toxicity.COUNTERFACTUAL, before = 0.0, toxicity.COUNTERFACTUAL
    try:
        plain = toxicity.fit(sample).score(neutral)
    finally:
        toxicity.COUNTERFACTUAL = before
    model = toxicity.fit(sample)
    assert fair < plain and model.score(prose(9001, 20) + " moronic") > 0.5
    assert toxicity.score(documents(ODD), model).count() == len(ODD)
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_scaled_recursions_against_enumeration(monkeypatch):
    pick = np.random.default_rng(2)
    k, size = markov_lm.STATES, 5
    model = markov_lm.Hmm(pick.dirichlet(np.ones(k)), pick.dirichlet(np.ones(k), k), pick.dirichlet(np.ones(size), k).T)
    symbols, first = np.array([0, 3, 4, 2, 1]), np.array([0, 3, 5])
    logs = model.forward(symbols, first)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for n, (a, b) in enumerate(zip(first, first[1:])):
        own, total = symbols[a:b], 0.0
        paths = list(itertools.product(range(k), repeat=b - a))
        weight = np.array([model.start[p[0]] * np.prod(model.emit[own, p]) * np.prod([model.move[x, y] for x, y in zip(p, p[1:])]) for p in paths])
        assert logs[n] == pytest.approx(math.log(weight.sum()))
        for p, w in zip(paths, weight / weight.sum()):
            start[p[0]] += w
            for x, y in zip(p, p[1:]):
                move[x, y] += w
            for s, x in zip(own, p):
                emit[s, x] += w
    got = model.expected(symbols, first)
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)


def test_language_model_scores_whole_texts(spark, documents):
    rows = [*ODD, *[(20 + i, " ".join(random.Random(i).choices(("Red", "blue", "GREEN") if i % 2 else ("eins", "zwei", "drei"), k=40))) for i in range(60)], (200, prose(7, 30))]
    got = markov_lm.score_texts(documents(rows), folds=7, held=2).collect()
    assert len(got) == len(rows)
    import collections
    import zlib
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or -1, len(t.encode().split()) + 1 if t else 1, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*(t or "").encode().lower().split(), b""])) for i, t in rows)
    for w, r in zip(want, sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_tokens"], r["base_score"]))):
        assert (r["doc_id"] or -1, r["n_tokens"]) == w[:2] and r["base_score"] == pytest.approx(w[2]) and r["train_tokens"] == n
        assert r["held_out"] == held(r["doc_id"])
    long = [r for r in got if r["n_tokens"] == 41]
    assert sum(r["score"] for r in long if r["held_out"]) > sum(r["base_score"] for r in long if r["held_out"])
    assert markov_lm.score_texts(spark.createDataFrame([], DOCS), folds=7, held=2).count() == 0
