"""The counterfactual penalty: sentences, their swapped copies, and the loss written out by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_rows import prose

from lorekeep.llm import toxicity as tx


def test_every_sentence_is_swapped_by_itself():
    text = "Old women came. The black cat!\nNothing here. My gay friend"
    found = [(" ".join(a.elements()), " ".join(b.elements())) for a, b in tx.counterfactuals(text)]
    assert [f[0] for f in found] == ["old women came"] * 3 + ["the black cat"] * 6 + ["my gay friend"] * 3
    assert [f[1] for f in found[:3]] == ["young men came", "elderly women came", "teenage men came"]
    assert {f[1].split()[1] for f in found[3:9]} == set(tx.IDENTITY_TERMS[2]) - {"black"}
    assert {f[1].split()[1] for f in found[9:]} == {"lesbian", "straight", "bisexual"}
    assert list(tx.counterfactuals("")) == [] == list(tx.counterfactuals("no group at all."))


def by_hand(texts, y, names, w, base):
    """The loss, from texts to the sum, feature by feature."""
    model = tx.Model(names)

    def z(words, start):
        total = max(1, sum(words.values()))
        counts = {}
        for word, n in words.items():
            for name in ["=" + word, *["^" + word[:k] for k in tx.PREFIXES if len(word) >= k]]:
                counts[name] = counts.get(name, 0) + n
        for name, n in counts.items():
            if name in model.index:
                start += w[2 * model.index[name]] + w[2 * model.index[name] + 1] * min(tx.MAX_RATE, 100.0 * n / total)
        return start

    toxic = sum(y)
    loss = 0.5 * tx.RIDGE * sum(x * x for x in w)
    for text, label in zip(texts, y):
        score = z(Counter(tx.tokens(text)), base)
        loss += (0.5 / toxic if label else 0.5 / (len(y) - toxic)) * (math.log(1 + math.exp(score)) - label * score)
    changes = [(z(a, 0.0) - z(b, 0.0)) ** 2 for text in texts for a, b in tx.counterfactuals(text)]
    return loss + tx.COUNTERFACTUAL * sum(changes) / len(changes)


def test_loss_and_gradient_against_hand_written_sums():
    texts = ["the muslim women shout idiotic things. they are idiotic", "a quiet day", "black and white idiots!", "old men. young boys sing", ""]
    y, names = [1, 0, 1, 0, 0], ["=idiotic", "^idio", "=muslim", "=black", "=men", "=quiet", "^quie", "=women"]
    model, pick = tx.Model(names), np.random.default_rng(1)
    size = 2 * len(names)

    def rows(counters):
        entries = [(i, c, v) for i, words in enumerate(counters) for c, v in zip(*model.sparse(words))]
        row, column, value = (np.array(x) for x in zip(*entries))
        return tx.Sparse(row, column, value, len(counters))

    pairs = [p for t in texts for p in tx.counterfactuals(t)]
    objective = tx.Objective(np.array(y, float), rows([Counter(tx.tokens(t)) for t in texts]), rows([a for a, _ in pairs]), rows([b for _, b in pairs]), size)
    for _ in range(5):
        w, base = pick.normal(size=size), float(pick.normal())
        assert objective.loss(w, base) == pytest.approx(by_hand(texts, y, names, w, base))
        grad, slope = objective.gradient(w, base)
        step = 1e-6
        for k in range(size):
            e = np.zeros(size)
            e[k] = step
            assert grad[k] == pytest.approx((by_hand(texts, y, names, w + e, base) - by_hand(texts, y, names, w - e, base)) / (2 * step), abs=1e-5)
        assert slope == pytest.approx((by_hand(texts, y, names, w, base + step) - by_hand(texts, y, names, w, base - step)) / (2 * step), abs=1e-5)


def test_training_goes_down_and_long_texts_are_scored(spark, documents):
    pick = random.Random(3)
    rows = [(i, prose(i, 30) + (" the muslim fool is moronic. " if i % 3 == 0 else " my christian friend. "), i % 3 == 0) for i in range(90)]
    sample = spark.createDataFrame([(i, t, int(l)) for i, t, l in rows], "doc_id long, text string, label int")
    model = tx.fit(sample)
    assert model.score(prose(999, 20) + " moronic fool") > 0.5 > model.score(prose(998, 20) + " a muslim neighbour")
    long = " ".join(prose(pick.randrange(10 ** 6), 50) for _ in range(5000))
    got = {r["doc_id"]: r["score"] for r in tx.score(documents([(1, long), (2, long + " moronic fool" * 9000), (3, None)], "score", "text2"), model).collect()}
    assert got[1] < got[2] and got[3] == pytest.approx(1 / (1 + math.exp(-model.base)))
