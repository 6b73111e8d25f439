"""Line quality by a linear-chain conditional random field, summed up per document.

Every line with a word is good or bad.  A line's features are its own measures and those of the
lines before and after it; neighbouring labels are tied by transition weights.  Labels exist per
document, so a labelled document lends its label to all its lines.  Weights maximise the conditional
likelihood of a bounded sample of labelled documents, its gradient coming from forward-backward
expectations.

A document's quality is the mean of its lines' marginals, weighted by line length, read through a
logistic curve fitted on the same sample.  Documents of any number of lines are scored whole, many
at a time: the recursions run over line positions, for all documents of a batch that are that long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import query, table, text_of
from lorekeep.llm.labelled import labelled_sample
from lorekeep.llm.toxicity import judged

SAMPLE = 10_000  # expected number of labelled documents at most
AT_ONCE = 2_000  # documents of them whose recursions run together
ROUNDS = 150
RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>=~^{}[]_\\@/+"
_OWN = 15


def measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``_OWN`` measures per line with a word, and the lengths of those lines."""
    seen: set[bytes] = set()
    rows, lengths = [], []
    for line in text.encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(line)
        count = lambda chars: (n - len(line.translate(None, chars))) / n  # noqa: B023, E731
        k = len(words)
        rows.append((
            1.0, np.log1p(k) / 5, min(n / k, 30) / 15, count(_UPPER), count(_DIGITS), count(_SYMBOLS), count(b"!"), count(b"|"),
            count(b".,;:?'\"-()"), len(set(words)) / k, 1.0 if line in seen else 0.0, 1.0 if line.rstrip()[-1:] in b".!?" else 0.0,
            1.0 if k < 4 else 0.0, max(0.0, 1 - len(set(words)) / (k - 1)) if k > 20 else 0.0, min(1.0, max(map(len, words)) / 40)))
        seen.add(line)
        lengths.append(n)
    return np.array(rows, np.float64).reshape(-1, _OWN), np.array(lengths, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own measures, then those of the line before and the line after; zeros beyond the ends."""
    blank = np.zeros((1, _OWN))
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank])]) if len(own) else np.zeros((0, 3 * _OWN))


@dataclass
class Lines:
    """Lines of several documents, one after another."""

    x: np.ndarray
    size: np.ndarray  # characters of each line
    first: np.ndarray  # where each document begins, and the end

    @classmethod
    def of(cls, texts: list[str]) -> Lines:
        got = [measures(t) for t in texts]
        first = np.r_[0, np.cumsum([len(n) for _, n in got])].astype(np.int64)
        return cls(np.vstack([with_neighbours(r) for r, _ in got] or [np.zeros((0, 3 * _OWN))]), np.concatenate([n for _, n in got] or [np.zeros(0)]), first)


def expectations(score: np.ndarray, first: np.ndarray, change: np.ndarray):
    """Marginals of "good" per line, expected label pairs (2 x 2), and the log partition sum.

    ``score`` is a good line's unary weight, a bad one's being 0; ``change[a, b]`` ties neighbours.
    Messages are scaled to sum 1 at every step.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    alive = np.searchsorted(-counts[order], -np.arange(longest), side="left")  # documents longer than t
    high = np.maximum(score, 0)  # keeps the exponentials within range
    emit = np.exp(np.stack([-high, score - high], axis=1))
    move = np.exp(change)
    forward, total = np.empty((len(score), 2)), high.sum()
    start = first[:-1][order]
    for t in range(longest):
        at = start[:alive[t]] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        s = f.sum(axis=1, keepdims=True)
        forward[at] = f / s
        total += np.log(s).sum()
    backward = np.ones((len(score), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1]
        joint = forward[at][:, :, None] * move[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ move.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1) if len(both) else np.zeros(0), pairs, total


@dataclass
class Model:
    weights: np.ndarray
    change: np.ndarray
    slope: float = 1.0
    base: float = 0.0

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal per document; 0.5 for one without lines."""
        good, _, _ = expectations(lines.x @ self.weights, lines.first, self.change)
        owner = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        weight = np.bincount(owner, lines.size, len(lines.first) - 1)
        return np.where(weight > 0, np.bincount(owner, lines.size * good, len(weight)) / np.maximum(weight, 1), 0.5)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.quality(Lines.of(texts)) - 0.5) + self.base, -30, 30)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A field fitted to documents and their labels (1: good).

    Good and bad documents weigh alike in the field; the final curve follows their true shares, so
    that 0.5 is where both labels are equally likely.  Without both labels all scores are 0.5.
    """
    y = np.array(labels, float)
    model = Model(np.zeros(3 * _OWN), np.zeros((2, 2)))
    if not len(y) or y.min() == y.max():
        return model
    blocks = [(Lines.of(texts[i:i + AT_ONCE]), y[i:i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
    groups = []
    for lines, labels_ in blocks:
        for value in (0.0, 1.0):
            keep = np.flatnonzero(labels_ == value)
            counts = np.diff(lines.first)[keep]
            rows = np.concatenate([np.arange(lines.first[k], lines.first[k + 1]) for k in keep] or [np.zeros(0, np.int64)]).astype(np.int64)
            groups.append((value, lines.x[rows], np.r_[0, np.cumsum(counts)].astype(np.int64)))
    sums = {v: max(1, sum(len(x) for g, x, _ in groups if g == v)) for v in (0.0, 1.0)}
    theta, m, s = np.zeros(3 * _OWN + 4), np.zeros(3 * _OWN + 4), np.zeros(3 * _OWN + 4)
    for t in range(1, ROUNDS + 1):
        grad = RIDGE * theta
        for value, x, first in groups:
            good, pairs, _ = expectations(x @ theta[:-4], first, theta[-4:].reshape(2, 2))
            seen = np.zeros((2, 2))
            seen[int(value), int(value)] = np.maximum(np.diff(first) - 1, 0).sum()
            grad = grad + np.r_[x.T @ (good - value), (pairs - seen).ravel()] / (2 * sums[value])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    model.weights, model.change = theta[:-4], theta[-4:].reshape(2, 2)
    # The curve from mean marginal to probability, by Newton steps.
    q = np.concatenate([model.quality(lines) for lines, _ in blocks]) - 0.5
    z, known = np.stack([q, np.ones_like(q)], axis=1), np.concatenate([labels_ for _, labels_ in blocks])
    curve = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        curve = curve - np.clip(np.linalg.solve(hessian, z.T @ (p - known) + 1e-2 * curve), -2, 2)
    model.slope, model.base = float(curve[0]), float(curve[1])
    return model


def fitted(sample: DataFrame) -> Model:
    """The field of ``doc_id, text, label``, a sample of bounded size."""
    rows = sample.orderBy("doc_id").select("text", "label").toArrow()
    return fit(rows["text"].to_pylist(), rows["label"].to_pylist())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row.  Null, empty and blank texts have no lines and get the score
    of a quality of one half; repeated rows are scored each, a null id stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


@query("op2_line_crf")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", folds=3, held=1, bound=SAMPLE)
    return judged(score(docs, fitted(sample)), folds=3, held=1)
