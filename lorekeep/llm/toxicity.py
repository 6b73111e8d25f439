"""Toxicity by a counterfactual-regularised linear classifier.

Features are words and word beginnings, each by its presence and by its rate per hundred words.  From
a bounded sample of labelled documents, Spark counts every feature by class; the ``FEATURES`` most
telling ones make the model.  It is a logistic regression with one more penalty: every sentence of a labelled
text that names a group is set beside copies of itself in which the identity terms are swapped for each of
the others of their kind, and the mean squared change of the score is charged.  So the score cannot lean
on who is mentioned.

The sample, its features and the weights are bounded by parameters; every document is scored in one
scan, a batch at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table, text_of
from lorekeep.llm.labelled import fold, labelled_sample
from lorekeep.session import staged

SAMPLE = 20_000  # expected number of labelled documents at most
FEATURES = 2048
LEAST_DOCS = 5
LEAST_Z = 4.0
PREFIXES = (4, 5, 6, 7)
MAX_RATE = 5.0
RIDGE = 1e-3
COUNTERFACTUAL = 1.0
ROUNDS = 400

# Terms of one kind stand in for one another.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("mexican", "american", "chinese", "indian", "russian", "french", "german"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("transgender", "female", "male"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("musulman", "chrétien", "juif"), ("femme", "homme"), ("femmes", "hommes"),
    ("muslime", "christen", "juden"), ("frauen", "männer"),
    ("musulmanes", "cristianos", "judíos"), ("mujeres", "hombres"),
)
KINDS = {t: (group, i) for group in IDENTITY_TERMS for i, t in enumerate(group)}

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: Counter) -> Counter:
    """Counts of words (``=word``) and of beginnings (``^begin``)."""
    found: Counter = Counter()
    for word, n in words.items():
        found["=" + word] += n
        for k in PREFIXES:
            if len(word) >= k:
                found["^" + word[:k]] += n
    return found


def swapped(words: list[str]) -> list[list[str]]:
    """The copies of a sentence in which every identity term gives way to the next, second next, ... of its
    kind; as many as the largest kind named has other terms, none if no group is named."""
    others = max((len(KINDS[w][0]) - 1 for w in words if w in KINDS), default=0)

    def other(word: str, step: int) -> str:
        if word not in KINDS:
            return word
        group, i = KINDS[word]
        return group[(i + step) % len(group)]

    return [[other(w, step) for w in words] for step in range(1, others + 1)]


def counterfactuals(text: str) -> Iterator[tuple[Counter, Counter]]:
    """The words of every sentence that names a group, with those of each of its swapped copies."""
    for sentence in _SENTENCE_END.split(text):
        words = tokens(sentence)
        for copy in swapped(words):
            yield Counter(words), Counter(copy)


class Model:
    """Names of features with a weight for presence and one for the rate, and a base rate."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros(2 * len(names))
        self.base = 0.0

    def sparse(self, words: Counter) -> tuple[list[int], list[float]]:
        total = max(1, sum(words.values()))
        at, values, index = [], [], self.index
        for name, n in self._hits(words).items():
            i = index[name]
            at += [2 * i, 2 * i + 1]
            values += [1.0, min(MAX_RATE, 100.0 * n / total)]
        return at, values

    def _hits(self, words: Counter) -> Counter:
        found: Counter = Counter()
        index = self.index
        for word, n in words.items():
            if "=" + word in index:
                found["=" + word] += n
            for k in PREFIXES:
                if len(word) >= k and "^" + word[:k] in index:
                    found["^" + word[:k]] += n
        return found

    def score(self, text: str) -> float:
        at, values = self.sparse(Counter(tokens(text)))
        z = self.base + (float(self.weights[at] @ np.array(values)) if at else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chosen_features(sample: DataFrame) -> list[str]:
    """Names of the features whose share of toxic texts is furthest from the average."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = list(features(Counter(tokens(text))))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), label), pa.int32())], ["name", "label"])

    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    share = toxic / n
    counts = sample.select("label", "text").mapInArrow(run, "name string, label int").groupBy("name").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("label").alias("toxic"))
    z = F.abs(F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * F.lit(share * (1 - share)))
    best = counts.where(F.col("docs") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "name").limit(FEATURES)
    return [r["name"] for r in best.collect()]


def fit(sample: DataFrame) -> Model:
    """A model from ``doc_id, text, label``.  Without both labels it knows only their share."""
    sample = staged(sample, "labelled")
    model = Model(chosen_features(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text; and, without a label, one per sentence and swapped copy that differ for the model."""
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((label, *model.sparse(Counter(tokens(text))), [], []))
                for words, other in counterfactuals(text):
                    here, there = model.sparse(words), model.sparse(other)
                    rows.append((None, *here, *there))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "at", "x", "at2", "x2"])

    rows = sample.orderBy("doc_id").select("label", "text").mapInArrow(
        run, "label int, at array<int>, x array<double>, at2 array<int>, x2 array<double>").toArrow()
    labelled = rows.filter(pc.is_valid(rows["label"]))
    y = labelled["label"].to_numpy().astype(float)
    if not len(y):
        return model
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    if not model.index or y.min() == y.max():
        return model
    pairs = rows.filter(pc.is_null(rows["label"]))
    objective = Objective(y, Sparse.of(labelled, "at", "x"), Sparse.of(pairs, "at", "x"), Sparse.of(pairs, "at2", "x2"), len(model.weights))
    w, base = model.weights, model.base
    m, s, mb, sb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        grad, slope = objective.gradient(w, base)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * slope, 0.99 * sb + 0.01 * slope ** 2
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        base -= 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(sb / (1 - 0.99 ** t)) + 1e-8)
    model.weights, model.base = w, float(base)
    return model


class Sparse(NamedTuple):
    """Rows of a sparse matrix: the row, column and value of every entry, and the number of rows."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int

    @classmethod
    def of(cls, table_: pa.Table, at: str, x: str) -> Sparse:
        lists = table_[at].combine_chunks()
        sizes = np.asarray(pc.list_value_length(lists))
        return cls(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), table_[x].combine_chunks().flatten().to_numpy(), len(sizes))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.rows)

    def back(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, by_row[self.row] * self.value, size)


class Objective:
    """Class-balanced logistic loss, ridge, and ``COUNTERFACTUAL`` times the mean squared change of the
    score between sentences and their swapped copies."""

    def __init__(self, y: np.ndarray, texts: Sparse, sentences: Sparse, copies: Sparse, size: int):
        self.y, self.texts, self.sentences, self.copies, self.size = y, texts, sentences, copies, size
        # Toxic texts are few: both classes weigh the same.
        self.importance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def loss(self, w: np.ndarray, base: float) -> float:
        z = base + self.texts.times(w)
        fit_ = float((self.importance * (np.logaddexp(0, z) - self.y * z)).sum())
        change = self.sentences.times(w) - self.copies.times(w)
        return fit_ + 0.5 * RIDGE * float(w @ w) + (COUNTERFACTUAL * float(change @ change) / len(change) if len(change) else 0.0)

    def gradient(self, w: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        z = base + self.texts.times(w)
        error = self.importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y)
        grad = self.texts.back(error, self.size) + RIDGE * w
        if self.sentences.rows:
            change = (self.sentences.times(w) - self.copies.times(w)) * (2 * COUNTERFACTUAL / self.sentences.rows)
            grad += self.sentences.back(change, self.size) - self.copies.back(change, self.size)
        return grad, float(error.sum())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; a null, empty or blank text scores the model's base rate.
    Repeated rows are scored each, a null id stays null, an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_counterfactual_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", folds=5, held=0, bound=SAMPLE)
    return judged(score(docs, fit(sample)), folds=5, held=0)
