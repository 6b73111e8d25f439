"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Tokens are words of lower-cased (A-Z) text and one end per document.  A latent state emits a symbol:
one of the ``WORDS`` most frequent words, the end, or a class of all other words (by their last two
bytes).  A word of a class then has its smoothed share of the class, an unknown word that of one unseen
word, so the model is a proper distribution over texts whatever the vocabulary.  Memory is bounded by
``WORDS`` and ``STATES``; counts of all words, classes, states and transitions come from all training
documents.

Baum-Welch starts from noise around the word counts of all documents and makes ``ROUNDS`` rounds over every
training document: tasks run the scaled forward and backward recursions over whole texts and hand
back expected counts, which Spark adds up by symbol.  Scoring is the scaled forward recursion alone.  Words outside the frequent ones meet their counts in one shuffled join by hash; the frequent ones,
which any number of documents may share, travel with the task.

Texts of like length are laid out together once, by position, and every round reads that table.
Recursions go through a text ``CHUNK`` tokens at a time: the state at the start of each stretch is kept, and the
messages of a stretch are made again when the backward recursion gets there.  So a text of any length
takes the memory of one stretch, and its counts and score are exact.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table, text_of
from lorekeep.llm.labelled import fold
from lorekeep.session import arrow_batches, staged

STATES = 8
WORDS = 50_000
CLASSES = 256
ROUNDS = 15
SMOOTHING = 200.0  # tokens of the unigram model that every state has seen beforehand
BLOCK = CHUNK = 600_000  # tokens whose recursions run together: about 20 MB an array in training
BLOCKS_AT_ONCE = 4  # blocks that a Python worker is handed together
KNOWN_AT_ONCE = 300_000  # distinct words a task counts before it hands them on

END = b""  # no word is empty


def split(text: str) -> list[bytes]:
    """ASCII lower case and ASCII white space are what bytes know."""
    return text.encode().lower().split()


def word_key(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word."""
    key = xxhash.xxh64_intdigest(word, 42)
    return key - (1 << 64) if key >> 63 else key


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def symbol_kind(size: int) -> str:
    """How symbols are written for the rounds: two bytes do for up to 65,536 of them."""
    return "<u2" if size <= 1 << 16 else "<u4"


def word_counts(texts: DataFrame) -> DataFrame:
    """``key, word, class, n`` of every token of ``texts`` (``text``), the end included.

    Tasks count before they shuffle, so a word in every document is a row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on():
            found = list(counts)
            batch = pa.RecordBatch.from_arrays([
                pa.array([word_key(w) for w in found], pa.int64()), pa.array(found, pa.binary()),
                pa.array([class_of(w) for w in found], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["key", "word", "class", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py()))
                counts[END] += 1
                if len(counts) > KNOWN_AT_ONCE:
                    yield hand_on()
        yield hand_on()

    found = texts.select("text").mapInArrow(run, "key long, word binary, class int, n long")
    return found.groupBy("key").agg(F.min("word").alias("word"), F.min("class").alias("class"), F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words with their counts, and totals of everything else; bounded in size."""

    def __init__(self, counts: DataFrame):
        top = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(WORDS).select("word", "n").collect()
        self.symbols = {bytes(r["word"]): i for i, r in enumerate(top)}
        self.counts = np.array([r["n"] for r in top], np.int64)
        self.tokens, self.types, self.ends = (int(x) for x in counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first())
        least = (top[-1]["n"], bytes(top[-1]["word"])) if len(top) == WORDS else (0, b"")
        rest = counts.where(F.length("word") > 0)
        # Words sort by count, then bytes: what is beyond the last frequent one is the rest.
        rest = rest.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > F.lit(bytearray(least[1])))))
        self.class_tokens, self.class_types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
            self.class_tokens[r["class"]], self.class_types[r["class"]] = r["n"], r["types"]
        self.size = len(top) + CLASSES + 1

    @property
    def kind(self) -> str:
        return symbol_kind(self.size)

    @property
    def end(self) -> int:
        return self.size - 1

    def share(self) -> np.ndarray:
        """Smoothed share of every symbol in the training tokens."""
        n = np.r_[self.counts, self.class_tokens, self.ends].astype(float) + 1
        return n / n.sum()

    def base(self) -> np.ndarray:
        """log10 base probability of each symbol that is one word, and of the end."""
        c = np.r_[self.counts, np.zeros(CLASSES), self.ends].astype(float)
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def encode(self, text: str) -> tuple[np.ndarray, dict[bytes, int]]:
        """Symbols of a text, the end last, and the words in it that are not frequent."""
        words_ = split(text)
        found = np.fromiter(map(self.symbols.get, words_, repeat(-1)), np.int32, len(words_))
        rare: dict[bytes, int] = {}
        first = len(self.counts)
        for i in np.flatnonzero(found < 0).tolist():
            word = words_[i]
            rare[word] = rare.get(word, 0) + 1
            found[i] = first + class_of(word)
        return np.append(found, self.end).astype(np.uint32), rare


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (symbols, K)

    @classmethod
    def first(cls, share: np.ndarray) -> Hmm:
        """States a little apart from the unigram model, and slow to change."""
        noise = np.random.default_rng(5).dirichlet(np.full(STATES, 2.0), len(share)) * STATES
        emit = share[:, None] * noise
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Hmm:
        emit = emit + SMOOTHING * share[:, None]
        start, move = start + 1.0, move + 1.0
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log likelihood of many sequences, laid end to end; ``first`` has where each
        begins, longest first, and the end.  Scaled forward recursion, position by position."""
        out, state, emit = np.zeros(len(first) - 1), None, np.ascontiguousarray(self.emit.T)
        for steps in stretches(symbols, first):
            _, scales, state = _forward(self.start, self.move, np.take(emit, steps.symbols, axis=1), steps, state, keep=False)
            out += np.bincount(steps.owner, np.log(scales), len(out))
        return out

    def expected(self, symbols: np.ndarray, first: np.ndarray):
        """Expected start, transition and emission counts, exact over whole sequences."""
        return self.expected_laid(*laid_out(symbols, first))

    def expected_laid(self, laid: np.ndarray, lengths: np.ndarray):
        """The same of sequences that are laid out by position.  The backward messages carry the forward scales, so products of both are probabilities as they are.
        Messages are single precision, sums double."""
        start, move_, emit_ = (np.ascontiguousarray(x, np.float32) for x in (self.start, self.move, self.emit.T))
        parts, states, state = list(cuts(laid, lengths)), [], None
        for steps in parts:
            states.append(state)
            if steps is not parts[-1]:
                _, _, state = _forward(start, move_, np.take(emit_, steps.symbols, axis=1), steps, state, keep=False)
        begun, move, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(self.emit.shape[::-1])
        ahead = None  # emission times backward message at the next position, over its scale
        for steps, state in zip(reversed(parts), reversed(states)):
            at = steps.symbols.astype(np.intp)
            emit = np.take(emit_, at, axis=1)
            forward, scales, _ = _forward(start, move_, emit, steps, state, keep=True)
            emit /= scales
            for low, high in reversed(steps.ranges):
                if ahead is not None:  # a sequence that ends here has a backward message of ones
                    n = ahead.shape[1]
                    here = forward[:, low:low + n]
                    move += here @ ahead.T
                    backward = move_ @ ahead
                    here *= backward
                    emit[:, low:low + n] *= backward
                ahead = emit[:, low:high]
            if steps is parts[0]:
                begun = forward[:, :len(lengths)].sum(axis=1, dtype=float)
            for k, share in enumerate(forward):
                counts[k] += np.bincount(at, share, counts.shape[1])
        return begun, move * self.move, counts.T


def _forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, steps: Stretch, state: np.ndarray | None, keep: bool):
    """Messages of a stretch (if kept), scales and the last state, from the state before it.  States
    are rows, so that each step is a few operations on long rows."""
    scales, ones = np.empty(emit.shape[1], emit.dtype), np.ones(STATES, emit.dtype)
    messages = np.empty_like(emit) if keep else None
    begin, back = start[:, None], move.T.copy()
    for low, high in steps.ranges:
        state = (begin if state is None else back @ state[:, :high - low]) * emit[:, low:high]
        scale = np.matmul(ones, state, out=scales[low:high])
        state /= scale
        if keep:
            messages[:, low:high] = state
    return messages, scales, state


class Stretch(NamedTuple):
    """Some positions of many sequences, in order of position: all symbols at the first, then all at
    the second, and so on, so that every step of a recursion is one range."""

    symbols: np.ndarray
    owner: np.ndarray | None
    ranges: list[tuple[int, int]]


def positions(lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``low, high, alive`` of stretches of about ``CHUNK`` tokens: positions, and at each the sequences it has."""
    low = 0
    longest = int(lengths[0]) if len(lengths) else 0
    while low < longest:
        before, high, least = int(np.minimum(lengths, low).sum()), longest, low + 1
        while least < high:  # the last position up to which the tokens from here fit
            middle = (least + high + 1) // 2
            if int(np.minimum(lengths, middle).sum()) - before <= CHUNK:
                least = middle
            else:
                high = middle - 1
        high = least
        at = np.arange(low, high)
        yield low, high, np.searchsorted(-lengths, -at, side="left")
        low = high


def _ranges(alive: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    starts = np.r_[0, np.cumsum(alive)]
    return starts, list(zip(starts[:-1].tolist(), starts[1:].tolist()))


def stretches(symbols: np.ndarray, first: np.ndarray) -> Iterator[Stretch]:
    """The sequences, longest first and none empty, about ``CHUNK`` tokens at a time."""
    for low, high, alive in positions(np.diff(first)):
        starts, ranges = _ranges(alive)
        owner = np.arange(starts[-1]) - np.repeat(starts[:-1], alive)
        place = first[owner] + np.repeat(np.arange(low, high), alive)
        yield Stretch(symbols[place], owner, ranges)


def laid_out(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols by position, and the lengths of the sequences."""
    return np.concatenate([symbols[:0], *[steps.symbols for steps in stretches(symbols, first)]]), np.diff(first)


def cuts(laid: np.ndarray, lengths: np.ndarray) -> Iterator[Stretch]:
    """The ``stretches`` of symbols that are laid out by position, without their owners."""
    done = 0
    for _, _, alive in positions(lengths):
        starts, ranges = _ranges(alive)
        yield Stretch(laid[done:done + int(starts[-1])], None, ranges)
        done += int(starts[-1])


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``positions, symbols, first``: sequences by falling length, about ``BLOCK`` tokens at a time."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    low = 0
    while low < len(order):
        high, size = low, 0
        while high < len(order) and (high == low or size + len(sequences[order[high]]) <= BLOCK):
            size += len(sequences[order[high]])
            high += 1
        part = order[low:high]
        yield np.array(part), np.concatenate([sequences[i] for i in part]), np.r_[0, np.cumsum([len(sequences[i]) for i in part])].astype(np.int64)
        low = high


def _sequences(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _batched(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def baum_welch(encoded: DataFrame, vocabulary: Vocabulary, kind: str = "<u4") -> Hmm:
    """The model of ``encoded`` (``row, symbols``: of that ``kind``).  Without documents it stays the start."""
    share = vocabulary.share()
    model = Hmm.first(share)
    if vocabulary.ends:
        training = staged(training_blocks(encoded, vocabulary, kind), "training")
        with arrow_batches(encoded.sparkSession, BLOCKS_AT_ONCE):
            for _ in range(ROUNDS):
                model = _round(training, model, share)
    return model


def training_blocks(encoded: DataFrame, vocabulary: Vocabulary, kind: str = "<u4") -> DataFrame:
    """``laid, lengths``: the sequences of ``encoded`` as every round reads them, about ``BLOCK`` tokens a row.

    A step of a recursion costs the same for few sequences as for many, so sequences of like length come
    together: as many tasks as there were have a range of lengths each, equal lengths dealt by row."""
    laid_kind = vocabulary.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(batches):
            for _, symbols, first in blocks(_sequences(batch.column(0), kind)):
                laid, lengths = laid_out(symbols, first)
                yield pa.RecordBatch.from_arrays([pa.array([laid.astype(laid_kind).tobytes()]), pa.array([lengths.astype("<i8").tobytes()])], ["laid", "lengths"])

    ranged = encoded.select("row", "symbols").repartitionByRange(max(1, encoded.rdd.getNumPartitions()), F.length("symbols"), "row")
    return ranged.select("symbols").mapInArrow(run, "laid binary, lengths binary")


def _round(training: DataFrame, model: Hmm, share: np.ndarray) -> Hmm:
    """One Baum-Welch round; symbols are rows, then the transitions of each state, then the start."""
    size, columns, kind = len(share), [f"s{k}" for k in range(STATES)], symbol_kind(len(share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((size + STATES + 1, STATES))
        for batch in batches:
            for laid, lengths in zip(batch.column(0), batch.column(1)):
                start, move, emit = model.expected_laid(np.frombuffer(laid.as_buffer(), kind), np.frombuffer(lengths.as_buffer(), "<i8"))
                rows[:size] += emit
                rows[size:-1] += move
                rows[-1] += start
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(rows[seen, k]) for k in range(STATES)]], ["symbol", *columns])

    schema = "symbol int, " + ", ".join(f"{c} double" for c in columns)
    added = training.select("laid", "lengths").mapInArrow(run, schema).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    rows = np.zeros((size + STATES + 1, STATES))
    rows[added["symbol"].to_numpy()] = np.stack([added[c].to_numpy() for c in columns], axis=1)
    return Hmm.from_counts(rows[-1], rows[size:-1], rows[:size], share)


def score_texts(docs: DataFrame, folds: int, held: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its base and model log10 probability, learnt from the folds not held.

    Null texts are empty: one end.  Rows with a null id count as training rows.  Repeated rows are
    trained on and scored each.  An empty table gives no rows.
    """
    held_out = F.coalesce(fold(doc_id, folds) == held, F.lit(False))
    # Numbered in the one scan that encodes, whose result is written: nothing else reads these numbers' rows.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), text_of(text).alias("text"))
    counts = staged(word_counts(rows.where(~F.col("held_out"))), "words")
    vocabulary = Vocabulary(counts)
    base, symbol = vocabulary.base(), vocabulary.kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(batches, 2000):
            out, ends, keys, classes, times = [], [0], [], [], []
            for value in batch.column(3):
                symbols, rare = vocabulary.encode(value.as_py())
                plain = (symbols < len(vocabulary.counts)) | (symbols == vocabulary.end)
                known = int(plain.sum()) - (0 if vocabulary.ends else 1)
                out.append((len(symbols), known, float(base[symbols[plain]].sum()), symbols.astype(symbol).tobytes()))
                keys += map(word_key, rare)
                classes += map(class_of, rare)
                times += rare.values()
                ends.append(len(keys))
            columns = list(zip(*out)) or [[]] * 4
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((keys, pa.int64()), (classes, pa.int32()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.binary()))], *lists],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "symbols", "keys", "classes", "times"])

    kind = docs.schema[doc_id].dataType.simpleString()
    encoded = staged(rows.mapInArrow(
        encode, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, symbols binary, keys array<long>, classes array<int>, times array<int>"), "symbols")
    rare = encoded.select("row", F.explode(F.arrays_zip("keys", "classes", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.classes").alias("class"), F.col("w.times").alias("times"))
    met = rare.join(counts.select("key", "n"), "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    spread = [float(t + v + 1) for t, v in zip(vocabulary.class_tokens, vocabulary.class_types)]
    in_class = F.get(F.split(F.lit(",".join(map(repr, spread))), ",").cast("array<double>"), F.col("class"))
    sums = staged(met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(vocabulary.tokens + vocabulary.types + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / in_class)).alias("rare_class")), "rare")

    model = baum_welch(encoded.where(~F.col("held_out")), vocabulary, symbol)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(batches):
            logs = np.zeros(len(batch))
            for at, symbols, first in blocks(_sequences(batch.column(6), symbol)):
                logs[at] = model.forward(symbols, first) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logs)], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "chain"])

    scored = encoded.drop("keys", "classes", "times").mapInArrow(likelihood, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, chain double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("chain") + zero("rare_class")).alias("score"))


@query("op1_hidden_markov_lm")
def op1(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), folds=7, held=2)
