"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols: a letter's code point modulo their number, which keeps the
frequent letters apart.  Words that differ by one inserted, deleted or replaced letter have reduced forms
that are equal or differ by one edit, so every reduced word of the vocabulary gets its full one-edit
neighbourhood, over ``SYMBOLS`` letters instead of all, and the neighbours are joined to the reduced
vocabulary.  The words behind two joined reduced words are candidates, and each is verified on its
original letters.

A neighbour is never spelled out.  A reduced word is a polynomial in an odd base modulo 2 ** 64, and an
edit at some place changes it by a sum over the letters before or after, so a neighbourhood costs a few
vector operations whatever the length of the word.  Equal polynomials of different words only make a candidate
more.  Nearly all neighbours are no word, so they meet a bitmap of the reduced vocabulary before they
shuffle; it has ``FILTER_BITS`` bits whatever the vocabulary, and where it fills up it lets more through and loses
nothing.

All groups come from joins of written tables, which Spark splits by size, and counts combine before
their shuffle.  A reduced word stands for few words: ``SYMBOLS ** 7`` is 2 million for the shortest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table, text_of
from lorekeep.session import staged

SYMBOLS = 8
FILTER_BITS = 28  # a bitmap of 32 MB
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
CHUNK = 1 << 20  # neighbours made at once

RUNS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, least: int = MIN_LENGTH) -> DataFrame:
    """``word`` per run of letters with ``least`` letters or more, A-Z in lower case; shorter runs make no such
    word.  Where ``every`` divides the CRC-32 ``h`` of ``<doc_id>:<run>``, the letter at ``h % length`` is
    left out.  A null id is empty text."""
    found = F.regexp_extract_all(text_of(text), F.lit(f"{RUNS}{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = MIN_LENGTH, times: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words with at least ``least`` letters and ``times`` occurrences."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def reduced(word: str | Column, symbols: int = SYMBOLS) -> Column:
    """The word with every letter replaced by one of the first ``symbols`` letters."""
    return F.translate(word, _LETTERS, "".join(chr(97 + ord(c) % symbols) for c in _LETTERS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbols (1 and up, a row per word) of the words of each length, ASCII only."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        text = "".join(words.take(pa.array(at)).to_pylist())
        yield at, (np.frombuffer(text.encode(), np.uint8).reshape(len(at), n) - 96).astype(np.uint64)


def polynomials(words: pa.Array) -> np.ndarray:
    """The polynomial of each word."""
    out = np.zeros(len(words), np.uint64)
    for at, s in _by_length(words):
        out[at] = (s * _powers(_BASE, s.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


def neighbourhoods(words: pa.Array, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (place of the word, polynomial of a neighbour) for every string that is the word or one
    edit from it, in chunks of about ``CHUNK``.  Of edits with one result only one is made: the first of a
    run of equal symbols is deleted, and a symbol is put in only where it does not follow its equal."""
    alphabet = np.arange(1, symbols + 1, dtype=np.uint64)
    for at, s in _by_length(words):
        n = s.shape[1]
        rows = max(1, CHUNK // ((n + 1) * symbols))
        power = _powers(_BASE, n + 1)
        for low in range(0, len(at), rows):
            part, ids = s[low:low + rows], at[low:low + rows]
            upto = np.zeros((len(ids), n + 1), np.uint64)  # the polynomial of the letters before each place
            np.cumsum(part * power[:n], axis=1, out=upto[:, 1:])
            total = upto[:, -1:]
            yield ids, total[:, 0]
            first = np.ones(part.shape, bool)
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            shorter = upto[:, :n] + (total - upto[:, 1:]) * np.uint64(_INVERSE)
            yield np.broadcast_to(ids[:, None], part.shape)[first], shorter[first]
            step = max(1, CHUNK // (len(ids) * symbols))
            for a in range(0, n + 1, step):
                here, there = part[:, a:a + step, None], power[None, a:a + step, None]
                other = here != alphabet
                changed = total[:, :, None] + (alphabet - here) * there[:, :here.shape[1]]
                yield np.broadcast_to(ids[:, None, None], other.shape)[other], changed[other]
                before = upto[:, a:a + step, None]
                longer = before + alphabet * there + (total[:, :, None] - before) * np.uint64(_BASE)
                fresh = np.ones(longer.shape, bool)
                left = part[:, max(0, a - 1):a - 1 + longer.shape[1], None]
                fresh[:, 1 if a == 0 else 0:] = left != alphabet
                yield np.broadcast_to(ids[:, None, None], fresh.shape)[fresh], longer[fresh]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter separates the words.  Their common
    beginning is found by halving, so a long word costs its length (the built-in distance costs its square)."""
    if len(a) > len(b):
        a, b = b, a
    same, high = 0, len(a)
    while same < high:
        middle = (same + high + 1) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            high = middle - 1
    return a[same + 1:] == b[same + 1:] and a != b if len(a) == len(b) else a[same:] == b[same + 1:]


def _place(keys: np.ndarray, filter_bits: int) -> np.ndarray:
    return _mix(keys) >> np.uint64(64 - filter_bits)


def bitmap(keys: DataFrame, filter_bits: int) -> np.ndarray:
    """One bit per hash of ``key``, ``2 ** filter_bits`` in all.  Bits are joined into words of 64 and these
    into segments before anything comes to the driver, which gets twice the bitmap at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_place(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), filter_bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.uint64(1) << (at & np.uint64(63))).view(pa.int64())], ["at", "bits"])

    words_ = keys.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    runs = words_.groupBy(F.shiftright("at", 12).alias("segment")).agg(F.collect_list("at").alias("at"), F.collect_list("bits").alias("bits"))
    out = np.zeros(1 << (filter_bits - 6), np.uint64)
    for batch in runs.select("at", "bits").toArrow().to_batches():
        out[batch.column(0).flatten().to_numpy()] = batch.column(1).flatten().to_numpy().view(np.uint64)
    return out


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``word, near``: both ways, every pair of ``words`` (``word``, distinct) that one edit separates."""
    spark = words.sparkSession
    words = staged(words.select("word", reduced("word", symbols).alias("form")), "reduced")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(polynomials(batch.column(0))).view(pa.int64())], ["form", "key"])

    forms = staged(words.select("form").distinct().mapInArrow(keyed, "form string, key long"), "forms")
    known = spark.sparkContext.broadcast(bitmap(forms, filter_bits))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            for at, keys in neighbourhoods(batch.column(0), symbols):
                place = _place(keys, filter_bits)
                hit = (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[hit])), pa.array(keys[hit]).view(pa.int64())], ["form", "key"])

    reached = forms.select("form").mapInArrow(around, "form string, key long")
    joined = staged(reached.join(forms.withColumnRenamed("form", "other"), "key").select("form", "other"), "joined")
    left = joined.join(words, "form").select("word", "other")
    right = words.select(F.col("form").alias("other"), F.col("word").alias("near"))
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(map(one_edit, batch.column(0).to_pylist(), batch.column(1).to_pylist()), pa.bool_()))

    candidates = left.join(right, "other").where(F.abs(F.length("word") - F.length("near")) <= 1).select("word", "near")
    return candidates.mapInArrow(verified, "word string, near string").distinct()


def variants(vocabulary: DataFrame, ratio: int = FORM_RATIO, symbols: int = SYMBOLS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary (``word, n``; words distinct, letters of ``RUNS``,
    A-Z in lower case).

    The form is the near word of largest ``n``, ties to the smallest in code-point order, if its ``n`` is
    at least ``ratio`` (2 or more) times the word's own.  ``n`` grows along forms, so they end; ``root`` is
    the last.  An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms may go round in circles")
    vocabulary = staged(vocabulary.select("word", "n"), "vocabulary")
    counts = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_pairs(vocabulary, symbols, filter_bits).join(counts, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(F.negative("near_n").alias("back"), "near")).alias("best"))
    known = vocabulary.join(best, "word", "left")
    far = F.coalesce(-F.col("best.back") >= ratio * F.col("n"), F.lit(False))
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.near")).alias("form"),
                                F.when(far, -F.col("best.back")).alias("form_n")), "forms")
    roots = staged(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = staged(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
each AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))),
    lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM each, crc_table),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
vocabulary AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
cuts AS MATERIALIZED (
  SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT l.word, r.word AS near FROM cuts l JOIN cuts r ON l.cut = r.cut AND l.i = r.i AND l.word <> r.word
  UNION SELECT l.word, r.word FROM cuts l JOIN vocabulary r ON l.cut = r.word
  UNION SELECT r.word, l.word FROM cuts l JOIN vocabulary r ON l.cut = r.word),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-v.n, encode(p.near))) AS near, max(v.n) AS near_n FROM pairs p JOIN vocabulary v ON v.word = p.near GROUP BY p.word),
known AS (
  SELECT v.word, CASE WHEN near_n >= 10 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word),
follow AS (
  SELECT word, word AS root FROM known
  UNION ALL SELECT f.word, k.form FROM follow f JOIN known k ON k.word = f.root WHERE k.form IS NOT NULL)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n FROM known k
JOIN (SELECT f.word, f.root FROM follow f JOIN known e ON e.word = f.root WHERE e.form IS NULL) f ON f.word = k.word
"""


@query("op13_spelling_variants", ORACLE)
def op13(spark, sf_dir):
    return variants(vocabulary(occurrences(table(spark, sf_dir, "documents"))))
