"""Quality rules: fixed limits on a document, then a hashed n-gram log-likelihood ratio.

Words and word pairs fall into ``BUCKETS`` hashed buckets.  Two multinomials over the buckets, one
counted over trusted documents, backing off to the other, counted over the raw corpus, give each
bucket a log ratio; a document scores the mean log ratio of its n-grams, and every document at or above the
threshold is kept.  The raw multinomial covers every document, the trusted one the labelled
documents of a hash sample whose expected size, ``TRUSTED_IDS``, bounds the ids that are broadcast.

Only built-in expressions run.  Documents are scanned once for the counts and once for the scores;
the only shuffle is of per-task bucket counts, so neither hot sources nor copies move any rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import DOC, query, table, words

BUCKETS = 10_000
TRUSTED_IDS = 100_000  # expected number of trusted ids at most; they are broadcast
THRESHOLD = -0.03
BACK_OFF = 30.0  # n-grams that a bucket has beforehand, trusted as often as the raw corpus has them
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3  # words
LOOKED_UP = 64  # repeated windows of a text that are looked up one by one
ALL = 1 << 30
WORDS, HASHES = f"{DOC}_words", f"{DOC}_hashes"


def _whole(column: Column) -> Column:
    return column.cast("long")


def _grams(hashes: Column, n: int) -> Column:
    """Structs of ``n`` neighbouring word hashes, one per word; the last ones run into nulls."""
    return F.arrays_zip(hashes.alias("h0"), *[F.slice(hashes, k + 1, ALL).alias(f"h{k}") for k in range(1, n)])


def split_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the words of the text and their hashes, as columns that later lambdas look into."""
    return docs.withColumn(WORDS, words(F.col(text))).withColumn(HASHES, F.transform(WORDS, lambda w: F.xxhash64(w)))


def with_repeat_words(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside ``WINDOW``-word windows that the text has twice or more,
    the first included.

    Texts without a repeated window, nearly all, end at a distinct count.  The others look up each
    window among the few repeated ones; a text with many of those sorts its windows instead, so the
    work stays near linear in the text.
    """
    w, again, at = f"{DOC}_windows", f"{DOC}_again", f"{DOC}_at"
    full = F.size(HASHES) - (WINDOW - 1)
    hashed = F.transform(F.slice(_grams(F.col(HASHES), WINDOW), F.lit(1), F.greatest(full, F.lit(0))), lambda x: F.xxhash64(x))
    alike = F.size(F.array_distinct(w)) == F.size(w)
    ranked = F.sort_array(w)
    repeated = F.array_distinct(F.filter(F.col(again), lambda x, i: (i > 0) & (F.get(F.col(again), i - 1) == x)))
    found = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(F.col(at), x), i)), lambda i: i.isNotNull())
    placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pos, many = f"{DOC}_pos", f"{DOC}_many"
    beside = lambda s, x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | (F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False))
    sorted_found = F.array_sort(F.transform(F.filter(F.col(many), lambda x, i: beside(F.col(many), x, i)), lambda x: x["i"]))
    steps = F.transform(pos, lambda x, i: F.least(F.coalesce(F.get(F.col(pos), i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return (
        docs.withColumn(w, hashed)
        .withColumn(again, F.when(~alike, ranked))
        .withColumn(at, F.when(F.col(again).isNotNull(), repeated))
        .withColumn(many, F.when(F.size(at) > LOOKED_UP, placed))
        .withColumn(pos, F.when(F.col(many).isNotNull(), sorted_found).when(F.col(at).isNotNull(), found))
        .withColumn("n_repeat_words", _whole(F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0))))
        .drop(w, again, at, many, pos)
    )


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` to documents
    of ``split_words``.  A null text has no words and fails."""
    lines = f"{DOC}_lines"
    full = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.withColumn(lines, full).withColumns({
        "n_words": _whole(F.size(WORDS)),
        "word_chars": _whole(F.length(F.array_join(WORDS, ""))),
        "n_symbols": _whole(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS))),
        "n_dup_lines": _whole(F.size(lines) - F.size(F.array_distinct(lines))),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return with_repeat_words(measured).withColumn("base_failed", failed).drop(lines)


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", bound: int = TRUSTED_IDS) -> DataFrame:
    """Ids that every label row marks as good; a hash sample of about ``bound`` where there are more."""
    good = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(F.coalesce(F.col(quality), F.lit(0))).alias("q")).where("q = 1").select(doc_id)
    total = good.count()
    if total > bound:
        share = 1 << 30
        good = good.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(share)) < int(share * bound / total))
    return good


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[float], float]:
    """Log ratio per bucket, and the threshold.  ``trusted`` is a bounded list of ids.

    Few trusted n-grams would make the ratios of unseen documents too low.  So the trusted multinomial
    backs off to the raw one: each bucket has ``BACK_OFF`` n-grams in the proportion of the raw
    corpus beforehand, and its ratio moves away from 0 as its trusted count grows.  The threshold is
    the same whatever the labels.

    The counts come to the driver: ``BUCKETS`` rows however large the corpus.  Without trusted
    documents, or without any documents, every ratio is 0.
    """
    flagged = docs.select(doc_id, text).join(F.broadcast(trusted.select(doc_id).withColumn(f"{DOC}_good", F.lit(1))), doc_id, "left")
    pairs = split_words(flagged, text).select(f"{DOC}_good", F.explode(_grams(F.col(HASHES), 2)).alias("x"))
    grams = pairs.select(f"{DOC}_good", F.explode(F.array(_bucket(F.col("x.h0")), F.when(F.col("x.h1").isNotNull(), _bucket(F.col("x"))))).alias("bucket"))
    counts = grams.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count(f"{DOC}_good").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    share = sum(good) / max(1, sum(raw))
    return [math.log((g + BACK_OFF) / (r * share + BACK_OFF)) for g, r in zip(good, raw)], THRESHOLD


def score(ratios: list[float]) -> Column:
    """Mean log ratio over the words and word pairs of ``split_words``; 0 without words."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folds to one literal
    mean = lambda sum_, x: sum_ + F.get(weights, _bucket(x))
    one = F.aggregate(HASHES, F.lit(0.0), mean)
    two = F.aggregate(F.slice(_grams(F.col(HASHES), 2), F.lit(1), F.greatest(F.size(HASHES) - 1, F.lit(0))), F.lit(0.0), mean)
    return F.when(F.size(HASHES) == 0, F.lit(0.0)).otherwise((one + two) / (2 * F.size(HASHES) - 1))


def judge(docs: DataFrame, ratios: list[float], threshold: float, text: str = "text") -> DataFrame:
    """``docs`` with the measures of ``base_rules``, ``llr`` and ``kept``."""
    ruled = base_rules(split_words(docs, text), text).withColumn("llr", score(ratios)).drop(WORDS, HASHES)
    # Always true, and not known before the row is read: a filter on ``kept`` stays above the word
    # columns, which would otherwise be computed anew for every element a lambda looks at.
    here = F.monotonically_increasing_id() >= 0
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & here)


@query("op10_hashed_ngram_ratio")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, *fit(docs, trusted_ids(table(spark, sf_dir, "labels")))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
