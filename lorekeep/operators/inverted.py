"""A stored inverted index: BM25 top-k from the postings of the asked terms alone.

``build`` makes four tables, to be published together: one row of statistics, the terms, the postings and
the documents.  The postings of a term are ordered by impact (its share of a score without the idf) and cut
into blocks of ``BLOCK`` documents, each with its greatest impact; tables are partitioned by a hash of
the term, so a search reads the folders of its terms only.

``bm25_top`` gives the rows of ``lexical.bm25_top``, ties and zero scores included, without a scan of the
corpus and without a question on the driver:

1. The best blocks of a question's strongest terms give it some candidates; their exact scores give a
   score that its k-th row reaches at least.
2. Terms too weak to lift a document over that score, all together, are left out, and so is every block of
   the other terms that could not do so even if its documents had all other terms at their best.
3. The rest of the postings add up by (question, document).  The k-th of these sums may lift the score.  A
   document whose sum, with the most that the left out could add, stays below it goes; the others are scored
   exactly, from their own terms or, where that would read more, from all postings of the asked terms.

Nothing can be lost: a document below the bounds has ``k`` better ones.  All steps are joins and
aggregates, so questions and candidates are dealt over the cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.joins import attach, fits_broadcast, heavy_keys, sized_join
from lorekeep.operators.lexical import B, EPSILON, K1, plain_idf, question_terms, tokenized
from lorekeep.operators.topk import DECIMALS, ranked
from lorekeep.session import staged

BLOCK = 128  # documents of one posting block
BUCKETS = 64  # folders the terms are dealt over
STRONGEST = 3  # terms of a question whose best blocks give the first candidates
PAIRS_A_TASK = 1_000_000  # (question, document) pairs a task adds up
SLACK = 1e-7  # bounds are sums in another order than scores, which are rounded to 9 decimals

TABLES = ("lexical_stats", "lexical_terms", "lexical_postings", "lexical_documents")
PARTITIONED = {"lexical_postings": ["bucket"]}


@dataclass(frozen=True)
class InvertedIndex:
    """``stats``: one row (documents, mean_length, mean_idf, buckets, postings).  ``terms``: (term, key, df, top).  ``postings``:
    (bucket, key, top, docs, impacts), a block a row.  ``documents``: (doc, knowledge_id, keys, impacts)."""

    stats: DataFrame
    terms: DataFrame
    postings: DataFrame
    documents: DataFrame

    def tables(self, prefix: str = "semantic/") -> dict[str, DataFrame]:
        return {f"{prefix}{name}": df for name, df in zip(TABLES, (self.stats, self.terms, self.postings, self.documents))}


def _key(term: str) -> Column:
    return F.xxhash64(term)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.col(key), F.lit(buckets)).cast("int")


def build(corpus: DataFrame, buckets: int = BUCKETS) -> InvertedIndex:
    """The index of a corpus (``knowledge_id, title, summary``; ids distinct).

    Terms in very many documents are dealt over slices, each with blocks of its own, so no term is one
    task; the list of such terms is bounded (``joins.heavy_keys``)."""
    # Documents are numbered in the order of their ids, so ties need no id.
    ordered = tokenized(corpus).repartitionByRange("knowledge_id").sortWithinPartitions("knowledge_id")
    docs = staged(ordered.withColumn("doc", F.monotonically_increasing_id()), "tokens")
    documents, length = docs.agg(F.count(F.lit(1)), F.sum(F.size("tokens"))).first()
    mean = (length or 0) / (documents or 1)
    found = docs.select("doc", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    freq, relative = F.col("count"), F.col("length") / F.lit(mean or 1.0)
    impact = freq * (K1 + 1) / (freq + K1 * (1 - B + B * relative))
    found = staged(found.groupBy("doc", "length", "term").count().select("doc", "term", _key("term").alias("key"), impact.alias("impact")), "impacts")
    terms = staged(found.groupBy("key").agg(F.min("term").alias("term"), F.max("term").alias("other"), F.count(F.lit(1)).alias("df"), F.max("impact").alias("top")), "terms")
    if terms.where("term <> other").limit(1).count():
        raise RuntimeError("two terms have one 64-bit key; change the seed of the hash")
    terms = terms.drop("other")
    mean_idf, postings_ = terms.agg(F.avg(plain_idf(documents)), F.coalesce(F.sum("df"), F.lit(0))).first() if documents else (None, 0)
    stats = docs.sparkSession.range(1).select(
        F.lit(documents).cast("long").alias("documents"), F.lit(float(mean)).alias("mean_length"), F.lit(float(mean_idf or 0.0)).alias("mean_idf"),
        F.lit(buckets).alias("buckets"), F.lit(postings_).cast("long").alias("postings"))

    heavy = F.broadcast(heavy_keys(terms.select("key", F.col("df").alias("_rows")), "key"))
    sliced = found.drop("term").join(heavy, "key", "left").withColumn("slice", F.pmod(F.xxhash64("doc"), F.coalesce("_salts", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("key", "slice").orderBy(F.desc("impact"), "doc"))
    blocks = sliced.withColumn("block", F.floor((place - 1) / BLOCK)).groupBy("key", "slice", "block").agg(
        F.max("impact").alias("top"), F.collect_list(F.struct("doc", "impact")).alias("rows"))
    postings = blocks.select(
        "key", "block", "top", F.col("rows.doc").alias("docs"), F.col("rows.impact").alias("impacts"), _bucket("key", buckets).alias("bucket"))
    # A folder is written by as many tasks as its blocks fill; within a file terms are in order.
    postings = postings.repartition("bucket", F.floor(F.col("block") / 4096)).sortWithinPartitions("bucket", "key")
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("key", "impact")).alias("rows"))
    own = docs.select("doc", "knowledge_id").join(lists, "doc", "left")
    own = own.select("doc", "knowledge_id", F.coalesce("rows.key", F.array().cast("array<long>")).alias("keys"),
                     F.coalesce("rows.impact", F.array().cast("array<double>")).alias("impacts"))
    return InvertedIndex(stats, terms.select("term", "key", "df", "top"), postings, own)


def term_weights(index: InvertedIndex) -> DataFrame:
    """``term, key, df, top, idf`` of the stored terms."""
    stats = index.stats.first()
    plain = plain_idf(stats["documents"])
    return index.terms.withColumn("idf", F.when(plain < 0, F.lit(EPSILON * stats["mean_idf"])).otherwise(plain))


def bounds_hold(index: InvertedIndex) -> bool:
    """Whether no term lowers a score.  Only in a corpus where most terms are in most documents is the
    mean idf, and with it the weight of those terms, not positive; such a corpus has to be scanned."""
    return index.stats.first()["mean_idf"] > 0


def bm25_top(questions: DataFrame, index: InvertedIndex, fetch_n: int = 10) -> DataFrame:
    """``(query_id, knowledge_id, score, rank)``, as ``lexical.bm25_top`` over the indexed corpus.

    A repeated question id is one question, the first by its words.  Raises for an index whose
    ``bounds_hold`` is false."""
    stats = index.stats.first()
    if stats["mean_idf"] <= 0:
        raise ValueError("a term of this corpus lowers scores: use lexical.bm25_top")
    asked = question_terms(questions).groupBy("query_id").agg(F.min("tokens").alias("tokens"))
    asked = staged(asked, "asked")
    words = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").count()
    weights = sized_join(words, term_weights(index), "term", "inner", ["query_id"])
    # A term in exactly half of the documents has no weight, and is as good as not asked.
    weights = weights.select("query_id", "key", "df", "top", (F.col("count") * F.col("idf")).alias("w")).where("w > 0")
    weights = staged(weights.withColumn("most", F.col("w") * F.col("top")), "weights")
    wanted = [r[0] for r in weights.select(_bucket("key", stats["buckets"])).distinct().collect()]  # folders to read, not terms
    postings = index.postings.where(F.col("bucket").isin(wanted))

    by_worth = Window.partitionBy("query_id").orderBy(F.desc("most"), "key")
    strongest = weights.withColumn("place", F.row_number().over(by_worth)).where(F.col("place") <= STRONGEST)
    first = postings.where(F.col("block") < math.ceil(fetch_n / BLOCK)).select("key", "docs")
    begun = strongest.select("query_id", "key").join(first, "key").select("query_id", F.explode("docs").alias("doc")).distinct()
    begun = staged(_exact(begun, weights, index), "begun")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floors = begun.withColumn("place", place).where(F.col("place") == fetch_n).select("query_id", F.col("score").alias("floor"))

    # What each term, and all weaker ones together, can add; what all others can add.
    weaker = Window.partitionBy("query_id").orderBy("most", "key").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    plan = weights.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    plan = plan.withColumns({"upto": F.sum("most").over(weaker), "others": F.sum("most").over(whole) - F.col("most")})
    plan = plan.withColumn("used", F.col("upto") >= F.col("floor"))
    # A document not found under a used term is in a block left out there, or has not the term.
    unseen = F.when(F.col("used"), F.least("most", F.greatest(F.col("floor") - F.col("others"), F.lit(0.0)))).otherwise(F.col("most"))
    plan = plan.withColumn("unseen", unseen).withColumn("spare", F.sum("unseen").over(whole))
    plan = staged(plan.where("used").select("query_id", "key", "w", "floor", "others", "unseen", "spare"), "plan")
    blocks = _dealt(postings.select("key", F.col("top").alias("block_top"), "docs", "impacts"), plan, weights)
    hits = plan.join(blocks, "key")
    hits = hits.where(F.col("w") * F.col("block_top") + F.col("others") >= F.col("floor"))
    hits = hits.select("query_id", "w", "unseen", "spare", "floor", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    contribution = F.col("w") * F.col("p.impacts")
    sums = staged(hits.groupBy("query_id", F.col("p.docs").alias("doc")).agg(
        F.sum(contribution).alias("seen"), F.sum(contribution - F.col("unseen")).alias("bare"), F.min("spare").alias("spare"), F.min("floor").alias("floor")), "sums")
    # What a document has shown is a score it reaches at least; the k-th of these lifts the floor.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("seen")))
    shown = sums.select("query_id", "seen").withColumn("place", place).where(F.col("place") == fetch_n).select("query_id", F.col("seen").alias("least"))
    able = sums.join(shown, "query_id", "left").where(
        F.col("bare") + F.col("spare") >= F.greatest("floor", F.coalesce("least", F.lit(0.0)) - SLACK)).select("query_id", "doc")
    found = staged(able.join(begun.select("query_id", "doc"), ["query_id", "doc"], "left_anti"), "able")
    # Few documents are cheaper to score from their own terms, many from the postings of all asked terms.
    postings_read = weights.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    own_terms = found.count() * stats["postings"] / max(1, stats["documents"])
    exact = _exact(found, weights, index) if own_terms < postings_read else _from_postings(found, weights, postings)
    scored = staged(exact.union(begun).where("score > 0"), "scored")
    best = ranked(_filled(scored, asked, index, fetch_n), ["query_id"], [F.desc("score"), F.asc("doc")], fetch_n)
    return best.join(index.documents.select("doc", "knowledge_id"), "doc").select("query_id", "knowledge_id", "score", "rank")


def _dealt(blocks: DataFrame, wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """Blocks of the ``wanted`` keys over as many tasks as their (question, document) pairs fill.

    Blocks are small on disk and each meets every question that asks for its term, so the splits of a scan
    would bring a task any number of pairs to add up.  Where the wanted do not fit a broadcast, their join
    deals the blocks out itself."""
    keys = weights.join(wanted.select("query_id", "key"), ["query_id", "key"], "left_semi")
    pairs = keys.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if pairs <= PAIRS_A_TASK or not fits_broadcast(wanted):
        return blocks
    tasks = max(-(-pairs // PAIRS_A_TASK), blocks.sparkSession.sparkContext.defaultParallelism)
    return blocks.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi").repartition(tasks, F.xxhash64("key", "docs"))


def _exact(found: DataFrame, weights: DataFrame, index: InvertedIndex) -> DataFrame:
    """``query_id, doc, score`` of pairs ``query_id, doc``, from the documents' own terms."""
    lists = weights.groupBy("query_id").agg(F.collect_list(F.struct("key", "w")).alias("asked"))
    rows = attach(found, index.documents.select("doc", "keys", "impacts"), "doc", ["query_id"]).join(lists, "query_id")
    share = lambda a: a["w"] * F.coalesce(F.get(F.col("impacts"), F.array_position(F.col("keys"), a["key"]).cast("int") - 1), F.lit(0.0))
    score = F.aggregate("asked", F.lit(0.0), lambda acc, a: acc + share(a))
    return rows.select("query_id", "doc", F.round(score, DECIMALS).alias("score"))


def _from_postings(found: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """The same rows as ``_exact``, added up over all postings of the asked terms."""
    blocks = _dealt(postings.select("key", "docs", "impacts"), weights, weights)
    hits = weights.select("query_id", "key", "w").join(blocks, "key").select(
        "query_id", "w", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    sums = hits.groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.round(F.sum(F.col("w") * F.col("p.impacts")), DECIMALS).alias("score"))
    return sums.join(found, ["query_id", "doc"], "left_semi").select("query_id", "doc", "score")


def _filled(scored: DataFrame, asked: DataFrame, index: InvertedIndex, k: int) -> DataFrame:
    """Questions with fewer than ``k`` documents above zero get the first others by id, at zero."""
    counts = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = staged(asked.select("query_id").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id"), "short")
    if not short.limit(1).count():
        return scored
    # Fewer than k are above zero, so k others are among the first 2k documents.
    first = [r[0] for r in index.documents.select("doc").orderBy("doc").limit(2 * k).collect()]
    fill = short.select("query_id", F.explode(F.array(*[F.lit(i) for i in first]).cast("array<long>")).alias("doc"), F.lit(0.0).alias("score"))
    return scored.union(fill.join(scored, ["query_id", "doc"], "left_anti"))
