"""Merging semantic and lexical candidates, and the governance re-check."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import inverted, vector_index
from lorekeep.operators.joins import attach, keep_matching
from lorekeep.operators.lexical import bm25_top
from lorekeep.operators.semantic import cosine_top
from lorekeep.operators.topk import DECIMALS, best_per_question, ranked
from lorekeep.session import staged


def normalize(found: DataFrame) -> DataFrame:
    """Min-max of ``score`` within each question's list; a list of equal scores becomes all 1.0."""
    whole = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(whole), F.max("score").over(whole)
    scaled = F.when(hi == lo, F.lit(1.0)).otherwise(F.try_divide(F.col("score") - lo, hi - lo))
    return found.withColumn("score", scaled)


def merge(
    semantic: DataFrame, lexical: DataFrame,
    semantic_weight: float = 0.6, lexical_weight: float = 0.4, top_n: int = 5,
) -> DataFrame:
    """Weighted sum per candidate of either list; the missing side scores 0.0 and the semantic
    side's details (topic, title, ... whatever the lists carry) win."""
    keys = ["query_id", "knowledge_id"]
    carried = [c for c in semantic.columns if c not in (*keys, "score", "rank")]
    sem = normalize(semantic).select(
        *keys, F.col("score").alias("s"), F.struct(F.lit(True), *carried).alias("s_details")
    )
    lex = normalize(lexical).select(
        *keys, F.col("score").alias("l"), F.struct(F.lit(True), *carried).alias("l_details")
    )
    both = sem.join(lex, keys, "full_outer").select(
        *keys,
        F.coalesce("s_details", "l_details").alias("details"),
        F.coalesce("s", F.lit(0.0)).alias("semantic_score"),
        F.coalesce("l", F.lit(0.0)).alias("lexical_score"),
    )
    total = semantic_weight * F.col("semantic_score") + lexical_weight * F.col("lexical_score")
    scored = both.select(
        *keys, *[F.col("details")[c].alias(c) for c in carried], F.round(total, DECIMALS).alias("hybrid_score"), "semantic_score", "lexical_score"
    )
    return best_per_question(scored, top_n, "hybrid_score")


def side_by_side(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Independent frames whose building runs jobs: their jobs share the cluster."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [done.result() for done in [pool.submit(build) for build in builds]]


def one_per_id(questions: DataFrame) -> DataFrame:
    """One whole row per ``query_id``, the first by value: text and vector stay together."""
    rest = [c for c in questions.columns if c != "query_id"]
    return questions.groupBy("query_id").agg(F.min(F.struct(*rest)).alias("q")).select("query_id", "q.*")


def candidate_lists(
    questions: DataFrame, embeddings: DataFrame, corpus: DataFrame, fetch_n: int = 10,
    words: inverted.InvertedIndex | None = None, vectors: vector_index.VectorIndex | None = None,
) -> list[DataFrame]:
    """The semantic and the lexical list, ids and scores only, staged.  ``words`` is a stored index of
    ``corpus``, ``vectors`` one of ``embeddings``; without them the tables are scanned."""
    questions = staged(one_per_id(questions), "questions")
    lexical = (lambda: bm25_top(questions, corpus, fetch_n)) if words is None else (lambda: inverted.bm25_top(questions, words, fetch_n))
    nearest = (lambda: cosine_top(questions, embeddings, fetch_n)) if vectors is None else (lambda: vector_index.cosine_top(questions, vectors, fetch_n))
    return side_by_side(
        lambda: staged(nearest(), "semantic"),
        lambda: staged(lexical(), "lexical"),
    )


def recheck(found: DataFrame, eligible: DataFrame) -> DataFrame:
    """Candidates eligible *now*, in their old order (``rank`` keeps its gaps).

    Candidates are few and the eligible table is not, so that table is first cut down to the
    candidates' ids - by broadcast when their size allows - before it meets them.
    """
    live = keep_matching(eligible.select("knowledge_id"), found, "knowledge_id", unique=True).distinct()
    return found.join(live, "knowledge_id", "left_semi")


def rerank(found: DataFrame, n: int) -> DataFrame:
    """Close the gaps the re-check left and keep the first ``n``."""
    return ranked(found.withColumnRenamed("rank", "_old"), ["query_id"], [F.asc("_old")], n).drop("_old")


def search(
    questions: DataFrame, embeddings: DataFrame, corpus: DataFrame, eligible: DataFrame,
    top_n: int = 5, fetch_n: int = 10, semantic_weight: float = 0.6, lexical_weight: float = 0.4,
    words: inverted.InvertedIndex | None = None, vectors: vector_index.VectorIndex | None = None,
) -> DataFrame:
    """Hybrid search for a table of questions ``(query_id, question, embedding)``.

    ``2 * top_n`` merged candidates are kept before the re-check, so a few rows that became
    ineligible since indexing do not starve the answer.  ``fetch_n`` from each side must be able to
    fill ``top_n``.  A repeated ``query_id`` is one question, the same for both sides.  Ids and scores go
    through the merge; topic, title and summary of the answers are fetched at the end, from ``embeddings`` for
    what they hold, else from ``corpus``.  ``words`` and ``vectors`` are as in ``candidate_lists``.
    """
    if fetch_n < top_n:
        raise ValueError(f"fetch_n={fetch_n} candidates a side cannot be sure to fill top_n={top_n}")
    sem, lex = candidate_lists(questions, embeddings, corpus, fetch_n, words, vectors)
    sem = sem.withColumn("embedded", F.lit(True))
    lex = lex.withColumn("embedded", F.lit(False))
    merged = staged(merge(sem, lex, semantic_weight, lexical_weight, 2 * top_n), "merged")
    answers = staged(rerank(recheck(merged, eligible), top_n), "answers")
    return detailed(answers.where("embedded"), embeddings).unionByName(detailed(answers.where("not embedded"), corpus))


def detailed(answers: DataFrame, table: DataFrame) -> DataFrame:
    """Answers with topic, title and summary."""
    details = table.select("knowledge_id", "topic_id", "title", "summary")
    return attach(answers, details, "knowledge_id", ["query_id"]).select(
        "query_id", "knowledge_id", "topic_id", "title", "summary", "hybrid_score", "semantic_score", "lexical_score", "rank")


def drift(embeddings: DataFrame, eligible: DataFrame) -> DataFrame:
    """Indexed ids that are not eligible now - what the re-check guards against."""
    return embeddings.select("knowledge_id", "topic_id").join(
        eligible.select("knowledge_id"), "knowledge_id", "left_anti"
    )
