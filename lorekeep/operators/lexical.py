"""BM25 (Okapi) top-k of a corpus for a batch of questions.

Two passes over the corpus: one gathers the statistics (document frequency per term, document
count, mean length), the other scores.  The first is an ordinary aggregate whose counts combine on the
map side, so a word present in every document costs one row per task.  Joining postings on the term
would emit every (question, document) pair sharing a common word; instead the scoring pass takes blocks of
questions with the weights of their terms, see ``operators.questions``, and keeps best lists.  For a corpus
that is searched again and again, ``operators.inverted`` stores an index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens
from lorekeep.operators import questions as questions_
from lorekeep.operators.joins import sized_join
from lorekeep.operators.semantic import with_details
from lorekeep.operators.topk import BestRows, best_per_question, by_id
from lorekeep.session import staged

# The Okapi constants.
K1, B, EPSILON = 1.5, 0.75, 0.25

BLOCK_QUESTIONS, BLOCK_TOKENS, BLOCK_CELLS = 64, 8192, 4 << 20


def tokenized(corpus: DataFrame) -> DataFrame:
    """``(knowledge_id, tokens)`` over title and summary.  A null part counts as empty text."""
    return corpus.select("knowledge_id", tokens(F.concat_ws(" ", "title", "summary")).alias("tokens"))


@dataclass(frozen=True)
class TermStatistics:
    """Corpus statistics behind a BM25 score; ``terms`` is ``(term, df)``, staged."""

    documents: int
    mean_length: float
    terms: DataFrame
    mean_idf: float

    @property
    def idf(self):
        """idf of ``terms.df`` as a Column; a negative one becomes EPSILON times the mean."""
        plain = plain_idf(self.documents)
        return F.when(plain < 0, F.lit(EPSILON * self.mean_idf)).otherwise(plain)


def plain_idf(documents: int):
    return F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def term_statistics(corpus: DataFrame) -> TermStatistics:
    """One pass: each document puts its length on the first of its distinct words, so the word
    counts also add up to the document count and total length."""
    docs = tokenized(corpus).select(
        F.size("tokens").alias("length"), F.posexplode_outer(F.array_distinct("tokens")).alias("pos", "term")
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # a document without words has one null row
    counts = staged(docs.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.count_if(first).alias("documents"),
        F.sum(F.when(first, F.col("length")).otherwise(0)).alias("length"),
    ), "term_df")
    documents, length = counts.agg(F.sum("documents"), F.sum("length")).first()
    terms = counts.where(F.col("term").isNotNull()).select("term", "df")
    mean_idf = terms.agg(F.avg(plain_idf(documents))).first()[0] if documents else None
    return TermStatistics(documents or 0, (length or 0) / (documents or 1), terms, mean_idf or 0.0)


def question_terms(questions: DataFrame) -> DataFrame:
    """``(query_id, tokens)``; a repeated word counts each time."""
    return questions.select("query_id", tokens(F.col("question")).alias("tokens"))


def weighted(questions: DataFrame, stats: TermStatistics) -> DataFrame:
    """``(query_id, words, worth)``: the words of each question that the corpus knows and their idf, times
    their number in the question.  A repeated question id is one question, the first by its words."""
    asked = staged(question_terms(questions).groupBy("query_id").agg(F.min("tokens").alias("tokens")), "asked")
    words = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").count()
    known = sized_join(words, stats.terms.select("term", stats.idf.alias("idf")), "term", "inner", ["query_id"])
    lists = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("count") * F.col("idf")).alias("worth")))).alias("w"))
    return asked.select("query_id").join(lists, "query_id", "left").select(
        "query_id", F.coalesce("w.term", F.array().cast("array<string>")).alias("words"), F.coalesce("w.worth", F.array().cast("array<double>")).alias("worth"))


def _blocks(questions: list[list[str]]) -> list[tuple[int, int]]:
    """Runs of questions small enough for a dense (term x question) matrix."""
    cuts, start, held = [], 0, 0
    for i, words in enumerate(questions):
        if i > start and (i - start >= BLOCK_QUESTIONS or held + len(words) > BLOCK_TOKENS):
            cuts.append((start, i))
            start, held = i, 0
        held += len(words)
    return cuts + [(start, len(questions))]


class _Block:
    """A block of questions against corpus rows."""

    def __init__(self, questions: pa.RecordBatch, mean_length: float, k: int):
        self.ids, asked = questions.column("query_id").to_pylist(), questions.column("words").to_pylist()
        worth = questions.column("worth").to_pylist()
        self.vocabulary = sorted({w for words in asked for w in words})
        place = {term: i for i, term in enumerate(self.vocabulary)}
        self.blocks = []  # kept sparse: (questions, terms, cells of the matrix)
        for first, last in _blocks(asked):
            column = np.repeat(np.arange(last - first), [len(words) for words in asked[first:last]])
            terms = np.array([place[w] for words in asked[first:last] for w in words], dtype=int)
            used, row = np.unique(terms, return_inverse=True)
            self.blocks.append((first, last, used, row, column, np.array([x for part in worth[first:last] for x in part])))
        self.mean_length = mean_length
        self.best = BestRows(len(self.ids), k)

    @property
    def held(self) -> int:
        return self.best.held

    def push(self, rows: pa.RecordBatch) -> None:
        width, mean_length = max(len(self.vocabulary), 1), self.mean_length
        ids, order = by_id(rows.column("knowledge_id"))
        place_of = np.empty(len(ids), dtype=np.int64)
        place_of[order] = np.arange(len(ids))
        lists = rows.column("tokens")
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        owner, lengths = np.repeat(place_of, lengths), lengths[order]
        found = pc.index_in(lists.flatten(), value_set=pa.array(self.vocabulary, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = found >= 0
        cells, freq = np.unique(owner[hit] * width + found[hit], return_counts=True)
        doc, term = cells // width, cells % width
        relative = lengths[doc] / mean_length if mean_length else np.zeros(doc.size)
        weight = freq * (K1 + 1) / (freq + K1 * (1 - B + B * relative))
        for first, last, used, row, column, worth in self.blocks:
            matrix = np.zeros((used.size, last - first))
            matrix[row, column] = worth
            local = np.full(width, -1)
            local[used] = np.arange(used.size)
            step = max(1, BLOCK_CELLS // max(used.size, last - first, 1))
            for start in range(0, len(ids), step):
                stop = min(start + step, len(ids))
                lo, hi = np.searchsorted(doc, [start, stop])
                dense = np.zeros((stop - start, used.size))
                own = local[term[lo:hi]]
                wanted = own >= 0
                dense[doc[lo:hi][wanted] - start, own[wanted]] = weight[lo:hi][wanted]
                self.best.push(first, ids[start:stop], (dense @ matrix).T)

    def to_batch(self) -> pa.RecordBatch:
        return self.best.to_batch(self.ids)


def bm25_top(
    questions: DataFrame, corpus: DataFrame, fetch_n: int = 10, stats: TermStatistics | None = None
) -> DataFrame:
    """``(query_id, knowledge_id, score, rank)``.  Every corpus row is ranked: with few matches the
    rest of the list is zero-score rows in id order, and negative scores come below those."""
    stats = stats or term_statistics(corpus)
    mean = stats.mean_length
    scored = questions_.rank_in_blocks(
        weighted(questions, stats), tokenized(corpus), lambda part: _Block(part, mean, fetch_n), questions_.TEXT_BYTES)
    return best_per_question(scored, fetch_n)


def lexical_search(questions: DataFrame, corpus: DataFrame, fetch_n: int = 10) -> DataFrame:
    """``questions``: (query_id, question).  Statistics belong to the corpus as given, so a topic
    filter applied beforehand changes them too."""
    return with_details(bm25_top(questions, corpus, fetch_n), corpus)
