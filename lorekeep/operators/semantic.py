"""Cosine top-k of a corpus for a batch of questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import questions as questions_
from lorekeep.operators.joins import attach
from lorekeep.operators.topk import BestRows, best_per_question, by_id

QUESTION_BLOCK = 512
ROW_BLOCK = 4096


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """List array -> (rows x width, zero-padded or cut to the shared length; full-length norms)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.nan_to_num(np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.sqrt(np.bincount(rows, weights=flat * flat, minlength=len(sizes)))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, dtype=int)
    cols = np.arange(flat.size) - np.repeat(starts, sizes)
    out = np.zeros((len(sizes), width))
    inside = cols < width
    out[rows[inside], cols[inside]] = flat[inside]
    return out, norms


class _Block:
    """A block of questions against corpus rows."""

    def __init__(self, questions: pa.RecordBatch, k: int):
        self.ids = questions.column("query_id").to_pylist()
        vectors = questions.column("embedding")
        self.width = max((len(v or []) for v in vectors.to_pylist()), default=0)
        self.matrix, self.norms = _matrix(vectors, self.width)
        self.best = BestRows(len(self.ids), k)

    @property
    def held(self) -> int:
        return self.best.held

    def push(self, batch: pa.RecordBatch) -> None:
        ids, order = by_id(batch.column("knowledge_id"))
        rows, norms = (part[order] for part in _matrix(batch.column("embedding"), self.width))
        for r in range(0, len(ids), ROW_BLOCK):
            for q in range(0, len(self.ids), QUESTION_BLOCK):
                dots = self.matrix[q:q + QUESTION_BLOCK] @ rows[r:r + ROW_BLOCK].T
                scale = np.outer(self.norms[q:q + QUESTION_BLOCK], norms[r:r + ROW_BLOCK])
                cosine = np.divide(dots, scale, out=np.zeros_like(dots), where=scale != 0)
                self.best.push(q, ids[r:r + ROW_BLOCK], cosine)

    def to_batch(self) -> pa.RecordBatch:
        return self.best.to_batch(self.ids)


def cosine_top(questions: DataFrame, corpus: DataFrame, fetch_n: int = 10) -> DataFrame:
    """``(query_id, knowledge_id, score, rank)``: the ``fetch_n`` nearest rows per question.

    One pass over ``(knowledge_id, embedding)``, see ``operators.questions``; what crosses the network is
    ``tasks * questions * fetch_n`` short rows, with a bounded number of tasks.  A repeated question id is
    one question, the first by its vector.
    """
    vectors = corpus.select("knowledge_id", "embedding")  # float or double, widened in the task
    asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    scored = questions_.rank_in_blocks(asked, vectors, lambda part: _Block(part, fetch_n), questions_.VECTOR_BYTES)
    return best_per_question(scored, fetch_n)


def with_details(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds topic, title and summary to the ranked rows."""
    details = corpus.select("knowledge_id", "topic_id", "title", "summary")
    return attach(found, details, "knowledge_id", ["query_id"]).select(
        "query_id", "rank", "knowledge_id", "topic_id", "title", "summary", "score"
    )


def semantic_search(questions: DataFrame, corpus: DataFrame, fetch_n: int = 10) -> DataFrame:
    """``questions``: (query_id, embedding).  A topic filter is applied to ``corpus`` beforehand."""
    return with_details(cosine_top(questions, corpus, fetch_n), corpus)
