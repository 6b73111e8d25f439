"""Exact top-k: per-task best lists in numpy, merged by a Spark window.

Ranking a corpus against a batch of questions must look at every (question, row) pair, but it need
not *emit* them.  Each task keeps the best ``k`` rows per question while it streams its Arrow
batches and hands over at most ``questions * k`` rows; the window merge then orders those.  Scores
are rounded to 9 decimals and ties go to the smaller id, so a result never depends on row order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 9
# Each task hands over its own best list, so a corpus of very many splits is scanned by at most
# this many tasks, or a few per core on a larger cluster.
SCAN_TASKS, TASKS_PER_CORE = 10_000, 4
SCORED = "query_id string, knowledge_id string, score double"


def by_id(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ascending order, and the positions they came from."""
    order = pc.sort_indices(ids)
    return np.array(ids.take(order).to_pylist(), dtype=object), order.to_numpy()


class BestRows:
    """The best ``k`` (id, score) per question seen so far in one task."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.ids = [np.empty(0, dtype=object) for _ in range(questions)]
        self.scores = [np.empty(0) for _ in range(questions)]
        self.floors = np.full(questions, -np.inf)  # a lower score cannot enter any more

    @property
    def held(self) -> int:
        return sum(s.size for s in self.scores)

    def push(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores[i, j]``: question ``first + i`` against row ``ids[j]``; ``ids`` ascend, so of any
        number of tied rows the first ones are the ones to keep."""
        scores = np.round(scores, DECIMALS) + 0.0  # + 0.0 turns -0.0 into 0.0
        fits = scores >= self.floors[first:first + len(scores), None]
        for i in np.flatnonzero(fits.any(axis=1)):
            q, keep = first + i, np.flatnonzero(fits[i])
            if keep.size > self.k:
                among = scores[i, keep]
                floor = np.partition(among, keep.size - self.k)[keep.size - self.k]
                above = keep[among > floor]
                keep = np.concatenate([above, keep[among == floor][: self.k - above.size]])
            pool_ids = np.concatenate([self.ids[q], ids[keep]])
            pool = np.concatenate([self.scores[q], scores[i, keep]])
            order = np.lexsort((pool_ids, -pool))[: self.k]
            self.ids[q], self.scores[q] = pool_ids[order], pool[order]
            if order.size == self.k:
                self.floors[q] = pool[order[-1]]

    def to_batch(self, query_ids: list[str]) -> pa.RecordBatch:
        sizes = [s.size for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(query_ids, dtype=object), sizes), pa.string()),
                pa.array(np.concatenate([*self.ids, np.empty(0, dtype=object)]), pa.string()),
                pa.array(np.concatenate([*self.scores, np.empty(0)]), pa.float64()),
            ],
            names=["query_id", "knowledge_id", "score"],
        )


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """``rank`` 1.. within ``by``.  With ``k`` Spark plans WindowGroupLimit: each task passes on at
    most ``k`` rows per group, so a hot group never lands whole in one task."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("long"))


def best_per_question(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    return ranked(scored, ["query_id"], [F.desc(score), F.asc("knowledge_id")], k)
