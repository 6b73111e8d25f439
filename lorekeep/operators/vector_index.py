"""A stored, exact vector index: clusters that a search can skip whole.

``build`` deals the unit vectors to the nearest of a bounded number of centres and stores, per cluster, the
centre, the largest angle of a member to it (the radius) and the members in blocks.  The angle is a metric, so no
member of a cluster is nearer to a question than the angle to the centre less the radius.

``cosine_top`` gives the rows of ``semantic.cosine_top``.  The clusters nearest to a question that hold enough
vectors are ranked first; their k-th score is a floor, and only clusters that could reach it are ranked then.
Rows without a direction (no vector, zero, another length) form a cluster of their own that every question
meets.  Questions and members meet in blocks, joined by cluster; tables are partitioned by cluster, so that
clusters nobody asks for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.semantic import _Block
from lorekeep.operators.topk import SCORED, best_per_question
from lorekeep.session import staged

MAX_CLUSTERS = 1024  # centres travel to every task: 8 MB at 1,024 dimensions
PER_CLUSTER = 64  # vectors a cluster should have at least, on average
ROUNDS = 3
BLOCK_ROWS, BLOCK_QUESTIONS = 1024, 256
LOOSE = -1  # the cluster of rows without a direction
SLACK = 1e-7  # angles and scores are computed in another order

TABLES = ("vector_clusters", "vector_blocks")
PARTITIONED = {"vector_blocks": ["cluster"]}


@dataclass(frozen=True)
class VectorIndex:
    """``clusters``: (cluster, centre, radius, n), a bounded table.  ``blocks``: (cluster, ids, embeddings)."""

    clusters: DataFrame
    blocks: DataFrame

    def tables(self, prefix: str = "semantic/") -> dict[str, DataFrame]:
        return {f"{prefix}{name}": df for name, df in zip(TABLES, (self.clusters, self.blocks))}


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction and ``width`` finite components, and which rows those are."""
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    found = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((found * found).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return found[good] / norms[good, None], rows[good]


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector and the angle to it."""
    cosines = units @ centres.T
    best = cosines.argmax(axis=1)
    return best, np.arccos(np.clip(cosines[np.arange(len(units)), best], -1.0, 1.0))


def _centres(rows: DataFrame, width: int, count: int) -> np.ndarray:
    """``count`` centres at most: members picked by a hash of the id, then moved ``ROUNDS`` times to the mean of
    their members.  Sums combine per task; what comes to the driver is as large as the centres."""
    picked = rows.where(F.size("embedding") == width).select(F.xxhash64("knowledge_id").alias("h"), "knowledge_id", "embedding")
    first = picked.orderBy("h", "knowledge_id").limit(count).select("embedding").toArrow()["embedding"].combine_chunks()
    centres, _ = _units(first, width)
    for _ in range(ROUNDS if len(centres) else 0):
        def run(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(centres)
            for batch in batches:
                units, _ = _units(batch.column(0), width)
                best, _ = _nearest(units, centres)
                np.add.at(sums, best, units)
            seen = np.flatnonzero(sums.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * width, pa.int32()), pa.array(sums[seen].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), lists], ["cluster", "sum"])

        parts = rows.select("embedding").mapInArrow(run, "cluster int, sum array<double>")
        added = parts.select("cluster", F.posexplode("sum").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).toArrow()
        moved = np.zeros_like(centres)
        moved[added["cluster"].to_numpy(), added["i"].to_numpy()] = added["x"].to_numpy()
        norms = np.linalg.norm(moved, axis=1)
        centres = np.where(norms[:, None] > 0, moved / np.where(norms > 0, norms, 1.0)[:, None], centres)
    return centres


def build(embeddings: DataFrame) -> VectorIndex:
    """The index of a corpus (``knowledge_id, embedding``).  The width of its vectors is the most frequent one."""
    rows = embeddings.select("knowledge_id", "embedding")
    widths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, total = (widths[0]["width"], widths[0]["count"]) if widths else (1, 0)
    centres = _centres(rows, width, max(1, min(MAX_CLUSTERS, int(total // PER_CLUSTER))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, angle = np.full(len(batch), LOOSE), np.zeros(len(batch))
            if len(centres):
                units, which = _units(batch.column(1), width)
                cluster[which], angle[which] = _nearest(units, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle)], ["knowledge_id", "embedding", "cluster", "angle"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = staged(rows.mapInArrow(deal, f"knowledge_id string, embedding {kind}, cluster int, angle double"), "dealt")
    spark = rows.sparkSession
    known = dealt.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    places = pa.table({"cluster": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})
    clusters = known.join(F.broadcast(spark.createDataFrame(places)), "cluster", "left").select("cluster", "centre", "radius", "n")
    # Slices of a cluster are dealt by a hash, so that a cluster of any size is many blocks.
    sizes = F.broadcast(staged(known.select("cluster", F.ceil(F.col("n") / BLOCK_ROWS).alias("slices")), "slices"))
    blocks = dealt.join(sizes, "cluster").groupBy("cluster", F.pmod(F.xxhash64("knowledge_id"), F.col("slices")).alias("slice")).agg(
        F.collect_list(F.struct("knowledge_id", F.coalesce("embedding", F.array().cast(kind)).alias("embedding"))).alias("rows"))
    blocks = blocks.select(F.col("rows.knowledge_id").alias("ids"), F.col("rows.embedding").alias("embeddings"), "cluster")
    return VectorIndex(clusters, blocks)


def _known(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters with a centre: numbers, centres, radii, sizes; and the number of rows without a direction."""
    rows = index.clusters.collect()  # MAX_CLUSTERS and one at most
    placed = sorted((r for r in rows if r["cluster"] != LOOSE), key=lambda r: r["cluster"])
    centres = np.array([r["centre"] for r in placed]) if placed else np.zeros((0, 1))
    return (np.array([r["cluster"] for r in placed], int), centres, np.array([r["radius"] for r in placed]),
            np.array([r["n"] for r in placed], int), sum(r["n"] for r in rows if r["cluster"] == LOOSE))


def cosine_top(questions: DataFrame, index: VectorIndex, fetch_n: int = 10) -> DataFrame:
    """``(query_id, knowledge_id, score, rank)``, as ``semantic.cosine_top`` over the indexed corpus.  A repeated
    question id is one question, the first by its vector; one without a direction scores 0 everywhere."""
    known = _known(index)
    asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = staged(asked.groupBy("query_id").agg(F.min("embedding").alias("embedding")), "asked")
    begun = staged(_routed(asked.withColumn("floor", F.lit(None).cast("double")), known, fetch_n), "first")
    found = staged(_ranked(begun, index, fetch_n), "found")
    floors = best_per_question(found, fetch_n).where(F.col("rank") == fetch_n).select("query_id", F.col("score").alias("floor"))
    # A question whose first clusters gave fewer than fetch_n rows has met everything.
    more = _routed(asked.join(floors, "query_id"), known, fetch_n).join(begun.select("query_id", "cluster"), ["query_id", "cluster"], "left_anti")
    return best_per_question(_ranked(staged(more, "more"), index, fetch_n).union(found), fetch_n)


def _routed(asked: DataFrame, known: tuple, k: int) -> DataFrame:
    """``query_id, embedding, cluster``: without a floor the nearest clusters that hold ``k`` vectors, and the
    rows without a direction; with one the clusters that may hold a row of that score."""
    numbers, centres, radii, sizes, loose = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            units, which = _units(batch.column(1), centres.shape[1])
            row = np.full(len(batch), -1)
            row[which] = np.arange(len(which))
            at, to = [], []
            for i in range(len(batch)):
                first = np.isnan(floors[i])
                if loose and first:
                    at.append(i)
                    to.append(LOOSE)
                if row[i] < 0:  # no direction, or another length: as near to one cluster as to any
                    wanted = np.arange(len(numbers))
                else:
                    least = np.maximum(np.arccos(np.clip(centres @ units[row[i]], -1.0, 1.0)) - radii, 0.0)
                    if first:
                        order = np.argsort(least, kind="stable")
                        wanted = order[:np.searchsorted(np.cumsum(sizes[order]), k) + 1]
                    else:
                        wanted = np.flatnonzero(np.cos(least) >= floors[i] - SLACK)
                at += [i] * len(wanted)
                to += numbers[wanted].tolist()
            part = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(to, pa.int32())], ["query_id", "embedding", "cluster"])

    return asked.select("query_id", "embedding", "floor").mapInArrow(run, "query_id string, embedding array<double>, cluster int")


def _ranked(routed: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """The best ``k`` per question and block of the clusters it is routed to."""
    wanted = [r[0] for r in routed.select("cluster").distinct().collect()]  # folders to read
    groups = staged(routed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUESTIONS).alias("groups")), "groups")
    asked = routed.join(F.broadcast(groups), "cluster").groupBy("cluster", F.pmod(F.xxhash64("query_id"), F.col("groups")).alias("group")).agg(
        F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    pairs = index.blocks.where(F.col("cluster").isin(wanted)).join(asked, "cluster").select("ids", "embeddings", "asked.query_id", "asked.embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, vectors, query_ids, queries = (batch.column(c)[i].values for c in range(4))
                block = _Block(pa.RecordBatch.from_arrays([query_ids, queries], ["query_id", "embedding"]), k)
                block.push(pa.RecordBatch.from_arrays([ids, vectors], ["knowledge_id", "embedding"]))
                yield block.to_batch()

    return pairs.mapInArrow(run, SCORED)


def share_read(questions: DataFrame, index: VectorIndex, fetch_n: int = 10) -> DataFrame:
    """``query_id, vectors, total``: how many vectors a search ranks for each question, of how many."""
    known = _known(index)
    asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    floors = cosine_top(questions, index, fetch_n).where(F.col("rank") == fetch_n).select("query_id", F.col("score").alias("floor"))
    begun = _routed(asked.withColumn("floor", F.lit(None).cast("double")), known, fetch_n).select("query_id", "cluster")
    more = _routed(asked.join(floors, "query_id"), known, fetch_n).select("query_id", "cluster")
    total = index.clusters.agg(F.sum("n")).first()[0] or 0
    return begun.union(more).distinct().join(F.broadcast(index.clusters.select("cluster", "n")), "cluster").groupBy("query_id").agg(
        F.sum("n").alias("vectors")).withColumn("total", F.lit(total))
