"""Approximate nearest neighbours by stable projections and a kd-tree with a chi-square stop.

Vectors are scaled to length 1, so the largest cosine is the smallest distance, and projected to
``DIMS`` dimensions by a Gaussian matrix.  For a pair at distance ``d``, the squared projected
distance over ``d ** 2`` is chi-square with ``DIMS`` degrees of freedom.  So once projected neighbours
have been verified in rising order up to distance ``r``, a vector nearer than the k-th best found,
``d_k``, is still unseen with probability at most ``1 - chi2(r ** 2 / d_k ** 2)``; the search stops when
that is under ``1 - CONFIDENCE``.

The kd-tree over the projections is fitted on a hash sample of about ``SAMPLE`` vectors and holds
every vector.  A query first searches its own leaf, which bounds ``d_k``; then it goes to every leaf
whose box is inside the radius that the stopping test leaves, and stops in each by the same test.
Leaves are dealt in blocks of about ``LEAF`` vectors, so none is larger than a task can hold.

Equal vectors are one entry that keeps its ``k + 1`` smallest distinct ids: no other copy can be among
the ``k`` nearest, ties going to smaller ids.  Equal queries are searched once.  Repeated rows count
once.  An id with several vectors is as near as the nearest pair of them, and is listed once: lists
and the stopping test count distinct ids, not vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table
from lorekeep.session import staged

DIMS = 8
CONFIDENCE = 0.96
LEAF = 1024
SAMPLE = 50_000  # expected number at most
MAX_LEAVES = 4096
BATCH = 256  # neighbours verified between two tests
QUERIES_AT_ONCE = 4096


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for j in range(dims // 2):
        total += term
        term *= half / (j + 1)
    return 1 - math.exp(-half) * total


def stop_ratio(confidence: float, dims: int = DIMS) -> float:
    """The squared projected distance, over ``d_k ** 2``, at which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < confidence else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((width, DIMS))


class Tree:
    """A kd-tree by medians: ``2 ** depth`` leaves, as arrays of split dimensions and values."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.dims, self.cuts = depth, [], []
        parts = [points]
        for _ in range(depth):
            halves = []
            for p in parts:
                dim = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
                cut = float(np.median(p[:, dim])) if len(p) else 0.0
                self.dims.append(dim)
                self.cuts.append(cut)
                halves += [p[p[:, dim] <= cut], p[p[:, dim] > cut]]
            parts = halves

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf numbers of points; nodes are numbered level by level."""
        at, dims, cuts = np.zeros(len(points), np.int64), np.array([*self.dims, 0]), np.array([*self.cuts, 0.0])
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            at = 2 * at + (points[np.arange(len(points)), dims[node]] > cuts[node])
        return at

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((1, DIMS), -np.inf), np.full((1, DIMS), np.inf)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            dims, cuts = np.array(self.dims[first:first + n]), np.array(self.cuts[first:first + n])
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left = 2 * np.arange(n)
            high[left, dims] = np.minimum(high[left, dims], cuts)
            low[left + 1, dims] = np.maximum(low[left + 1, dims], cuts)
        return low, high

    def leaves_within(self, point: np.ndarray, radius2: float) -> np.ndarray:
        low, high = self.boxes_
        gap = np.maximum(np.maximum(low - point, point - high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= radius2)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)) if len(vectors) else vectors


def search(queries: pa.Table, block: pa.Table, k: int, ratio: float) -> pa.Table:
    """The ``k`` nearest of a block for each query, verified in rising projected distance."""
    q, v = _matrix(queries["vector"]), _matrix(block["vector"])
    qu, vu = _unit(q), _unit(v)
    p = projection(v.shape[1])
    qp, vp = qu @ p, vu @ p
    bound, ids = queries["bound"].to_numpy(), block["ids"].to_pylist()
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    owner, found, scores = [], [], []
    for i in range(len(q)):
        near = ((vp - qp[i]) ** 2).sum(axis=1)
        order = np.argsort(near)
        best, at, done, edge = np.empty(0), np.empty(0, np.int64), 0, -np.inf
        while done < len(order):
            kth = min(bound[i], 2 - 2 * edge)
            if near[order[done]] > ratio * max(kth, 1e-12):
                break
            now = order[done:done + BATCH]
            s = np.r_[best, (v[now] @ q[i]) / (vn[now] * qn[i])]
            at = np.r_[at, now]
            edge, known = -np.inf, set()
            for x in np.argsort(-s, kind="stable"):
                known.update(ids[at[x]])
                if len(known) >= k:
                    edge = s[x]
                    break
            # Ties with the last one stay: their ids decide.
            keep = np.flatnonzero(s >= edge)
            keep = keep[np.argsort(-s[keep], kind="stable")]
            best, at, done = s[keep], at[keep], done + BATCH
        owner.append(np.full(len(at), i))
        found.append(at)
        scores.append(best)
    owner, found = np.concatenate(owner).astype(np.int64), np.concatenate(found).astype(np.int64)
    return pa.table({
        "qa": queries["qa"].take(pa.array(owner)), "qb": queries["qb"].take(pa.array(owner)),
        "ids": block["ids"].take(pa.array(found)).combine_chunks(), "score": pa.array(np.concatenate(scores))})


class Index:
    """Every usable vector of a table, by leaf and block.

    A vector takes no part if it is null, empty, zero, holds a null or non-finite component, or has
    another length than most (on a tie, the shorter length counts).  Rows without an id take no part.
    """

    def __init__(self, vectors: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding"):
        self.spark, self.k = vectors.sparkSession, k
        usable = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
            F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
            & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
        widths = usable.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
        self.width = widths["width"] if widths else 1
        self.rows = usable.where(F.size("vector") == self.width).select(
            "id", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit("b"), "vector").alias("b"), "vector")
        # Repeated rows become one; then at most k + 1 ids of equal vectors leave a task, and as many are kept.
        place = W.partitionBy("a", "b").orderBy("id")
        once = self.rows.groupBy("a", "b", "id").agg(F.first("vector").alias("vector"))
        few = once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
        entries = staged(few.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "entries")
        self.entries = entries
        total = entries.count()
        share = 1 << 30
        sample = entries.where(F.pmod(F.col("a"), F.lit(share)) < int(share * min(1.0, SAMPLE / max(total, 1))))
        rows = sample.select("vector").toArrow()  # about SAMPLE rows
        depth = max(0, min(MAX_LEAVES, total // LEAF, len(rows) // 8).bit_length())
        self.tree = Tree(_unit(_matrix(rows["vector"])) @ projection(self.width) if len(rows) else np.zeros((0, DIMS)), depth)
        self.tree.boxes_ = self.tree.boxes()
        tree, width = self.tree, self.width

        def place_all(batches):
            for batch in batches:
                leaf = tree.leaf_of(_unit(_matrix(batch.column(2))) @ projection(width)) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["a", "ids", "vector", "leaf"])

        placed = staged(entries.select("a", "ids", "vector").mapInArrow(place_all, "a long, ids array<long>, vector array<double>, leaf long"), "leaves")
        blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("long").alias("blocks"))
        self.blocks = staged(blocks, "blocks")  # a row per leaf: MAX_LEAVES or fewer
        self.placed = staged(placed.join(F.broadcast(self.blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).drop("blocks", "a"), "index")

    def visit(self, routed: DataFrame) -> DataFrame:
        """``qa, qb, id, score`` for queries routed to leaves (``qa, qb, vector, bound, leaf``)."""
        k, ratio = self.k + 1, stop_ratio(CONFIDENCE)
        # A leaf that very many queries visit is read by one task per so many of them.
        turns = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("long").alias("turns"))
        turns = staged(turns, "turns")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = routed.join(F.broadcast(turns), "leaf").withColumn("turn", F.pmod(F.xxhash64("qa", "qb"), F.col("turns"))).join(
            F.broadcast(self.blocks), "leaf").withColumn("block", every("blocks")).drop("turns", "blocks")
        right = self.placed.join(F.broadcast(turns), "leaf").withColumn("turn", every("turns")).drop("turns")

        def run(queries: pa.Table, block: pa.Table) -> pa.Table:
            if not len(queries) or not len(block):
                return pa.table({"qa": pa.array([], pa.int64()), "qb": pa.array([], pa.int64()),
                                 "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
            return search(queries, block, k, ratio)

        key = ["leaf", "block", "turn"]
        got = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "qa long, qb long, ids array<long>, score double")
        return self.best(got.select("qa", "qb", F.explode("ids").alias("id"), "score"))

    def best(self, found: DataFrame) -> DataFrame:
        place = W.partitionBy("qa", "qb").orderBy(F.desc("score"), "id")
        found = found.groupBy("qa", "qb", "id").agg(F.max("score").alias("score"))
        return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= self.k + 1)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """``query_id, rank, id, score`` for rows of this table (``id, a, b, vector``): up to ``k`` distinct
        ids per distinct ``query_id``, with the best score over its vectors and theirs."""
        tree, width, ratio = self.tree, self.width, stop_ratio(CONFIDENCE)
        asked = staged(queries.select(F.col("a").alias("qa"), F.col("b").alias("qb"), "vector").dropDuplicates(["qa", "qb"]), "asked")

        def route(home: bool):
            def run(batches):
                for batch in batches:
                    points = _unit(_matrix(batch.column(2))) @ projection(width) if len(batch) else np.zeros((0, DIMS))
                    own = tree.leaf_of(points)
                    if home:
                        leaves = [np.array([x]) for x in own]
                    else:
                        bounds = batch.column(3).to_numpy()
                        leaves = [np.setdiff1d(tree.leaves_within(p, ratio * max(b, 1e-12)), [x]) for p, b, x in zip(points, bounds, own)]
                    at = np.repeat(np.arange(len(batch)), [len(x) for x in leaves])
                    flat = np.concatenate([*leaves, np.zeros(0, np.int64)]).astype(np.int64)
                    for low in range(0, len(at), 8192):  # a query may visit every leaf
                        part = batch.take(pa.array(at[low:low + 8192]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flat[low:low + 8192])], ["qa", "qb", "vector", "bound", "leaf"])
            return run

        schema = "qa long, qb long, vector array<double>, bound double, leaf long"
        first = staged(self.visit(asked.withColumn("bound", F.lit(float("inf"))).mapInArrow(route(True), schema)), "home")
        bounds = first.where(F.col("place") == self.k + 1).select("qa", "qb", (2 - 2 * F.col("score")).alias("bound"))
        bounded = asked.join(bounds, ["qa", "qb"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = self.visit(staged(bounded.mapInArrow(route(False), schema), "routed"))
        every = staged(self.best(first.drop("place").union(more.drop("place"))).drop("place"), "nearest")
        ids = queries.select(F.col("id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb")).distinct()
        place = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return (
            ids.join(every, ["qa", "qb"]).where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= self.k)
            .select("query_id", "rank", "id", "score"))


@query("op6_stable_projection_tree")
def op6(spark, sf_dir):
    index = Index(table(spark, sf_dir, "embeddings"), k=5)
    found = index.nearest(index.rows.where(F.col("id") % 50 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
