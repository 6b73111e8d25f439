"""The clustered vector index against the scan and brute force; what it skips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import asked_vectors, brute_cosine, lists, same, vectors  # noqa: F401  fixtures

from lorekeep.operators import semantic, vector_index
from lorekeep.session import staged

ROWS, QUESTIONS = "knowledge_id string, embedding array<double>", "query_id string, embedding array<double>"


def stored(index):
    return vector_index.VectorIndex(staged(index.clusters, "clusters"), staged(index.blocks, "blocks"))


def clustered(n, groups, width, seed):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, width))
    return [(f"v{i:05d}", (centres[i % groups] + 0.05 * pick.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("k", [1, 10, 400])
def test_rows_of_brute_force(spark, vectors, asked_vectors, monkeypatch, k):  # noqa: F811
    monkeypatch.setattr(vector_index, "PER_CLUSTER", 10)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_index, "BLOCK_QUESTIONS", 4)
    index = stored(vector_index.build(spark.createDataFrame(vectors, ROWS).repartition(3)))
    assert index.clusters.count() > 10 and index.blocks.count() > index.clusters.count()
    asked = [*asked_vectors, ("qshort", [1.0, 2.0]), ("qlong", [1.0] * 12)]
    got = vector_index.cosine_top(spark.createDataFrame(asked, QUESTIONS), index, k)
    same(lists(got), brute_cosine(vectors, asked, k))


def test_far_clusters_are_skipped(spark):
    rows = clustered(3000, 30, 16, 1)
    index = stored(vector_index.build(spark.createDataFrame(rows, ROWS)))
    asked = [(f"q{i}", rows[i * 97][1]) for i in range(12)]
    questions = spark.createDataFrame(asked, QUESTIONS)
    same(lists(vector_index.cosine_top(questions, index, 5)), brute_cosine(rows, asked, 5))
    read = vector_index.share_read(questions, index, 5).agg(F.sum("vectors"), F.sum("total")).first()
    assert read[0] < 0.3 * read[1]


def test_clusters_hold_their_members(spark):
    rows = clustered(500, 5, 8, 2)
    index = stored(vector_index.build(spark.createDataFrame(rows, ROWS)))
    assert index.blocks.select(F.explode("ids")).count() == 500 == index.clusters.agg(F.sum("n")).first()[0]
    clusters = {r["cluster"]: r for r in index.clusters.collect()}
    for b in index.blocks.collect():
        c = clusters[b["cluster"]]
        units = np.array(b["embeddings"]) / np.linalg.norm(b["embeddings"], axis=1)[:, None]
        assert (np.arccos(np.clip(units @ np.array(c["centre"]), -1, 1)) <= c["radius"] + 1e-9).all()


def test_copies_ties_and_null_vectors(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03d}", [1.0, 0.0, 0.0]) for i in range(200)] + [(f"d{i}", [rng.random(), rng.random(), 1.0]) for i in range(100)] + [("z", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, ("n", None)], ROWS)
    questions = spark.createDataFrame([("q", [2.0, 0.0, 0.0]), ("q", [9.0, 0.0, 0.0]), ("far", [-1.0, 0.0, -1.0])], QUESTIONS)
    got = vector_index.cosine_top(questions, stored(vector_index.build(df)), 8)
    same(lists(got), lists(semantic.cosine_top(questions, df, 8)))


def test_nothing_to_index_and_no_questions(spark):
    empty = stored(vector_index.build(spark.createDataFrame([], ROWS)))
    assert vector_index.cosine_top(spark.createDataFrame([("q", [1.0])], QUESTIONS), empty).count() == 0
    index = stored(vector_index.build(spark.createDataFrame([("a", [1.0, 2.0])], ROWS)))
    assert vector_index.cosine_top(spark.createDataFrame([], QUESTIONS), index).count() == 0
