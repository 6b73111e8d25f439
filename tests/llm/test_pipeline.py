"""The pipeline's stages on a small corpus, and the queries that SQL can check."""

import os

import corpus_pipeline
import pytest
from llm_rows import DOCS, ODD, prose
from oracle import compare, connect
from pyspark.sql import functions as F

from lorekeep.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = queries.all_queries()
    assert {n.split("_")[0] for n in names} == {"pipeline", *[f"op{i}" for i in range(1, 14)]}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    good = [(i, prose(i, 60) + "\n" + prose(700, 12) + "\n" + prose(701, 12) + "\n" + prose(702, 12) + "\n" + prose(i + 40, 70), "abc"[i % 3]) for i in range(12)]
    rows = [*ODD, *good, (50, good[0][1], "a"), (53, "new " + good[1][1] + " end", "a"), (51, "$$$ ### " * 80, "a"), (52, "few words", "b")]
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else None, 0) for r in rows]
    spark.createDataFrame(full, DOCS).withColumns({c: F.lit(c) for c in ("kept", "row", "size", "n_lines", "take")}).coalesce(1).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 12, 2)] + [(51, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def test_stages_hand_on_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and docs.where("kept <> 'kept' or n_lines <> 'n_lines'").count() == 0
            ids.append(sorted(r["doc_id"] for r in docs.collect()))
    # The exact copy loses every line; the near copy has lines of its own and goes a stage later.
    assert ids[0] == [*range(12), 50, 53] and ids[1] == [*range(12), 53] and ids[2] == [*range(12)] and set(ids[3]) <= set(ids[2])
    second = spark.read.parquet(str(tmp_path / "1"))
    assert second.where(F.col("text").contains(prose(701, 12))).count() == 1
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and docs.count() > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
