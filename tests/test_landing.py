"""How the inputs of the registered queries are landed as raw tables."""

from pyspark.sql import functions as F

from lorekeep.testbed import bindings
from lorekeep.testbed.registry import Context


def tables(spark, folder, files):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.repartitionByRange(files, "doc_id").write.parquet(f"{folder}/documents.parquet")
    labels = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [0.5, 1.0]) for i in (5, 6, 6, 399, 1000, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_many_splits_stay_where_they_are(spark, tmp_path):
    c = Context(spark, tables(spark, tmp_path, 16))
    assert c.splits("b_k1") >= spark.sparkContext.defaultParallelism
    landed = c.raw("b_k1")
    assert landed.count() == 400
    file_of = {r["doc_id"]: r["file"] for r in landed.select("doc_id", F.input_file_name().alias("file")).collect()}
    assert sum(file_of[i] == file_of[i + 1] for i in range(399)) > 350  # documents of one file are still together


def test_one_split_is_dealt_out(spark, tmp_path):
    c = Context(spark, tables(spark, tmp_path, 1))
    assert c.splits("b_k1") == 1
    landed = c.raw("b_k1")
    assert landed.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism and landed.count() == 400


def test_texts_without_a_vector_do_not_move(spark, tmp_path, either_join):
    folder = tables(spark, tmp_path, 2)
    found = bindings.bind(spark, folder, "b_embeddings")
    assert sorted(r["knowledge_id"] for r in found.collect()) == ["know_399", "know_5", "know_6", "know_6"]
    semi = "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert semi == (either_join != "-1")


def test_both_deliveries_read_the_texts_once(spark, tmp_path, either_join):
    folder = tables(spark, tmp_path, 2)
    more = [(3, 0, 1), (3, 0, 1), (4, 0, 1), (5, 0, None), (6, None, 1), (7, 1, 1), (None, 0, 1)]
    spark.createDataFrame(more, "doc_id long, quality int, toxic int").write.mode("append").parquet(f"{folder}/labels.parquet")
    found = bindings.bind(spark, folder, "b_knowledge")
    text = bindings.with_clause("b_knowledge") + "select * from b_knowledge"
    stated = bindings.run_sql(spark, text, {name: bindings.table(spark, folder, name) for name in ("documents", "labels")})
    assert found.schema.simpleString() == stated.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, stated.collect())) and found.where("content_version = '9'").count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2  # documents and labels, once each
