"""Size-checked joins against a plain join, with a key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import joins


@pytest.fixture(scope="module")
def big(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string"))
    return spark.range(9000).select(key.alias("k"), F.col("id").alias("row")).cache()


@pytest.fixture(scope="module")
def parent(spark):
    rows = [("hot", -1), *[(str(i), i) for i in range(40)], ("unused", 99)]
    return spark.createDataFrame(rows, "k string, v int").cache()


def rows(df):
    return sorted(map(tuple, df.select("k", "row", "v").collect()), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_sized_join_equals_plain_join(big, parent, how, either_join):
    assert rows(joins.sized_join(big, parent, "k", how, ["row"])) == rows(big.join(parent, "k", how))


def test_salts_follow_the_rows_of_a_key(big, parent, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)
    assert {r["k"]: r["_salts"] for r in joins.heavy_keys(joins.key_counts(big, "k"), "k").collect()} == {"hot": 30}
    for how in ("left", "inner"):
        assert rows(joins.salted_join(big, parent, "k", how, ["row"])) == rows(big.join(parent, "k", how))


def test_very_many_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 10)
    big = spark.range(12000).select((F.col("id") % 300).cast("string").alias("k"), F.col("id").alias("row"))
    parent = spark.range(300).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"))
    assert joins.heavy_keys(joins.key_counts(big, "k"), "k").where("_salts = 4").count() == 300
    assert rows(joins.salted_join(big, parent, "k", "left", ["row"])) == rows(big.join(parent, "k"))
    monkeypatch.setattr(joins, "MAX_HEAVY", 100)  # fewer, larger shares instead of a longer list
    assert joins.heavy_keys(joins.key_counts(big, "k"), "k").count() <= 100


def test_compressible_parent_is_not_small(spark, tmp_path):
    spark.range(20000).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 2000).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/p")
    wide = spark.read.parquet(f"{tmp_path}/p")
    assert joins.estimated_bytes(wide) < joins.broadcast_limit(wide) and not joins.fits_broadcast(wide)


def test_keep_matching(big, parent, either_join):
    wanted = parent.select("k").union(parent.select("k"))  # repeats must not multiply rows
    expected = big.join(parent.select("k"), "k", "left_semi").count()
    assert joins.keep_matching(big, wanted, "k").count() == expected


def test_keep_matching_unique(spark, parent, big, either_join):
    got = joins.keep_matching(parent, big, "k", unique=True)
    assert {r["k"] for r in got.collect()} == {"hot", *[str(i) for i in range(40)]}


def test_attach(big, parent, either_join):
    assert rows(joins.attach(big, parent, "k", ["row"])) == rows(big.join(parent, "k"))


def test_broadcast_limit_follows_the_session(spark, parent):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for text, size in [("10MB", 10 << 20), ("512k", 512 << 10), ("1048576", 1 << 20), ("-1", -1)]:
            spark.conf.set(key, text)
            assert joins.broadcast_limit(parent) == size
    finally:
        spark.conf.set(key, before)


def test_exact_copies_are_spread_too(spark, parent, monkeypatch):
    """A third of all rows being one row, over and over, must not end in one task."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)
    copies = spark.range(6000).select(F.lit("hot").alias("k"), F.lit("same").alias("text"))
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        joined = joins.salted_join(joins.numbered(copies), parent, "k", "left", ["_row"])
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 3000
        assert joins.keep_matching(copies, parent, "k").count() == 6000
    finally:
        spark.conf.set(key, "true")


def test_a_large_parent_is_cut_to_what_is_referred_to(spark, big):
    parent = spark.range(20000).select(F.concat(F.lit("unused"), F.col("id").cast("string")).alias("k"), F.col("id").cast("int").alias("v"))
    parent = parent.union(spark.createDataFrame([("hot", -1), *[(str(i), i) for i in range(40)]], "k string, v int"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000b")
    try:
        for how in ("left", "inner"):
            joined = joins.sized_join(big, parent, "k", how, ["row"])
            plan = joined._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the big side stays where it is
            assert rows(joined) == rows(big.join(parent, "k", how))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
