"""Rows keep their numbers when files are split otherwise between two scans."""

import pytest
from llm_rows import DOCS, prose

from lorekeep.llm import line_dedup, mixing, near_dedup

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def many_files(spark, tmp_path):
    """A documents table of 24 files; ids from 100 on copy the text of the id 100 before."""
    texts = {i: "\n".join(prose(10 * i + k, 3 + i) for k in range(5)) for i in range(24)}
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()] + [(100 + i, texts[i], "en", "ab"[i % 2], 0) for i in range(0, 24, 3)]
    spark.createDataFrame(rows, DOCS).repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


@pytest.mark.parametrize("operator", [line_dedup.dedup_lines, near_dedup.drop_near_duplicates, mixing.mix_documents])
def test_another_split_between_two_scans_changes_nothing(spark, many_files, operator):
    def run(first, later):
        spark.conf.set(SPLITS, first)
        out = operator(many_files)  # scans the table
        spark.conf.set(SPLITS, later)  # as if executors came or went
        return sorted(map(repr, out.collect()))

    try:
        assert run("64", "1") == run("64", "64")
    finally:
        spark.conf.unset(SPLITS)
