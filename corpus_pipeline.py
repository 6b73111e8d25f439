"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows the stage before it kept, and is
written as Parquet and read again before the next.  All but the last return the columns of
``documents``.

What a stage writes on the way to its result goes to a folder of its own.  The result alone is needed
afterwards, so the folder goes when the next stage begins on documents read from elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from lorekeep.llm.common import DOC, table
from lorekeep.session import drop_folder, scratch_scope, staged

_finished: dict[str, list[str]] = {}  # by application: scratch folders of stages whose result was handed out


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage with scratch of its own; earlier stages' goes unless ``docs`` are still read from it."""
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        earlier, files = _finished.setdefault(spark.sparkContext.applicationId, []), docs.inputFiles()
        for folder in [f for f in earlier if not any(f.rsplit("/", 1)[1] in file for file in files)]:
            drop_folder(spark, folder)
            earlier.remove(folder)
        with scratch_scope(spark, build.__name__) as folder:
            made = build(spark, docs, sf_dir)
        earlier.append(folder)
        return made

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram ratio keep; the rest go."""
    fitted = quality_rules.fit(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return _restored(docs, quality_rules.judge(_apart(docs), *fitted).where("kept"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the later occurrences of repeated three-line windows.  Documents that
    lose every line go; those that had no text before stay as they are."""
    return _restored(docs, line_dedup.dedup_lines(_apart(docs)).where("n_lines = 0 or n_removed < n_lines"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, cut where a target ends."""
    return mixing.mix_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with checksums in place of ids."""
    return packing.with_checksums(packing.pack(docs, packing.default_tokenizer()))


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns out of the way of the names that operators add."""
    others = [docs[c] for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias(DOC))


def _restored(docs: DataFrame, apart: DataFrame) -> DataFrame:
    return apart.select(*[F.col("text") if c == "text" else F.col(DOC)[c].alias(c) for c in docs.columns])


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# Packing tokenizes, and mixing has documents of its own kind; SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
