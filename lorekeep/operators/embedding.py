"""The embedding job: the one place where Python code sees every row, since the model is external."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]

HASHED_MODEL, HASHED_WIDTH = "hashed-words", 64


def hashed_words(texts: list[str], width: int = HASHED_WIDTH) -> list[list[float]]:
    """Offline stand-in for a model: signed word counts hashed to ``width`` slots, unit length."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        for word in text.lower().split():
            code = zlib.crc32(word.encode())
            row[code % width] += 1.0 if code & 0x10000 else -1.0
        length = np.linalg.norm(row)
        if length:
            row /= length
    return out.tolist()


def embed(df: DataFrame, text_col: str, embedder: Embedder = hashed_words) -> DataFrame:
    """Adds ``embedding`` from ``text_col``; the embedder gets whole Arrow batches of texts, and no
    other column leaves the JVM."""
    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(texts.fillna("").tolist()))

    return df.withColumn("embedding", vectors(text_col))


def build_index(
    eligible: DataFrame, embedded_at: Column, embedder: Embedder = hashed_words, model: str = HASHED_MODEL
) -> DataFrame:
    """The embedding table for all eligible knowledge, re-embedded as a whole; one record is one
    chunk, and only its summary is embedded.  Nothing eligible is an error: run the refresh first."""
    rows = eligible.select("knowledge_id", "topic_id", "title", "summary")
    if rows.isEmpty():
        raise ValueError("no eligible knowledge to embed")
    return embed(rows, "summary", embedder).select(
        "*", F.lit(model).alias("embedding_model"), embedded_at.alias("embedded_at")
    )


def refresh_index(
    eligible: DataFrame, previous: DataFrame, embedded_at: Column, embedder: Embedder = hashed_words, model: str = HASHED_MODEL
) -> DataFrame:
    """The same table as ``build_index``, from the one before: records whose text stands there under the same
    model keep their vector and its time, new and changed ones are embedded, and records that are not
    eligible any more are left out.  ``previous`` holds an id once, as every index does; texts are
    compared by their SHA-256, so only ids and digests meet the vectors."""
    rows = eligible.select("knowledge_id", "topic_id", "title", "summary")
    if rows.isEmpty():
        raise ValueError("no eligible knowledge to embed")
    digest = F.sha2(F.coalesce("summary", F.lit("")), 256).alias("_digest")
    known = previous.where(F.col("embedding_model") == model).select("knowledge_id", digest, "embedding", "embedding_model", "embedded_at")
    keys = ["knowledge_id", "_digest"]
    marked = rows.select("*", digest)
    kept = marked.join(known, keys).drop("_digest")
    fresh = marked.join(known.select(*keys), keys, "left_anti").drop("_digest")
    made = embed(fresh, "summary", embedder).select("*", F.lit(model).alias("embedding_model"), embedded_at.alias("embedded_at"))
    return kept.unionByName(made)


def check_model(spark: SparkSession, embedder: Embedder) -> None:
    """Raises what the embedder raises, for a job that may find no text to embed: one empty text is embedded."""
    embed(spark.range(1).select(F.lit("").alias("text")), "text", embedder).collect()


def embed_queries(questions: DataFrame, embedder: Embedder = hashed_words) -> DataFrame:
    """``(query_id, question)`` -> the same with ``embedding``."""
    return embed(questions.select("query_id", "question"), "question", embedder)
