"""Unbounded sources.  Each yields the columns its operator expects; nothing here is stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schemas as S


def kafka_messages(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None, start: str = "earliest") -> DataFrame:
    """``value: binary`` from a Kafka topic (needs the Kafka package on the class path).  A first
    start delivers what is waiting; ``start`` is Kafka's ``startingOffsets``."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", start)
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select("value")


def text_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``value: binary``, one message per line of the text files landing under ``path``."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("value").cast("binary").alias("value"))


def notifications(messages: DataFrame) -> DataFrame:
    """Object notifications from message bytes, ready for ``files.file_signals``."""
    body = F.from_json(F.col("value").cast("string"), S.FILE_NOTIFICATION)
    return messages.select(body.alias("n")).select("n.*")


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """The same notification columns from a watched folder; file contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(path)
    return found.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("bucket"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.lit(None).cast("string").alias("contentType"),
        F.col("length").cast("string").alias("size"),
        F.col("modificationTime").cast("string").alias("timeCreated"),
    )
