"""The pre-load gate: *all* errors of a delivery, as rows ``(table, id, error)``.

Unlike the refresh, foreign keys are checked against the ids as delivered, and a row may earn
several errors.  ``abort_on_errors`` keeps a bad delivery out of the raw tables.

All keys of a delivery are counted once, in one shuffle (``key_ledger``): repeated ids, ids that are referred to
and not there, and the rows behind each key are read from that.  So a table is scanned once for its keys and
once for the rules on its rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.governance import ai_eligible
from lorekeep.functions.iso import integer, iso_date
from lorekeep.functions.text import is_blank, quoted
from lorekeep.operators.joins import numbered, sized_join
from lorekeep.operators.quality import repeated_keys
from lorekeep.session import scratch_path, staged

# The record count a delivery is expected to stay within.
EXPECTED_RECORDS = (30, 50)
REPEAT_CHUNK = 100_000


class DeliveryRejected(ValueError):
    """The delivery has errors and must not be loaded."""


# Each table's id, by table.
IDS = {"topics": "topic_id", "sources": "source_id", "knowledge": "knowledge_id", "reviews": "review_id"}
# Which table a row refers to with which column.
REFERENCES = {"knowledge": {"topic_id": "topics", "source_id": "sources"}, "reviews": {"knowledge_id": "knowledge"}}


def key_ledger(**tables: DataFrame) -> DataFrame:
    """``(table, key, ids, refs)``, staged: how many rows of ``table`` have this id, and how many rows of other
    tables refer to it.  Counts combine before the shuffle; rows without a key are one group per table."""
    parts = None
    for name, df in tables.items():
        own = F.struct(F.lit(name).alias("table"), F.col(IDS[name]).alias("key"), F.lit(1).alias("id"))
        others = [F.struct(F.lit(to).alias("table"), F.col(column).alias("key"), F.lit(0).alias("id")) for column, to in REFERENCES.get(name, {}).items()]
        part = df.select(F.explode(F.array(own, *others)).alias("k")).select("k.*")
        parts = part if parts is None else parts.unionByName(part)
    counts = parts.groupBy("table", "key").agg(F.sum("id").alias("ids"), F.sum(1 - F.col("id")).alias("refs"))
    return staged(counts, "key_ledger")


def repeats(df: DataFrame, table: str, key: str) -> DataFrame:
    """One error per repeat after the first of one table's ids."""
    extra = repeated_keys(df, key).select(F.lit(table).alias("table"), F.col(key).alias("key"), (F.col("_copies") - 1).alias("_extra"))
    return _repeats(extra, {table: key})


def _repeats(extra: DataFrame, ids: dict[str, str]) -> DataFrame:
    """``_extra`` errors per ``(table, key)``.

    Keys are counted, not sorted into windows.  A key repeated without end would explode from one
    row, so its repeats are cut into chunks that are spread before they unfold.  The partition
    count is given: AQE would merge so few bytes into one task, not knowing what they unfold to.
    """
    lots = int(extra.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.lit(REPEAT_CHUNK)
    starts = extra.select(
        "table", "key", "_extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_extra") - 1, chunk.cast("long"))).alias("_from")
    ).repartition(lots, "table", "key", "_from")
    here = F.least(chunk, F.col("_extra") - F.col("_from")).cast("int")
    text = F.coalesce(*[F.when(F.col("table") == table, quoted(f"duplicate {key}", F.coalesce("key", F.lit("")))) for table, key in ids.items()])
    return starts.select("table", "key", F.explode(F.array_repeat(F.lit(1), here))).select("table", F.col("key").alias("id"), text.alias("error"))


def _errors(df: DataFrame, table: str, key: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), text) for bad, text in rules]))
    return df.select(F.lit(table).alias("table"), F.col(key).alias("id"), F.explode(found).alias("error"))


def _enum(column: str, allowed: list[str]) -> tuple[Column, Column]:
    return ~F.col(column).isin(allowed), quoted(f"invalid {column}", _text(column))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _with_unknown(df: DataFrame, ledger: DataFrame, column: str, table: str, flag: str) -> DataFrame:
    """Marks rows whose ``column`` is no id of ``table``.  Unknown ids are few as a rule, so these meet the rows; how
    many rows each has is known from the ledger."""
    unknown = ledger.where((F.col("table") == table) & (F.col("ids") == 0) & F.col("key").isNotNull())
    marks = staged(unknown.select(F.col("key").alias(column), F.lit(True).alias(flag), F.col("refs").alias("_rows")), f"unknown_{column}")
    joined = sized_join(df, marks.select(column, flag), column, "left", counts=marks.select(column, "_rows"))
    return joined.withColumn(flag, F.col(flag).isNotNull() | F.col(column).isNull())


def source_errors(sources: DataFrame) -> DataFrame:
    return _errors(sources, "sources", "source_id", [
        _enum("source_status", S.SOURCE_STATUSES),
        (~F.col("url").startswith("https://"), quoted("url is not https", _text("url"))),
    ])


def knowledge_errors(knowledge: DataFrame, ledger: DataFrame) -> DataFrame:
    known = _with_unknown(numbered(knowledge), ledger, "topic_id", "topics", "_topic")
    known = _with_unknown(known, ledger, "source_id", "sources", "_source")
    return _errors(known, "knowledge", "knowledge_id", [
        (F.col("_topic"), quoted("unknown topic_id", _text("topic_id"))),
        (F.col("_source"), quoted("unknown source_id", _text("source_id"))),
        _enum("review_status", S.REVIEW_STATUSES),
        _enum("content_status", S.CONTENT_STATUSES),
        *[
            (iso_date(F.col(c)).isNull(), quoted(f"unparseable {c}", _text(c)))
            for c in ("published_date", "last_reviewed_date")
        ],
        (is_blank(F.col("summary")), F.lit("empty summary")),
        # The load casts this column and would stop at such a value.
        (F.col("content_version").isNotNull() & integer(F.col("content_version").cast("string")).isNull(),
         quoted("content_version is not an integer", _text("content_version"))),
    ])


def review_errors(reviews: DataFrame, ledger: DataFrame) -> DataFrame:
    known = _with_unknown(numbered(reviews), ledger, "knowledge_id", "knowledge", "_knowledge")
    return _errors(known, "reviews", "review_id", [
        (F.col("_knowledge"), quoted("unknown knowledge_id", _text("knowledge_id"))),
        _enum("review_status", S.REVIEW_STATUSES),
    ])


def uniqueness_errors(topics: DataFrame, sources: DataFrame, knowledge: DataFrame, reviews: DataFrame) -> DataFrame:
    return repeated_ids(key_ledger(topics=topics, sources=sources, knowledge=knowledge, reviews=reviews))


def repeated_ids(ledger: DataFrame) -> DataFrame:
    """One error per repeat after the first of an id, in all tables."""
    return _repeats(ledger.where("ids > 1").select("table", "key", (F.col("ids") - 1).alias("_extra")), IDS)


def all_errors(
    topics: DataFrame, sources: DataFrame, knowledge: DataFrame, reviews: DataFrame, rules_path: str | None = None,
) -> DataFrame:
    """Every error of a delivery; with ``rules_path`` the rules file must load as well."""
    ledger = key_ledger(topics=topics, sources=sources, knowledge=knowledge, reviews=reviews)
    found = (
        repeated_ids(ledger)
        .unionByName(source_errors(sources))
        .unionByName(knowledge_errors(knowledge, ledger))
        .unionByName(review_errors(reviews, ledger))
    )
    return found.unionByName(rules_file_errors(topics.sparkSession, rules_path)) if rules_path else found


def rules_file_errors(spark: SparkSession, path: str) -> DataFrame:
    """An error row unless ``path`` holds one readable JSON value.  Only that is asked of the file."""
    schema = "`table` string, id string, error string"
    try:
        text = spark.read.text(path, wholetext=True)
        bad = text.where(F.try_parse_json("value").isNull())
        return bad.select(F.lit("rules").alias("table"), F.lit(path).alias("id"), F.lit("failed to load").alias("error"))
    except AnalysisException:
        return spark.createDataFrame([("rules", path, "failed to load")], schema)


def preview(knowledge: DataFrame, sources: DataFrame) -> DataFrame:
    """``(records, eligible)`` as the delivery stands.  Should a source id repeat, the copy with the
    smallest status text speaks for it (the gate rejects such a delivery anyway)."""
    status = staged(sources.groupBy("source_id").agg(F.min("source_status").alias("source_status")), "source_status")
    joined = sized_join(numbered(knowledge), status, "source_id", "left")
    flag = ai_eligible(F.col("review_status"), F.col("source_status"), F.col("content_status"))
    return joined.agg(F.count(F.lit(1)).alias("records"), F.count_if(flag).alias("eligible"))


def warnings(knowledge: DataFrame, sources: DataFrame) -> DataFrame:
    """``(warning)``: record count out of range, and always the eligibility preview."""
    low, high = EXPECTED_RECORDS
    out_of_range = F.when(
        ~F.col("records").between(low, high),
        F.format_string(f"knowledge has %d records, expected {low}-{high}", F.col("records")),
    )
    share = F.format_string("ai_eligible preview: %d/%d records", F.col("eligible"), F.col("records"))
    return preview(knowledge, sources).select(
        F.explode(F.array_compact(F.array(out_of_range, share))).alias("warning")
    )


def abort_on_errors(errors: DataFrame, report: str | None = None, shown: int = 20) -> DataFrame:
    """Raises when there is any error.  All of them are in ``report`` (JSON lines; a folder of the
    session's shared space where none is given), whose path and count the message has, with the
    first few in order.  Returns the errors as written."""
    spark = errors.sparkSession
    report = report or scratch_path(spark, "gate_errors")
    errors.write.mode("overwrite").json(report)
    written = spark.read.schema(errors.schema).json(report)
    total = written.count()
    if total:
        first = written.orderBy("table", "id", "error").limit(shown).collect()
        lines = "; ".join(f"{r['table']}[{r['id']}]: {r['error']}" for r in first)
        raise DeliveryRejected(f"refusing to load: {total} errors, all in {report}: {lines}")
    return written
