"""Line dedup by overlapping windows of three lines.

Lines with a word, trimmed, are hashed to 128 bits; every three neighbouring ones make a window with
a hash of its own.  A window found more than once keeps its first occurrence (smallest document id,
null last, then table order, then position); the lines of every later occurrence go.  Covered
positions are merged first, so overlapping windows remove a repeated passage as one stretch, blank
lines inside it included.  Where a later window overlaps its first occurrence in the same document,
the lines of the first stay.

Only built-in expressions run.  The table is numbered and written once to the shared folder, and
every later read is from there.  Windows are written once too (hashes and positions, no text) and reduced to the repeated ones by a count that combines before its shuffle.  The repeated
windows are written too, so the join back to all windows is between plain scans and Spark splits a
passage that fills a partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import DOC, ROW, SPACE_CHARS, numbered, query, table, text_of
from lorekeep.session import staged

LINES = 3


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, id, start, stop, a, b``: first and last line number of each window and its hash."""
    lines = F.split(text_of(text), "\n")
    bare = lambda x: F.btrim(x, F.lit(SPACE_CHARS))
    hashed = F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), (bare(x) != "").alias("full"), F.xxhash64(bare(x)).alias("a"), F.xxhash64(F.lit("b"), bare(x)).alias("b")))
    placed = numbered(docs).select(
        F.col(ROW).alias("row"), F.col(doc_id).alias("id"), F.filter(hashed, lambda x: x["full"]).alias("lines"))

    def window(i: Column) -> Column:
        at = [F.get(F.col("lines"), i + k) for k in range(LINES)]
        return F.struct(at[0]["i"].alias("start"), at[-1]["i"].alias("stop"),
                        F.xxhash64(*[x["a"] for x in at]).alias("a"), F.xxhash64(*[x["b"] for x in at]).alias("b"))

    return (
        placed.where(F.size("lines") >= LINES)
        .select("row", "id", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), window)).alias("w"))
        .select("row", "id", "w.*")
    )


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, spans``: merged stretches of line numbers to remove, for documents that have any."""
    every = staged(windows(docs, doc_id, text), "windows")
    order = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("row"), F.col("start"), F.col("stop"))
    repeated = every.groupBy("a", "b").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(repeated.select("a", "b", F.col("first.row").alias("row0"), F.col("first.start").alias("start0"), F.col("first.stop").alias("stop0")), "repeated")
    same = F.col("row") == F.col("row0")
    later = (
        every.join(repeated, ["a", "b"])
        .where(~same | (F.col("start") != F.col("start0")))
        .select("row", F.when(same, F.greatest("start", F.col("stop0") + 1)).otherwise(F.col("start")).alias("start"), "stop")
        .where("start <= stop")
    )
    return later.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found")).select("row", merged(F.col("found")).alias("spans"))


def merged(spans: Column) -> Column:
    """Sorted spans (both ends growing) joined where they overlap or touch."""
    opens = F.filter(spans, lambda s, i: (i == 0) | (s["start"] > F.get(spans, i - 1)["stop"] + 1))
    shuts = F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i + 1)["start"] > s["stop"] + 1, F.lit(True)))
    return F.transform(opens, lambda s, i: F.struct(s["start"].alias("start"), F.get(shuts, i)["stop"].alias("stop")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and ``n_lines`` and ``n_removed`` in place of any such
    columns.

    A null text stays null with no lines; a text under three lines with a word never changes.  No
    row goes: a document that loses every line keeps an empty text.  Repeated rows lose their
    windows to the first of them.  An empty table stays empty.
    """
    docs = numbered(docs)
    spans = covered(docs, doc_id, text).withColumnRenamed("row", ROW).withColumnRenamed("spans", f"{DOC}_spans")
    joined = docs.join(spans.hint("shuffle_hash"), ROW, "left")
    lines, cut = F.col(f"{DOC}_lines"), F.coalesce(F.col(f"{DOC}_spans"), F.array().cast("array<struct<start:int,stop:int>>"))
    # What stands before each span, and behind the last one.
    ends = F.transform(F.sequence(F.lit(0), F.size(f"{DOC}_spans")), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(f"{DOC}_spans"), i - 1)["stop"] + 1).alias("from"),
        F.coalesce(F.get(F.col(f"{DOC}_spans"), i)["start"], F.size(lines)).alias("to")))
    kept = F.flatten(F.transform(ends, lambda e: F.slice(lines, e["from"] + 1, F.greatest(e["to"] - e["from"], F.lit(0)))))
    return (
        joined.withColumn(f"{DOC}_lines", F.split(F.col(text), "\n"))
        .withColumns({
            "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            "n_removed": F.aggregate(cut, F.lit(0), lambda n, s: n + s["stop"] - s["start"] + 1).cast("long"),
            text: F.when(F.col(f"{DOC}_spans").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        })
        .drop(ROW, f"{DOC}_lines", f"{DOC}_spans")
    )


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS raw,
    trim(unnest(parts), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM split),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE line <> ''),
windows AS (
  SELECT a.doc_id, a.i AS start, c.i AS stop, a.line AS x, b.line AS y, c.line AS z
  FROM full_lines a JOIN full_lines b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN full_lines c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS doc0, first_value(start) OVER w AS start0, first_value(stop) OVER w AS stop0
  FROM windows WINDOW w AS (PARTITION BY x, y, z ORDER BY doc_id, start)),
gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, doc0, start0, stop0, start, unnest(range(start, stop + 1)) AS i FROM ranked)
  WHERE (doc_id <> doc0 OR start <> start0) AND (doc_id <> doc0 OR i > stop0))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.doc_id IS NOT NULL) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (g.doc_id IS NULL), '') AS text
FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
"""


@query("op3_line_windows", ORACLE)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
