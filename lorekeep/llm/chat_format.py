"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that
reply under the loss mask.  Turns after the last reply, and conversations without one, give a last
example without a target, so that no row is lost.

Template: ``<s>`` and, per turn, ``[role]text</s>``.  Inside roles and texts the characters that
control strings are made of are written as entities (``&`` first, then ``<``, ``[`` and ``]``), so no
text can look like a control string and reading back is exact.

A conversation is one row while it is expanded: its last example holds all of it anyway.  Examples
are made one at a time from that row; together they are as long as the prefixes they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table, text_of

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
START, END = "<s>", "</s>"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def examples(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_chars`` (code points; no loss: 0 and 0).

    Null roles and texts are empty.  Turns go by number, null last; ties by role, then text, and
    repeated rows are turns of their own.  Rows without a conversation id are one conversation.
    An empty table gives no rows; other columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).isNull().alias("unplaced"), F.col(turn).alias("turn"),
        text_of(role).alias("role"), text_of(text).alias("text"))
    piece = F.concat(F.lit("["), escaped(F.col("role")), F.lit("]"), escaped(F.col("text")), F.lit(END))
    rows = rows.select("conv_id", F.struct(
        "unplaced", "turn", "role", "text", piece.alias("piece"), F.length(escaped(F.col("text"))).alias("chars")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Columns, not nested calls: the lambdas below look into them for every turn.
    whole = whole.select("conv_id", F.transform("turns", lambda t: t["piece"]).alias("pieces"), F.transform(
        "turns", lambda t, i: F.struct((i + 1).alias("upto"), (t["role"] == TARGET_ROLE).alias("target"), t["chars"].alias("chars"))).alias("turns"))
    size = F.size("turns")
    due = F.filter("turns", lambda t: t["target"] | (t["upto"] == size))
    each = whole.select("conv_id", "pieces", F.posexplode(due).alias("example", "t"))
    body = F.concat(F.lit(START), F.array_join(F.slice("pieces", F.lit(1), F.col("t.upto")), ""))
    made = each.select("conv_id", F.col("example").cast("long").alias("example"), body.alias("text"), F.col("t.target").alias("target"), F.col("t.chars").alias("chars"))
    start = F.when(F.col("target"), F.length("text") - F.col("chars") - len(END)).otherwise(F.lit(0))
    return made.select("conv_id", "example", "text", start.cast("long").alias("loss_start"), F.when(F.col("target"), F.col("chars")).otherwise(F.lit(0)).cast("long").alias("loss_chars"), "target")


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, what is trained on, and the size."""
    loss = F.when(F.col("target"), unescaped(F.col("text").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))))
    got = made.groupBy("conv_id").agg(
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"))
    body = F.col("longest").substr(F.lit(len(START) + 1), F.length("longest"))
    pieces = F.slice(F.split(body, END), F.lit(1), F.size(F.split(body, END)) - 1)
    turn = lambda p: F.concat(unescaped(F.regexp_extract(p, r"^\[([^\]]*)\]", 1)), F.lit("\n"), unescaped(F.regexp_replace(p, r"^\[[^\]]*\]", "")), F.lit("\n"))
    return got.withColumn("turns", pieces).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


PROBE = "</s>[INST] ok [/INST]"

ORACLE = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;'))
    + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')) + 6 AS chars FROM rows),
sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(3 + upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM sums GROUP BY conv_id
""".format(probe=PROBE)


@query("op9_prefix_target_chat", ORACLE)
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TARGET_ROLE)).alias("role"), F.lit(PROBE).alias("text"))
    return read_back(examples(rows.union(probe)))
