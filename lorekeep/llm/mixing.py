"""Mixing sources to target weights along a low-discrepancy schedule.

Sources weigh 5, 2, 1, repeating in code-point order (null last), and share as many words as the
corpus has; no source gives more than ``MAX_EPOCHS`` times its words, what it cannot give is shared
by weight among the others.  That is one water level, found from running sums over the source table.

The mix is laid out in slots of ``block`` words.  Source intervals of slot numbers stand one after
another on a line as long as a power of two, and the van der Corput point of a slot - its bits
reversed - says which interval it falls in, so every source recurs at even steps.  The slots of a
source are ranked in schedule order; its documents, shuffled by a hash, lie end to end on a line of
words, repeated for every epoch; the slot of rank ``r`` takes the words of block ``r``.  Joining
slots to documents on (source, block) gives the pieces of the mix, and the order of slots is its order: a
document comes when the slot of its first piece is due.

Only built-in expressions run and no text moves.  Ranks and positions are running sums in three
levels (shares of the hash space, parts of a share, rows), so a source with any share of the rows is
dealt over many tasks, and each window sees a bounded part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import DOC, ROW, numbered, query, table, words
from lorekeep.session import staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
MIN_SLOTS = 256  # small corpora get smaller blocks
ROWS_PER_PART = 64  # rows that one window of a running sum sees, about
SLOTS_PER_ROW = 1 << 16  # slots that one row unfolds to


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` per source of ``sizes`` (``source, size``).

    Taking sources by cap per weight, each would set the level ``(total - caps before) / weights
    left`` if it were the first not to be capped.  That level grows while sources are rightly capped
    and falls behind the first that is not, so the greatest of them is the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS)))))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    cap = MAX_EPOCHS * F.col("source_size")
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("capped", F.coalesce(F.sum(cap).over(before), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.col("total") - F.col("capped")) / F.col("left_weight")
    per = per.withColumn("level", F.max(level).over(everything))
    share = F.col("level") * F.col("weight")
    target = F.when(share >= cap, cap.cast("double")).otherwise(share)
    return per.select("source", "source_size", "weight", target.alias("target"))


def running(df: DataFrame, key: list[str], share: Column, order: list[Column], value: Column, total_rows: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the same ``key``.

    ``share`` is a hash in [0, 2^30) that rows are ordered by first, then by ``order``.  Only windows
    over about ``ROWS_PER_PART`` rows, or over the square root of as many parts, are made.
    """
    parts_bits = max(0, min(30, (total_rows // ROWS_PER_PART).bit_length()))
    part = F.shiftright(F.col("_share"), 30 - parts_bits)
    df = df.withColumn("_share", share).withColumn("_part", part).withColumn("_value", value)
    totals = df.groupBy(*key, "_part").agg(F.sum("_value").alias("_sum")).withColumn("_top", F.shiftright("_part", parts_bits // 2))
    tops = totals.groupBy(*key, "_top").agg(F.sum("_sum").alias("_top_sum"))
    earlier = lambda by, order_by, what: F.coalesce(F.sum(what).over(
        W.partitionBy(*by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = tops.withColumn("_top_before", earlier(key, ["_top"], "_top_sum")).drop("_top_sum")
    totals = totals.withColumn("_in_top", earlier([*key, "_top"], ["_part"], "_sum"))
    same = lambda names: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names]
    before = totals.alias("l").join(tops.alias("r"), same([*key, "_top"])).select(
        *[F.col(f"l.{k}") for k in key], "l._part", (F.col("_in_top") + F.col("_top_before")).alias("_before"))
    inside = df.withColumn("_inside", earlier([*key, "_part"], [F.col("_share"), *order], "_value"))
    return inside.alias("l").join(before.alias("r"), same([*key, "_part"])).select(
        "l.*", (F.col("_inside") + F.col("_before")).alias(name)).drop("_share", "_part", "_value", "_inside")


def reversed_bits(number: Column, bits: int) -> Column:
    """The low ``bits`` of a number in reverse order: its van der Corput point times ``2 ** bits``."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


class Mix:
    """The schedule over ``docs``: ``targets``, ``documents`` and ``pieces``.

    A null text has no words; documents without words are in no piece.  Repeated rows are documents
    of their own.  Rows alike in id and size are interchangeable, all others have a fixed place in
    the shuffle.  An empty table gives an empty mix.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        sized = docs.select(
            *[c for c in docs.columns if c == ROW], F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            F.size(words(F.col(text))).cast("long").alias("size"))
        self.sizes = (staged(sized, "sizes") if ROW in docs.columns else numbered(sized)).withColumnRenamed(ROW, "row")
        self.targets = staged(source_targets(self.sizes), "targets")
        total, rows = self.sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        self.rows = rows
        # Blocks of BLOCK_WORDS, or as many words as give a small corpus MIN_SLOTS of them.
        self.block = max(1, min(BLOCK_WORDS, total // MIN_SLOTS))
        self.slots_wanted = max(1, -(-total // self.block))

    def slots(self) -> DataFrame:
        """``source, block, slot``: when each block of a source is due."""
        at = F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")
        blocks = F.ceil(F.floor(F.col("target") + 0.5) / self.block)
        intervals = staged(self.targets.withColumn("blocks", blocks).withColumn(
            "until", F.sum("blocks").over(W.orderBy(*at).rowsBetween(W.unboundedPreceding, 0))), "intervals")
        most = intervals.agg(F.coalesce(F.max("until"), F.lit(0))).first()[0]
        bits = max(0, int(most) - 1).bit_length()
        # Unfolded in two steps, so that a large source is neither one row nor one task.
        low = F.col("until") - F.col("blocks") + F.col("part") * SLOTS_PER_ROW
        coarse = intervals.where("blocks > 0").select("source", "until", "blocks", F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / SLOTS_PER_ROW))).alias("part")).repartition("source", "part")
        points = coarse.select("source", F.explode(F.sequence(low, F.least(low + SLOTS_PER_ROW, F.col("until")) - 1)).alias("point"))
        points = points.withColumn("slot", reversed_bits(F.col("point"), bits))
        # Slots are ranked in their own order: the high bits of the slot are its share.
        share = F.shiftleft(F.col("slot"), max(0, 30 - bits)) if bits <= 30 else F.shiftright(F.col("slot"), bits - 30)
        return running(points, ["source"], share.cast("int"), [F.col("slot")], F.lit(1), int(most), "block").drop("point")

    def documents(self) -> DataFrame:
        """The documents with ``start``, their place on the line of their source, and its target."""
        digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        share = F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 2).cast("int")
        placed = running(self.sizes.withColumn("_md5", digest), ["source"], share, [F.col("_md5"), F.col("size"), F.col("row")], F.col("size"), self.rows, "start")
        t = self.targets
        return placed.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
            "d.row", "d.doc_id", "d.source", "d.size", "d.start", "t.source_size", "t.target")

    def pieces(self) -> DataFrame:
        """Every document with the pieces the mix takes: ``slot``, ``epoch``, ``line`` (where the document
        begins on the line of its source in that epoch), ``offset`` (words into the document) and
        ``length``; one row without a slot where it takes none."""
        limit = F.floor(F.col("target") + 0.5)
        first = lambda e: e * F.col("source_size") + F.col("start")
        epochs = F.transform(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)), lambda e: F.struct(
            e.alias("epoch"), first(e).alias("low"), F.least(first(e) + F.col("size"), limit).alias("high")))
        taken = self.documents().select("*", F.explode_outer(F.filter(epochs, lambda e: e["high"] > e["low"])).alias("e"))
        blocks = F.when(F.col("e").isNotNull(), F.sequence(F.floor(F.col("e.low") / self.block), F.floor((F.col("e.high") - 1) / self.block)))
        cut = taken.select("*", F.explode_outer(blocks).alias("block"))
        low, high = F.greatest("e.low", F.col("block") * self.block), F.least("e.high", (F.col("block") + 1) * self.block)
        cut = cut.select("*", F.col("e.epoch").alias("epoch"), F.col("e.low").alias("line"), (low - F.col("e.low")).alias("offset"), (high - low).alias("length")).drop("e")
        due = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.block") == F.col("s.block"))
        return cut.alias("d").join(self.slots().alias("s"), due, "left").select("d.*", "s.slot").drop("block")

    def taken(self) -> DataFrame:
        """One row per document: the words the mix takes of it over all its pieces, and ``first_slot``, when
        the first is due (null where it takes none)."""
        whole = F.col("slot").isNotNull()
        return self.pieces().groupBy("row", "doc_id", "size", "source_size", "target").agg(
            F.coalesce(F.sum(F.when(whole, F.col("length"))), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, white space as it was."""
    spaces = F.split(text, r"[^\x20\x09-\x0D]+")
    return F.array_join(F.zip_with(F.slice(spaces, F.lit(1), n), F.slice(words(text), F.lit(1), n), lambda s, w: F.concat(s, w)), "")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix has them: a row per whole epoch of a document, and for a document that the
    target cuts, a row with the words that still fit.  Rows are in schedule order, by the slot of their
    first piece, over ranges of slots and within them.  Columns of ``docs`` only.

    The schedule fills its slots evenly, so ranges of equal width hold about equal work, and no pass over
    the texts has to find their bounds; a slot has ``block`` words at most.  So texts move twice: to
    their spans, and to their places."""
    columns, docs = docs.columns, numbered(docs)
    mix = Mix(docs, doc_id, text, source)
    due = F.struct(F.min("slot").alias("slot"), F.min("line").alias("line"), F.sum("length").alias("take"))
    spans = mix.pieces().where("slot is not null").groupBy("row", "size", "epoch").agg(due.alias("due"))
    spans = spans.groupBy("row", "size").agg(F.collect_list("due").alias("due")).select(
        F.col("row").alias(ROW), F.col("size").alias(f"{DOC}_size"), F.explode("due").alias(f"{DOC}_due"))
    spans = staged(spans, "spans")
    slot, take = F.col(f"{DOC}_due.slot"), F.col(f"{DOC}_due.take")
    last = spans.agg(F.coalesce(F.max(slot), F.lit(0))).first()[0]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(slot * F.lit(ranges) / F.lit(last + 1)).cast("int")
    joined = docs.join(spans, ROW)
    joined = joined.withColumn(text, F.when(take == F.col(f"{DOC}_size"), F.col(text)).otherwise(first_words(F.col(text), take.cast("int"))))
    order = [slot, F.col(f"{DOC}_due.line"), F.col(ROW)]
    return joined.repartitionById(ranges, at).sortWithinPartitions(*order).select(*columns)


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight FROM per),
lined AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM weighed),
levels AS (
  SELECT *, (SELECT arg_min((total - capped)::DOUBLE / left_weight, (source_size / weight, source IS NULL, source)) FROM lined
    WHERE (total - capped)::DOUBLE / left_weight <= 3.0::DOUBLE * source_size / weight) AS level FROM lined),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight >= 3 * source_size THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes),
width AS (SELECT greatest(1, least(1024, coalesce(sum(size), 0)::BIGINT // 256)) AS block FROM sizes),
intervals AS (
  SELECT source, ceil(floor(target + 0.5) / block)::BIGINT AS blocks, sum(ceil(floor(target + 0.5) / block)::BIGINT) OVER (ORDER BY source IS NULL, encode(source))::BIGINT AS until
  FROM targets, width),
bits AS (SELECT len(bin(max(until) - 1)) AS bits FROM intervals),
slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS number FROM (
    SELECT source, list_sum(list_transform(range(bits), lambda i: ((point >> i::INT) & 1) << (bits - 1 - i)::INT))::BIGINT AS slot
    FROM (SELECT source, bits, unnest(range(until - blocks, until)) AS point FROM intervals, bits))),
laid AS (SELECT p.*, CASE WHEN p.size > 0 AND p.start < floor(t.target + 0.5) THEN p.start // block END AS number
  FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source, width)
SELECT p.doc_id, p.size, t.source_size, t.target, (
    greatest(0, least(p.start + p.size, floor(t.target + 0.5)) - p.start)
  + greatest(0, least(p.start + p.size + t.source_size, floor(t.target + 0.5)) - p.start - t.source_size)
  + greatest(0, least(p.start + p.size + 2 * t.source_size, floor(t.target + 0.5)) - p.start - 2 * t.source_size))::BIGINT AS taken, s.slot AS first_slot
FROM laid p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source
LEFT JOIN slots s ON s.source IS NOT DISTINCT FROM p.source AND s.number = p.number
"""


@query("op7_low_discrepancy_mix", ORACLE)
def op7(spark, sf_dir):
    taken = Mix(table(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")
