"""Prefix trie of conversations by whole-sequence collapse.

A node is a distinct sequence of first turns; its members are the conversations that start with it.
Texts stay where they are: a turn is its ``mark``, an MD5 of role and text.  A node is its depth and 128
bits: the exclusive or of a hash of (depth, mark) over its turns.  That is a running sum along a
conversation, so it is taken in blocks of ``BLOCK`` turns and a conversation of any length is dealt over
many tasks.

1. Identical conversations collapse into one weighted sequence, known by the key of its last turn and
   named after its smallest conversation; the list of conversations that end there stays a table.
2. Sequences that are proper prefixes of others go by an anti-join with the keys that precede any turn;
   the others are the leaves.
3. The weighted prefixes of the sequences, one path per sequence, add up by key to the nodes.

Sums over subtrees need no walk through the levels.  What all members hold below a node is the sum over
its sequences of weight times bytes from there on.  What the nodes themselves hold is counted once by
giving each to the smallest leaf below it: on the path of a leaf its own nodes are the last ones, so the
nodes below ``v`` add up from one figure per leaf through ``v`` and the path of its own leaf.

Joins on a conversation go by (conversation, block), so that a long one is split there too; everything else
combines before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import query, table, text_of
from lorekeep.session import staged

BLOCK = 4096  # turns of a conversation that one window sees
IDS_PER_CHUNK = 4096  # width of the id range whose ends are joined to one text
KEY = ["depth", "a", "b"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    mark = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")))
    return rows.where("conv_id is not null").withColumn("mark", mark)


def placed(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, place, block, mark, bytes``: the turns in order, ``place`` from 1, ``bytes`` of the text.

    Turns go by number, null first, ties by their mark; repeated rows are turns of their own.  Null roles
    and texts are empty.  Rows without a conversation id belong to no conversation and take no part.
    Rows are dealt by ranges of (conversation, turn), so no conversation and no repeated row is too
    large for a task; places are counted within a range and added up over the ranges.
    """
    rows = _turns(conversations, conv_id, turn, role, text).select(
        "conv_id", "turn", "mark", F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "mark", "row"]
    ranged = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("inside", F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order)))
    before = F.sum("count").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy("part", "conv_id").count().withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("inside") + F.col("before")
    return staged(inside.join(counts, ["part", "conv_id"]).select(
        "conv_id", place.alias("place"), F.floor(place / BLOCK).alias("block"), "mark", "bytes"), "placed")


def texts(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``mark, role, text``: what the marks of nodes stand for."""
    return _turns(conversations, conv_id, turn, role, text).groupBy("mark").agg(F.min("role").alias("role"), F.min("text").alias("text"))


class PrefixTrie:
    """The trie of ``turns`` (``conv_id, depth, block, mark, bytes``) of ``conversations`` (``conv_id, depth``).

    ``depth`` counts the turns of a conversation from 1 without gaps; a conversation without turns has
    depth 0 and ends at the root.  Each ``block`` holds consecutive turns of its conversation, in
    ascending order.  Without conversations there are no nodes.
    """

    def __init__(self, turns: DataFrame, conversations: DataFrame):
        lead = lambda *cols: [F.xxhash64(*cols).alias("za"), F.xxhash64(F.lit("b"), *cols).alias("zb")]
        turns = staged(turns.select("conv_id", "block", "depth", "mark", "bytes", *lead("depth", "mark")), "turns")
        upto = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
        inside = turns.select("*", *[f.over(upto).alias(n) for n, f in [("ia", F.bit_xor("za")), ("ib", F.bit_xor("zb")), ("ibytes", F.sum("bytes"))]])
        blocks = staged(turns.groupBy("conv_id", "block").agg(F.bit_xor("za").alias("a"), F.bit_xor("zb").alias("b"), F.sum("bytes").alias("bytes")), "blocks")
        earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        before = [F.coalesce(f.over(earlier), F.lit(0)).alias(n) for n, f in [("ba", F.bit_xor("a")), ("bb", F.bit_xor("b")), ("bbytes", F.sum("bytes"))]]
        a, b = F.col("ia").bitwiseXOR(F.col("ba")), F.col("ib").bitwiseXOR(F.col("bb"))
        prefixes = staged(inside.join(blocks.select("conv_id", "block", *before), ["conv_id", "block"]).select(
            "conv_id", "block", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("za")).alias("pa"), b.bitwiseXOR(F.col("zb")).alias("pb"),
            "mark", "bytes", (F.col("ibytes") + F.col("bbytes")).alias("upto")), "prefixes")

        # Whole sequences: the key after the last turn, with the conversations that end there.
        whole = blocks.groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("total"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        self._ends = staged(conversations.select("conv_id", "depth").join(whole, "conv_id", "left").select("conv_id", "depth", zero("a"), zero("b"), zero("total")), "ends")
        sequences = staged(self._ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.min("total").alias("total")), "sequences")

        # A key before some turn is a proper prefix; sequences without one are the leaves.
        proper = prefixes.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", F.lit(True).alias("leaf"))
        sequences = staged(sequences.join(leaves, "conv_id", "left").withColumn("leaf", F.col("leaf").isNotNull()), "leaves")

        spans = blocks.select("conv_id", "block").join(sequences.select("conv_id", "weight", "total", "leaf"), "conv_id")
        paths = staged(prefixes.join(spans, ["conv_id", "block"]), "paths")
        leaf = F.when(F.col("leaf"), F.col("conv_id"))
        above = F.col("upto") - F.col("bytes")  # bytes of the turns before the last
        nodes = staged(paths.groupBy(*KEY).agg(
            F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count(leaf).alias("n_leaves"), F.min(leaf).alias("owner"),
            F.sum(F.col("weight") * (F.col("total") - above)).alias("held"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
            F.min("mark").alias("mark"), F.min(above).alias("above")), "nodes")

        # Each leaf's own nodes begin where no smaller leaf shares the path.
        own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("above").alias("own_from"))
        owned = staged(sequences.where("leaf").join(own, "conv_id").select("conv_id", "own_from", (F.col("total") - F.col("own_from")).alias("own")), "owned")
        below = paths.where("leaf").join(blocks.select("conv_id", "block").join(owned, "conv_id"), ["conv_id", "block"])
        below = below.groupBy(*KEY).agg(F.sum("own").alias("own"), F.min_by("own_from", "conv_id").alias("own_from"))
        once = F.col("own") + F.col("own_from") - F.col("above")  # bytes of the nodes of the subtree
        each = nodes.join(below, KEY).select(*KEY, "pa", "pb", "mark", "conv_id", "n_convs", "n_leaves", (F.col("held") - once).alias("saved"))

        root = sequences.join(owned.select("conv_id", "own"), "conv_id", "left").agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count(F.when(F.col("leaf"), 1)).alias("n_leaves"),
            (F.sum(F.col("weight") * F.col("total")) - F.coalesce(F.sum("own"), F.lit(0))).alias("saved")).where("n_convs > 0")
        none = F.lit(None).cast("long")
        root = root.select(F.lit(0).cast("int").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
                           none.alias("pa"), none.alias("pb"), F.lit(None).cast("string").alias("mark"), "conv_id", "n_convs", "n_leaves", "saved")
        self._nodes = staged(each.withColumn("depth", F.col("depth").cast("int")).select(*root.columns).union(root), "trie")

    def nodes(self) -> DataFrame:
        """``depth, a, b`` (the node's key), ``mark`` of its last turn, ``conv_id`` (its smallest member),
        ``parent_conv_id``, ``n_convs, n_children, n_leaves, saved_bytes``; no ``mark`` and no parent for the root."""
        nodes = self._nodes
        parent = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
        children = parent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
        named = staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "named")
        parents = named.where("n_children > 0").select(F.col("depth").alias("pdepth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
        return named.withColumn("pdepth", F.col("depth") - 1).join(parents, ["pdepth", "pa", "pb"], "left").select(
            *KEY, "mark", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_bytes"))

    def ends(self) -> DataFrame:
        """``conv_id, depth, a, b``: the node at which each conversation ends."""
        return self._ends.select("conv_id", *KEY)


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the comma-joined ids, ascending, that end at a node.

    Ids of one range of ``IDS_PER_CHUNK`` become one text first, wherever the group is large; the texts
    of a node are then hashed one after another from a sorted partition, and no list is ever held.
    """
    chunk = F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*KEY, chunk).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def batch_of(rows):
            columns = list(zip(*rows))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*KEY, "ends_sha256"])

        for batch in batches:
            for depth, a, b, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (depth, a, b) == key:
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, a, b), hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield batch_of(done)
                done = []
        if key:
            yield batch_of([(*key, digest.hexdigest())])

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(run, "depth int, a long, b long, ends_sha256 string")


def rebuilt(turns: DataFrame, share: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (``conv_id, depth``) in which neighbours share a head.

    Conversation ``c`` starts with the first ``h`` of ``turns`` of conversation ``c - c % share`` (all if it has
    fewer, none if it is absent) and goes on with its own after the first ``h``; ``h`` is the unsigned
    CRC-32 of the decimal ``c`` modulo ``heads``.  The remainder has the sign of ``c``.
    """
    wanted = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    base = F.col("conv_id") - F.col("conv_id") % share
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = staged(sizes.withColumns({"base": base, "skipped": wanted}).join(bases, "base", "left").select(
        "conv_id", "base", "n", "skipped", F.least("skipped", F.coalesce("base_n", F.lit(0))).alias("head")), "shared")
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % share == 0)).withColumnRenamed("conv_id", "base")
    first = first.drop("block").join(convs.select("conv_id", "base", "head"), "base").where("place <= head")
    first = first.select("conv_id", F.lit(-1).cast("long").alias("block"), F.col("place").cast("int").alias("depth"), "mark", "bytes")
    spans = convs.select("conv_id", "skipped", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    rest = turns.join(spans, ["conv_id", "block"]).where("place > skipped")
    rest = rest.select("conv_id", "block", (F.col("place") - F.col("skipped") + F.col("head")).cast("int").alias("depth"), "mark", "bytes")
    depth = F.col("head") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0))
    return first.union(rest), convs.select("conv_id", depth.cast("int").alias("depth"))


ORACLE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc_table),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
joined AS (
  SELECT h.conv_id, 0 AS own, t.i, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.i <= h.h
  UNION ALL SELECT h.conv_id, 1, t.i, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.i > h.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, list(md5(role || chr(0) || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
prefixes AS (
  SELECT conv_id, depth, bytes, md5(array_to_string(path, ',')) AS node,
    CASE WHEN depth > 1 THEN md5(array_to_string(path[:depth - 1], ',')) ELSE 'root' END AS parent FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(bytes) AS bytes FROM prefixes GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM nodes n LEFT JOIN children c ON c.node = n.node
  JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN ends e ON e.node = n.node
"""


@query("op12_conversation_trie", ORACLE)
def op12(spark, sf_dir):
    trie = PrefixTrie(*rebuilt(placed(table(spark, sf_dir, "conversations"))))
    return trie.nodes().join(end_digests(trie.ends()), KEY, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
