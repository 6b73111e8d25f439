"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with the number of equal ones before it.
Two texts are as similar as the longest common subsequence of their shingles, over all shingles of
either: the Jaccard similarity of shingles, counting only those that keep their order.  Near
duplicates have 0.8 or more, and classes are the connected components of such pairs.

Texts with equal words collapse first, by a 128-bit hash.  Each distinct text then gets
``SKETCHES`` sketches; one sketch is the ``PICKED`` smallest shingles under an order of its own,
kept in text order and hashed.  Texts that agree on ``AGREE`` sketches are candidates.  Picking is
without replacement: of two texts with ``u`` shingles between them, ``c`` of them common, a sketch
agrees with probability C(c, 8) / C(u, 8), which tends to 0.8 ** 8 from below as texts grow.

Short texts do not rely on that.  Texts alike share 0.8 of the shingles of either, so under any one
order of shingles they share one among the first ``n // 5 + 1`` of each.  These, rarest first, are
keys of every text that can be alike to one of up to ``SHORT`` shingles, and every pair with a text
that short is aligned whatever its sketches: such pairs are found for certain.  Above, a pair at
exactly 0.8 is missed with a chance of at most 6 in 10,000, falling to 1 in 10,000 in long texts.

Buckets may be large, so no bucket is paired off.  The centre of a bucket is the member that shares
most buckets with others, the likely original.  A text meets the heaviest of its centres, then those it is
not in one component with yet.  That leaves, per bucket, the members outside
its centre's component; only buckets that have any go on.  Of their members, those stay that may still
have a similar text there: a text with too many shingles no other member has cannot.  Nor can two copies
of one original that differ from it at different places, if either has too little of it left (``reach``).
Ever more of the rest, at first one of each component, are compared with every member of another component
that these bounds leave, until none is left.  So two texts of one bucket end in one component, have been compared, or cannot be similar.
After each round the similar pairs shrink to links between components, so there are never more of them than
texts still apart.  Nothing is capped, and candidate pairs, links and labels stay in tables of the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import ROW, numbered, query, table, words
from lorekeep.llm.components import components
from lorekeep.session import arrow_batches, staged

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 64
PICKED = 8
AGREE = 2
SHORT = 40  # shingles up to which candidates are exact
FIRST_CENTRES = 32
COLD = 32  # texts that may have a shingle their pivot has not for its pairs to be compared outright
BATCH_ROWS = 1000  # texts or pairs that a Python worker holds at once

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingle hashes of a text's word hashes; a shorter text is one shingle."""
    h = hashes.view(np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s = _mix(s * _STEP + h[k:k + n] + np.uint64(k))
    order = np.argsort(s, kind="stable")
    first = np.r_[True, np.diff(s[order]) != 0]
    if not first.all():
        at = np.arange(n)
        seen = np.empty(n, np.uint64)
        seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        s = _mix(s + seen * _STEP)
    return s


def sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCHES`` hashes, each of the ``PICKED`` least shingles of one order, in text order."""
    if not len(s):
        return np.zeros(SKETCHES, np.uint64)
    picked = min(PICKED, len(s))
    seeds = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _STEP)
    out = np.empty(SKETCHES, np.uint64)
    width = max(1, (1 << 17) // len(s))  # orders ranked at once: a megabyte, or one order of a longer text
    for low in range(0, SKETCHES, width):
        ranks = _mix(s[None, :] ^ seeds[low:low + width, None])
        at = np.argpartition(ranks, picked - 1, axis=1)[:, :picked] if picked < len(s) else np.broadcast_to(np.arange(len(s)), ranks.shape)
        kept = s[np.sort(at, axis=1)]
        value = np.zeros(len(kept), np.uint64)
        for k in range(picked):
            value = _mix(value * _STEP + kept[:, k] + np.uint64(k))
        out[low:low + width] = value
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Ordered shingle similarity, 0 where it is certain to be under ``least``.

    Labelled shingles occur once in a text, so the common subsequence is a longest increasing run
    of matched positions.  A run long enough never strays further from the diagonal than the
    shingles it may leave out; matches outside that band are dropped first.
    """
    total = len(a) + len(b)
    need = int(np.ceil(total * least / (1 + least) - 1e-9))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < max(1, need):
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= max(len(a), len(b)) - need]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    return common / (total - common) if common >= need else 0.0


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def sketched(texts: DataFrame) -> DataFrame:
    """``row, n, sketches`` of ``texts`` (``row, hashes``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingles(h) for h in _lists(batch.column(1))]
            marks = np.concatenate([sketch(s) for s in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
            marks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(marks) + 1, SKETCHES), pa.int32()), pa.array(marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in parts], pa.int64()), marks], ["row", "n", "sketches"])

    return texts.select("row", "hashes").mapInArrow(run, "row long, n long, sketches array<long>")


def parts(texts: DataFrame) -> DataFrame:
    """``row, shingle``: every labelled shingle of ``texts`` (``row, hashes``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
                s = shingles(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row)), pa.array(s)], ["row", "shingle"])

    return texts.select("row", "hashes").mapInArrow(run, "row long, shingle long")


def aligned(pairs: DataFrame) -> DataFrame:
    """``x, y`` of the pairs (``x, y, left, right``: word hashes of both) that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(shingles(a), shingles(b)) >= SIMILARITY for a, b in zip(_lists(batch.column(2)), _lists(batch.column(3)))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.select("x", "y", "left", "right").mapInArrow(run, "x long, y long")


class NearDuplicates:
    """Classes of the rows of ``docs``.

    A null, empty or blank text is alone in its class.  Texts of fewer than five words match only
    equal ones.  Repeated rows are copies.  Ids may be null or repeat: rows are told apart by their
    place in the table, and a class is named after its smallest id (null last).  An empty table
    gives no rows.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.split = numbered(docs.select(*[c for c in docs.columns if c in (ROW, doc_id, text)])).select(
            F.col(ROW).alias("row"), F.col(doc_id).alias("id"), words(F.col(text)).alias("words"))
        self.compared: DataFrame | None = None
        self.labels = staged(docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("label")), "labels")

    def classes(self) -> DataFrame:
        """``row, id, class_id, class_size, kept``; one row of each class, its first, is kept."""
        keyed = self.split.select("row", "id", F.size("words").alias("size"), F.xxhash64("words").alias("a"), F.xxhash64(F.lit("b"), "words").alias("b"))
        # A text without words gets a key of its own.
        own = F.when(F.col("size") == 0, F.col("row")).otherwise(F.lit(-1))
        keyed = staged(keyed.withColumn("own", own), "keys")
        order = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("row"))
        groups = staged(keyed.groupBy("a", "b", "own").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")), "groups")
        with arrow_batches(groups.sparkSession, BATCH_ROWS):
            self.link(groups.where("size > 0").select(F.col("first.row").alias("row")))
        named = groups.join(self.labels, F.col("first.row") == F.col("node"), "left").withColumn("label", F.coalesce("label", "first.row"))
        classes = staged(named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")), "classes")
        of_group = staged(named.select("a", "b", "own", "label").join(classes, "label").select(
            "a", "b", "own", F.col("first.id").alias("class_id"), F.col("first.row").alias("kept_row"), "class_size"), "named")
        return keyed.join(of_group, ["a", "b", "own"]).select("row", "id", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"))

    def link(self, rows: DataFrame) -> None:
        """Finds ``links`` (``x, y``) between the distinct texts in ``rows``."""
        texts = self.split.select("row", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
        self.marks = staged(sketched(texts).join(rows, "row", "left_semi"), "sketches")
        one = staged(self.marks.select("row", F.posexplode("sketches").alias("j", "h")).union(self.prefixes(texts)), "marks")
        shared = staged(one.groupBy("j", "h").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
        members = staged(one.join(shared, ["j", "h"]).select(F.xxhash64("j", "h").alias("bucket"), "row", "members"), "members")
        weight = staged(members.groupBy("row").agg(F.sum("members").alias("weight")), "weights")
        # Only texts that share a bucket are read again.
        self.texts = staged(texts.join(weight.select("row"), "row", "left_semi"), "texts")
        members = staged(members.select("bucket", "row").join(weight, "row"), "members")

        centre = members.groupBy("bucket").agg(F.max(F.struct("weight", F.negative("row").alias("back"))).alias("c"))
        centres = staged(centre.select("bucket", F.negative("c.back").alias("centre"), F.col("c.weight").alias("centre_weight")), "centres")
        self.approach(members.join(centres, "bucket").where("row <> centre").select("row", "centre", "centre_weight").distinct())
        centres = centres.drop("centre_weight")

        rest = self.outside(members, centres)
        if rest.limit(1).count():
            opened = staged(members.join(rest.select("bucket").distinct(), "bucket").select("bucket", "row", "weight"), "opened")
            self.settle(self.reach(self.hopeful(opened)), centres, rest)

    def approach(self, stars: DataFrame) -> None:
        """Compares texts with the centres of their buckets (``row, centre, centre_weight``): with the
        heaviest first, which is the original of most copies, then with those still in other components."""
        place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("centre_weight"), "centre"))
        self.stars = stars = staged(stars.withColumn("place", place).select("row", "centre", "place"), "stars")
        for near in ("place = 1", "place > 1"):
            due = self.labelled(stars.where(near)).join(self.label_of("centre", "home"), "centre", "left")
            self.verify(due.where("label <> coalesce(home, centre)").select(F.col("row").alias("x"), F.col("centre").alias("y")))

    def prefixes(self, texts: DataFrame) -> DataFrame:
        """``row, j, h``: the rarest shingles of short texts, as many as one must be shared of.

        A shingle in one text only takes a place and makes no key.  Shingles are counted before they
        shuffle, and meet their counts in a join of two written tables, which Spark splits by size.
        """
        short = self.marks.where(F.col("n").between(1, int(SHORT / SIMILARITY + 1e-9))).select("row")
        each = staged(parts(texts.join(short, "row", "left_semi")), "short")
        common = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "common")
        ranked = each.join(common, "shingle", "left").groupBy("row").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "shingle"))).alias("found"))
        first = F.slice("found", F.lit(1), F.floor(F.size("found") * (1 - SIMILARITY) + 1e-9).cast("int") + 1)
        return ranked.select("row", F.explode(first).alias("s")).where("s.texts > 1").select("row", F.lit(-1).alias("j"), F.col("s.shingle").alias("h"))

    def hopeful(self, members: DataFrame) -> DataFrame:
        """Members that may have a similar text in their bucket.

        ``own`` shingles of a text are in no other member of any bucket here, so it shares at most
        the other ``n - own``.  For a similarity of ``s`` the shared ones must be ``s / (1 + s)`` of
        both sizes together, so a partner has at most ``most`` shingles.  Counting shingles takes
        one combined pass over these texts.
        """
        each = self.opened = staged(parts(self.texts.join(members.select("row").distinct(), "row", "left_semi")), "shingles")
        once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("row").alias("row")).where("texts = 1")
        own = once.groupBy("row").agg(F.count(F.lit(1)).alias("own"))
        known = self.marks.select("row", "n").join(own, "row", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        sized = staged(members.join(known, "row"), "sized")
        least = sized.groupBy("bucket").agg(F.min("n").alias("least"))
        shared = F.col("n") - F.col("own")
        most = shared * ((1 + SIMILARITY) / SIMILARITY) - F.col("n") + 1e-6
        able = (F.col("least") <= F.col("most")) & (shared + 1e-6 >= SIMILARITY * F.col("n"))
        return staged(sized.withColumn("most", most).join(least, "bucket").where(able).select("bucket", "row", "weight", "n", "most"), "hopeful")

    def reach(self, members: DataFrame) -> DataFrame:
        """Members with what they can share with others of their ``pivot``, the heaviest centre they met.

        Two texts share shingles of the pivot, at most as many as either has (``near``), and shingles
        that are not the pivot's.  Pairs with one of the latter are few where copies differ at places of their
        own: they are compared here.  Any other pair of one pivot needs enough in ``near`` on both
        sides, which bounds a partner's size by ``reach``.  A text with a shingle that is not the
        pivot's and yet in more than ``COLD`` others is ``plain``: two such are not bounded by that."""
        pivots = self.stars.where("place = 1").select("row", F.col("centre").alias("pivot"))
        rows = staged(members.select("row", "n").distinct().join(pivots, "row", "left").withColumn("pivot", F.coalesce("pivot", "row")), "pivots")
        of_pivot = parts(self.texts.join(rows.select(F.col("pivot").alias("row")).distinct(), "row", "left_semi"))
        of_pivot = of_pivot.select(F.col("row").alias("pivot"), "shingle", F.lit(True).alias("inside"))
        marked = self.opened.join(rows, "row").join(of_pivot, ["pivot", "shingle"], "left")
        marked = staged(marked.select("row", "n", "pivot", "shingle", F.col("inside").isNotNull().alias("inside")), "marked")
        extras = marked.where("not inside").select("pivot", "shingle", "row")
        shared = staged(extras.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "extras")
        plain = extras.join(shared.where(F.col("texts") > COLD), ["pivot", "shingle"], "left_semi").select("row").distinct().withColumn("plain", F.lit(True))
        cold = staged(extras.join(shared.where(F.col("texts") <= COLD), ["pivot", "shingle"], "left_semi"), "cold")
        self.verify(cold.select("pivot", "shingle", F.col("row").alias("x")).join(cold.select("pivot", "shingle", F.col("row").alias("y")), ["pivot", "shingle"]).where("x < y").select("x", "y"))
        near = marked.groupBy("row", "n", "pivot").agg(F.count_if("inside").alias("near")).join(plain, "row", "left")
        reach = F.col("near") * ((1 + SIMILARITY) / SIMILARITY) - F.col("n") + 1e-6
        near = staged(near.select("row", "pivot", reach.alias("reach"), F.col("plain").isNotNull().alias("plain")), "reach")
        return staged(members.join(near, "row"), "reaching")

    def outside(self, members: DataFrame, centres: DataFrame) -> DataFrame:
        """Members that are not in the component of their bucket's centre."""
        labelled = self.labelled(members)
        at = centres.join(self.label_of("centre", "home"), "centre", "left").withColumn("home", F.coalesce("home", "centre"))
        return staged(labelled.join(at, "bucket").where("label <> home").drop("centre", "home"), "outside")

    def label_of(self, node: str, label: str) -> DataFrame:
        return self.labels.select(F.col("node").alias(node), F.col("label").alias(label))

    def labelled(self, members: DataFrame) -> DataFrame:
        """``members`` with the ``label`` of their row.  A text meets its label once, with a list of all its
        places: at most one for each sketch and each rare shingle of a short text."""
        rest = [c for c in members.columns if c != "row"]
        texts = members.groupBy("row").agg(F.collect_list(F.struct(*rest)).alias("places"))
        met = texts.join(self.label_of("row", "label"), "row", "left")
        return met.select("row", F.coalesce("label", "row").alias("label"), F.explode("places").alias("p")).select("row", "p.*", "label")

    def settle(self, members: DataFrame, centres: DataFrame, rest: DataFrame) -> None:
        """Compares members outside the component of their centre (``rest``) with all of other components,
        more of them per bucket in each round, until every one has had its turn.

        One that has had its turn, or has come into the centre's component, never looks again, and a bucket
        without a turn is not read again: neither comes back."""
        turn = FIRST_CENTRES
        rest = members.join(rest.select("bucket", "row"), ["bucket", "row"], "left_semi")
        while True:
            # Of a component few members at first: where one finds a partner, the others need not look.
            first = F.row_number().over(W.partitionBy("bucket", "label").orderBy(F.desc("weight"), "row"))
            place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("weight"), "row"))
            rest = self.outside(rest, centres)
            now = rest.withColumn("first", first).where(F.col("first") <= max(1, turn // FIRST_CENTRES)).withColumn("place", place).where(F.col("place") <= turn)
            now = staged(now.select("bucket", "row", "label", "n", "most", "pivot", "reach", "plain"), "turn")
            if not now.limit(1).count():
                return
            there = self.labelled(members.join(now.select("bucket").distinct(), "bucket", "left_semi")).select(
                "bucket", F.col("row").alias("y"), F.col("label").alias("there"), *[F.col(c).alias(f"{c}_y") for c in ("n", "most", "pivot", "reach", "plain")])
            able = "label <> there and n_y <= most and n <= most_y and (pivot <> pivot_y or (plain and plain_y) or (n_y <= reach and n <= reach_y))"
            pairs = now.join(there, "bucket").where(able).select(F.col("row").alias("x"), "y")
            self.verify(pairs)
            rest = rest.drop("label").join(now.select("bucket", "row"), ["bucket", "row"], "left_anti")
            turn *= 2

    def verify(self, pairs: DataFrame) -> None:
        """Joins the components of the similar ones of ``pairs`` (``x, y``).

        A similar pair is a link between the components its texts are in by now, and equal links are
        one, so what there is to join never outgrows the texts that were still apart."""
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["x", "y"], "left_anti")
        pairs = staged(pairs, "pairs")
        if not pairs.limit(1).count():
            return
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        side = lambda c, n, m: self.marks.select(F.col("row").alias(c), F.col("n").alias(n), F.col("sketches").alias(m))
        agree = F.size(F.filter(F.zip_with("mx", "my", lambda a, b: a == b), lambda same: same))
        likely = staged(
            pairs.join(side("x", "nx", "mx"), "x").join(side("y", "ny", "my"), "y")
            .where((F.least("nx", "ny") >= SIMILARITY * F.greatest("nx", "ny")) & ((F.least("nx", "ny") <= SHORT) | (agree >= AGREE))).select("x", "y"), "likely")
        words_of = lambda c, h: self.texts.select(F.col("row").alias(c), F.col("hashes").alias(h))
        found = staged(aligned(likely.join(words_of("x", "left"), "x").join(words_of("y", "right"), "y")), "similar")
        home = lambda c, there: F.coalesce(there, c)
        links = found.join(self.label_of("x", "lx"), "x", "left").join(self.label_of("y", "ly"), "y", "left").select(home("x", "lx").alias("x"), home("y", "ly").alias("y"))
        links = staged(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
        if links.limit(1).count():
            joined = components(links).select(F.col("node").alias("was"), F.col("label").alias("now"))
            moved = self.labels.join(joined, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
            alone = joined.join(self.labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
            self.labels = staged(moved.union(alone), "labels")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return NearDuplicates(docs, doc_id, text).classes()


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first row of each class."""
    docs = numbered(docs)
    kept = near_classes(docs, doc_id, text).where("kept").select(F.col("row").alias(ROW))
    return docs.join(kept, ROW, "left_semi").drop(ROW)


@query("op5_order_minhash")
def op5(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size")
