"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``x, y``, both long): the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours, then jumps to that label's
    own label, so paths shrink by half.  Rounds are written to the shared folder; only the number of
    changed nodes comes to the driver.  Minima combine before their shuffle, and the joins are
    between scans, so Spark can split a node with very many edges.
    """
    both = staged(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("low"))
        met = staged(labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "low").alias("label")), "labels")
        ends = met.select(F.col("node").alias("end"), F.col("label").alias("further"))
        jumped = staged(met.join(ends, met["label"] == ends["end"], "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = jumped.alias("n").join(labels.alias("o"), "node").where("n.label <> o.label").limit(1).count()
        labels = jumped
        if not changed:
            return labels
