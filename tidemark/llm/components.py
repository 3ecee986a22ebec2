"""Connected components of a graph held as a DataFrame, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of an edge (both columns of type long).

    A distributed union-find: each round hooks a node to the least label among its neighbours, then replaces labels by
    the labels of these (pointer jumping), so paths shorten geometrically. Messages are combined on the map side, and each
    round's forest is written to the shared folder. Self-loops and repeated edges do no harm; null ends are left out.
    """
    one = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    both = materialise(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    forest = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "forest")
    while True:
        heard = both.join(forest, both["u"] == forest["node"]).groupBy("v").agg(F.min("label").alias("heard"))
        hooked = forest.join(heard, forest["node"] == heard["v"], "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("near"), F.col("label").alias("old"))
        up = forest.select(F.col("node").alias("p"), F.col("label").alias("up"))
        after = hooked.join(up, hooked["near"] == up["p"]).select("node", F.least("near", "up").alias("label"), "old")
        after = materialise(after, "forest")
        forest = after.select("node", "label")
        if after.where("label <> old").limit(1).count() == 0:
            return forest
