"""Connected components over an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b longs) -> (node, label): the smallest node reachable.

    Minimum-label hooking with pointer jumping: each round takes the smallest label among
    neighbours (a partial aggregate, so a hub with a third of all edges is summed map-side),
    hooks the old label's own tree on it and halves path lengths. Rounds grow with the
    logarithm of the longest chain. An empty edge table gives an empty result.
    """
    both = written(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        seen = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "low").alias("low"))
        # what a node saw is offered to itself and to the node it points to
        offers = seen.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("label").alias("node"), "low"))).alias("o")).select("o.node", "o.low")
        hooked = written(offers.groupBy("node").agg(F.min("low").alias("to")), "hooked")
        parents = hooked.select(F.col("node").alias("to"), F.col("to").alias("up"))
        after = written(hooked.join(parents, "to").join(label.withColumnRenamed("label", "was"), "node").select("node", F.least("to", "up").alias("label"), (F.least("to", "up") < F.col("was")).alias("moved")), "labels")
        changed = bool(after.where("moved").take(1))
        for x in (hooked, label):
            drop(x)
        label = after.drop("moved")
        if not changed:
            drop(both)
            return label
