"""Connected components of an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BYTES, measured, stored


def components(edges: DataFrame, paths: bool = False) -> DataFrame:
    """edges(u long, v long) -> (node, component): the least node that each node is connected to.

    With `paths` also path: the node's labels of all rounds. Nodes that share an early one are near each other.

    Each round a node takes the least label around it, the node that was its label takes that too, and both then
    take their label's own label. So nodes that share a label move together, and the number of rounds grows with
    the logarithm of the longest way, not with the way. Every round is written to the shared folder; only a count comes to the driver. Self-loops and
    repeated edges don't matter; nulls are not allowed. Nodes without edges are not listed.

    What a node hears and what it has are added up by one aggregation, and so is what it passes on: a round is two
    joins and two aggregations, as the driver's memory goes with the number of stages that it plans.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component"))
    labels = stored(labels, "labels")
    rounds, n = [labels], both.count()  # no fewer than labels
    none = F.lit(None).cast("long").alias("was")
    while True:
        heard = both.join(measured(labels, n, KEY_BYTES), F.col("v") == F.col("node")).select(F.col("u").alias("node"), F.col("component").alias("near"), none)
        own = labels.select("node", F.col("component").alias("near"), F.col("component").alias("was"))
        around = heard.union(own).groupBy("node").agg(F.min("near").alias("near"), F.max("was").alias("was"))
        passed = F.explode(F.array(F.struct("node", "near", "was"), F.struct(F.col("was").alias("node"), "near", none))).alias("p")
        lower = around.select(passed).select("p.*").groupBy("node").agg(F.max("was").alias("was"), F.min("near").alias("component"))
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("top"))
        jumped = lower.join(measured(above, n, KEY_BYTES), F.col("component") == F.col("label"), "left")
        jumped = stored(jumped.select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        rounds.append(labels)
        if jumped.where("component < was").isEmpty():
            break
    if not paths:
        return labels
    told = reduce(DataFrame.union, [r.select("node", F.struct(F.lit(i).alias("round"), "component").alias("r")) for i, r in enumerate(rounds)])
    told = told.groupBy("node").agg(F.sort_array(F.collect_list("r"))["component"].alias("path"))
    return stored(told.select("node", F.element_at("path", -1).alias("component"), "path"), "paths")
