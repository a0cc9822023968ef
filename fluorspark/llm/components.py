"""Connected components of an undirected graph, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of the edges (a, b).

    Rounds of neighbour minimum and pointer jumping, so a chain of n nodes takes about
    log n rounds; every round is cut in the shared folder and only a count reaches the driver.

    Edges may repeat, in either direction; one from a node to itself counts for nothing, so a node that has no other
    is not in the result; edges with a null end are left out; without edges the result is empty.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut(both.union(both.select("dst", "src")).where("src != dst").distinct())  # a null end is not different
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved")))
        root = step.select(F.col("node").alias("_root"), F.col("component").alias("_top"))
        jumped = cut(step.join(root, step["component"] == root["_root"]).select("node", F.least("component", "_top").alias("component"), (F.col("moved") | (F.col("_top") < F.col("component"))).alias("moved")))
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
