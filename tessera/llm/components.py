"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every linked node.

    Every round gives each node the smallest label around it and then the
    label of its label, so a path of n links needs about log n rounds.  All
    tables stay distributed; a round's table is written to the shared folder."""
    edges = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
                   .union(links.select(F.col(b), F.col(a)).where(F.col(a) != F.col(b))).distinct())
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select(
        "node", F.least("node", "m").alias("component"))
    while True:
        labels = stored(labels)
        around = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("component").alias("m"))
        lower = labels.join(around, labels.node == around.x, "left").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = stored(lower.join(jump, "near", "left").select("node", "old", F.least("near", "far").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels
