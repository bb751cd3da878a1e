"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in (x, y) links: the smallest node that can be reached.

    Each round a node takes the smallest label among its neighbours, then the label of its label,
    so long chains shrink by more than half a round. Rounds are tables in the shared folder;
    only the number of changed labels reaches the driver. Neighbours' labels are combined
    before the shuffle, so a node with very many links is no hot spot.
    """
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct()
    both = cut_lineage(both, "links")
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        took = labels.join(near, labels["node"] == near["x"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        took = cut_lineage(took, "labels")
        jump = took.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = took.join(jump, took["label"] == jump["at"]).select("node", "old", F.col("beyond").alias("component"))
        moved = cut_lineage(moved, "labels")
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
