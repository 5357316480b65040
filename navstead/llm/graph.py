"""Connected components by smallest label, with pointer jumping, on joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    rounds grow with the logarithm of a component's width.  Labels are written between rounds.
    Both directions come from one reading of ``edges``: rows that depend on an order (stars of a group)
    may differ when they are computed again, and a link known in one direction alone would be lost.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.inline(ways)).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        moved = step.join(jump, "low").select("node", F.least("low", "lower").alias("component"), (F.least("low", "lower") < F.col("component")).alias("moved"))
        after = cut_lineage(moved)
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels
