"""Connected components of an edge table, without gathering a neighbourhood anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the smallest node reachable.

    Each round moves every node to the smallest node next to it and keeps the edges that still connect
    different nodes. Neighbours meet only in a minimum, which partial aggregation folds before the shuffle, so
    a node with very many edges is no burden. Each round's tables are written, and the rounds grow as the
    logarithm of a component's width.
    """
    left = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut_lineage(both.groupBy("a").agg(F.min("b").alias("least"))
                           .select(F.col("a").alias("node"), F.least("a", "least").alias("to")))
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            labels = labels.join(step.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        labels = cut_lineage(labels)
        first = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        moved = first.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = cut_lineage(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct())
    return labels
