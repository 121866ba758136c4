"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Each round takes the smallest label among neighbours, then the label of that label, until nothing changes. Labels are a
    written table after each round, so lineage stays short and nothing but one count comes to the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        labels = written(labels, "labels")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = lower.join(jump, F.col("component") == F.col("via")).select("node", "was", F.least("component", "beyond").alias("component"))
        moved = written(moved, "moved")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
