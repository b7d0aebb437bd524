"""Graphs as edge tables: connected components and what lies below a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the least node that can be reached.

    Each round a node takes the least label around it, and then its label's own label, so
    that labels travel twice as far each round. Rounds are written; a count of what changed
    is all that the driver sees. Nodes may be of any type that has an order, but not null.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("component").alias("lowest"))
        moved = written(lower.join(of, "low").select("node", "component", F.least("low", "lowest").alias("low")))
        if moved.where("component <> low").isEmpty():
            return labels
        labels = moved.select("node", F.col("low").alias("component"))
