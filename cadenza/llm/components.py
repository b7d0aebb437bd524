"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.store import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v), u > v: hang a node's larger (or, in a small star, smaller) neighbours on its least neighbour."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = edges.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        both = edges.join(least, "u")
        moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            both.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in (a, b); component is the least node reachable.

    Edges stay distributed: only a count and a checksum come to the driver each round.
    Repeated edges, loops and nulls change nothing; no edges give no rows.
    """
    work = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == seen:
            break
        seen = tuple(now)
        work = keep(_star(_star(work, True), False))
    return work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
