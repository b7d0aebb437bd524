"""Coverage and drift by set algebra over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.storage import written


def missing_cells(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col) pairs of the grid of all rows and all columns that are not in cells.

    Only counts are compared where a row has every column, so the grid is spread out just
    for rows that lack some.
    """
    have = cells.select(row, col).distinct()
    cols = have.select(col).distinct()
    n = cols.count()
    partial = have.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n).select(row)
    return partial.crossJoin(cols).join(have, [row, col], "left_anti")  # as many rows as the grid lacks, and those that partial rows have


def common_columns(cells: DataFrame, row: str, col: str) -> DataFrame:
    """Columns that every row has (relational division)."""
    have = cells.select(row, col).distinct()
    n = have.select(row).distinct().count()
    return have.groupBy(col).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") == n).select(col)


def coverage(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, present, missing): counts for each row of the grid."""
    have = cells.select(row, col).distinct()
    n = have.select(col).distinct().count()
    return have.groupBy(row).agg(F.count(F.lit(1)).alias("present")).withColumn("missing", F.lit(n) - F.col("present"))


def drift(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """(*keys, side): 'missing' where only expected, 'extra' where only observed; each key once, and null is one too.

    Both are grouped together, so a key is shipped once and nothing is sorted.
    """
    rows = expected.select(*keys, F.lit(True).alias("_asked")).unionByName(observed.select(*keys, F.lit(False).alias("_asked")))
    told = rows.groupBy(*keys).agg(F.bool_or("_asked").alias("_a"), F.bool_and("_asked").alias("_only"))
    return told.where("_only OR NOT _a").select(*keys, F.when(F.col("_a"), "missing").otherwise("extra").alias("side"))


def pending(requested: DataFrame, existing: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(to import, skipped) of the requested rows."""
    return requested.join(existing, list(keys), "left_anti"), requested.join(existing, list(keys), "left_semi")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_best(rows: DataFrame, keys: tuple[str, ...], score: str, ties: tuple[str | Column, ...] = ()) -> DataFrame:
    """The row of the greatest score for each key, the first by ``ties`` among equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return rows.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def setting_mismatches(expected: DataFrame, observed: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, expected, observed) where they differ; a setting that was not observed differs."""
    e, o = expected.select(key, F.col(value).alias("expected")), observed.select(key, F.col(value).alias("observed"))
    return e.join(o, key, "left").where(~F.col("expected").eqNullSafe(F.col("observed")))


def unpivot(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(*keys, field, value as text)."""
    return rows.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(keys, fields, "field", "value")


def upsert(current: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, changed): new values replace current ones."""
    c, n = current.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    out = c.join(n, key, "full_outer")
    return out.select(key, F.coalesce("_new", "_old").alias(value), (F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("changed"))


def replace_records(current: DataFrame, new: DataFrame, keys: list[str], kind: str | None = None, only: str = "DISK") -> DataFrame:
    """new rows, and those of current that agree with none of them in any of keys; with kind, a column, records of other kinds than ``only`` always stay."""
    rest = current if kind is None else current.where(F.col(kind) == only)
    for key in keys:  # one equi-join for each key; an OR of keys would compare all pairs
        rest = rest.join(new.select(key).distinct(), key, "left_anti")
    others = [] if kind is None else [current.where(~F.col(kind).eqNullSafe(only))]
    return reduce(DataFrame.unionByName, [rest, *others, new])


def stale_names(rows: DataFrame, name: str, order: str, used: DataFrame | None = None) -> DataFrame:
    """``target``: name-stale for the first row of a name, then name-stale-2, and so on, without names in use (target)."""
    i = F.row_number().over(Window.partitionBy(name).orderBy(order))
    target = lambda k: F.concat(F.col(name), F.lit("-stale"), F.when(k > 1, F.concat(F.lit("-"), k)).otherwise(""))
    if used is None:
        return rows.withColumn("target", target(i))
    base = used.select("target", F.regexp_extract("target", r"^(.*)-stale(?:-[0-9]+)?$", 1).alias(name)).distinct()
    taken = base.groupBy(name).agg(F.count(F.lit(1)).alias("_taken"))
    need = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_rows")).join(taken, name, "left")
    # as many candidates as there are rows and names in use
    free = need.select(name, F.explode(F.sequence(F.lit(1), (F.col("_rows") + F.coalesce("_taken", F.lit(0))).cast("int"))).alias("_k")).withColumn("target", target(F.col("_k")))
    free = free.join(used.select("target").distinct(), "target", "left_anti").withColumn("_i", F.row_number().over(Window.partitionBy(name).orderBy("_k"))).select(name, "_i", "target")
    return rows.withColumn("_i", i).join(free, [name, "_i"]).drop("_i")


def first_seen(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(value, pos): distinct values by where they come first."""
    return rows.groupBy(value).agg(F.min(position).alias("pos"))


def descendants(nodes: DataFrame, root: int | str, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key, depth) of a tree's nodes below root.

    Ways upward double in length each round, so a tree of n levels takes log2 n joins, each
    of written tables. Of several ways to a node the shortest counts; nodes whose ways go
    round in a circle are not below the root, and the root is none of its descendants.
    """
    edges = nodes.where(F.col(parent).isNotNull() & ~F.col(key).eqNullSafe(F.lit(root))).select(F.col(key).alias("node"), F.col(parent).alias("up"), F.lit(1).alias("depth")).distinct()
    ways = written(edges)
    n, reach = ways.select("node").distinct().count(), 1
    at_root = F.col("up") == F.lit(root)
    while reach < n and not ways.where(~at_root).isEmpty():  # a shortest way visits no node twice
        on = ways.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        longer = ways.where(~at_root).join(on, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = written(ways.where(at_root).unionByName(longer).distinct())
        reach *= 2
    return ways.where(at_root).groupBy(F.col("node").alias(key)).agg(F.min("depth").alias("depth"))
