"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition is its target share of the mixture over its share of the
documents. Each document's number of copies inverts the Poisson distribution of that
mean at a uniform number seeded by a hash of the document, so a rerun or a lost executor
gives the same copies. Copies are dealt by another hash and sorted by it, which shuffles
them globally; a source that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means are cut up in terms of at most this size, whose counts add up, so that exp(-mean) stays far from 0.
TERM = 16.0
#: Quantiles of one term: P(count >= 96 | mean 16) is below 2**-53.
STEPS = 96
#: Sources up to this number are broadcast: some MB.
BROADCAST_SOURCES = 100_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The least k with P(count <= k) > u, for a mean of at most TERM."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

    def step(at: Column, k: Column) -> Column:
        p = at["p"] * mean / k
        return F.struct(p.alias("p"), (at["below"] + p).alias("below"), (at["k"] + F.when(at["below"] <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step, lambda at: at["k"])


def repetition_rates(documents: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, n, rate): the mean number of copies of each source's documents.

    ``weights`` gives sources' target weights; those of sources that are not in the table
    fall to the others, and sources that it does not name get none. Without it a source of
    n documents weighs n**alpha. The rates keep the expected number of documents.
    """
    counts = documents.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        named = documents.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        weighed = counts.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    all_n, all_w, sources = weighed.agg(F.sum("n").cast("double"), F.sum("w"), F.count(F.lit(1))).first()
    rate = F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n") if all_w else F.lit(0.0)
    rates = weighed.select("source", "n", rate.alias("rate"))
    # so few rows spare the documents a shuffle; more meet them in a join, which may split large sources
    return F.broadcast(rates) if sources <= BROADCAST_SOURCES else rates


def mix(documents: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, copy, rate, place): ``row`` a struct of all columns, each copy its own row, in global random order by place.

    Copies of a row count from 1. Null sources form a source of their own. A null id hashes
    as an empty one; rows that repeat an id get as many copies each. A text's length and
    content play no part. An empty table gives no rows; extra columns of any name stay
    inside ``row``.
    """
    rates = repetition_rates(documents, weights, alpha, source_col)
    rows = documents.select(F.struct("*").alias("row"))
    drawn = rows.join(rates, F.col(f"row.{source_col}").eqNullSafe(F.col("source")))
    key = F.col(f"row.{id_col}")
    terms = F.greatest(F.lit(1), F.ceil(F.col("rate") / TERM).cast("int"))
    count = F.aggregate(F.sequence(F.lit(1), terms), F.lit(0), lambda n, i: n + poisson(F.col("rate") / terms, uniform(seed, key, i)))
    # no copies, no rows; the count is worked out once
    copies = drawn.select("row", "rate", F.posexplode(F.array_repeat(F.lit(1), count)).alias("before", "one")).select("row", "rate", (F.col("before") + 1).alias("copy"))
    placed = copies.withColumn("place", uniform(f"{seed}/place", key, F.col("copy")))
    return placed.repartition(F.floor(F.col("place") * (1 << 20))).sortWithinPartitions("place")


#: DuckDB SQL of mix(documents) with the default weights: all columns of documents, copy and rate.
SQL = f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
total AS (SELECT sum(n)::DOUBLE AS all_n, sum(w) AS all_w FROM counts),
rates AS (SELECT source, w / all_w * all_n / n AS rate, greatest(1, ceil(w / all_w * all_n / n / {TERM}))::INT AS terms FROM counts, total),
numbered AS (SELECT *, row_number() OVER () AS r FROM documents),
terms AS (
  SELECT d.r, d.source, r.rate / r.terms AS mean,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || t.i::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM numbered d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, r.terms + 1)) AS t(i)),
quantiles AS (
  SELECT source, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT DISTINCT source, mean FROM terms), unnest(range(0, {STEPS})) AS q(k)),
drawn AS (
  SELECT t.r, count(q.below) AS copies
  FROM terms t LEFT JOIN quantiles q ON q.source IS NOT DISTINCT FROM t.source AND q.below <= t.u GROUP BY t.r)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy, round(r.rate, 6) AS rate
FROM numbered d JOIN drawn USING (r) JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, drawn.copies + 1)) AS c(copy)
"""
