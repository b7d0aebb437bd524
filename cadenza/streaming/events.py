"""Streams of events: running severity counts, and takes as their evidence comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n): counts in tumbling windows; state of windows older than ``late`` is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_evidence(events: DataFrame, take: str, group: str, time: str) -> DataFrame:
    """(take_id, grp, ts): the earliest time of each take in each group, kept up to date; take_order reads its table."""
    return events.groupBy(F.col(take).alias("take_id"), F.col(group).alias("grp")).agg(F.min(time).alias("ts"))
