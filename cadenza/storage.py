"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Rows that a task gathers where a table is spread.
TASK_ROWS = 500_000


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine names none, as in tests, a folder of that machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cadenza-"))


def written(df: DataFrame) -> DataFrame:
    """df as a table below the shared folder: its plan begins anew there, and a lost executor takes nothing with it.

    What joins it is shuffled: Spark sizes a table by its compressed files, of which names
    that repeat take a small part of what their rows take of a driver that broadcasts them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def spread(rows: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """rows dealt by keys into tasks of about TASK_ROWS rows, where the session's shuffle partitions would hold more.

    They are counted before, if no count is given, so they should be a table.
    """
    n = -(-(rows.count() if count is None else count) // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
