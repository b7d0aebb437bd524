"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of this machine, by application, for sessions on one machine that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Only where a session runs on one machine and names none, as in tests, a temporary
    folder of this machine takes its place.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        root = _own[app]
    return f"{root.rstrip('/')}/cadenza-{uuid.uuid4().hex}"


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
