"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session in one process may do without, a cluster without it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = os.path.join(tempfile.gettempdir(), "loomwork-shared")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def place(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; gone when the session ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what several passes read is computed once, and outlives an executor."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a side that may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are few; else it is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
