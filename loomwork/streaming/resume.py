"""Streams: bounded micro-batches over files, resume by checkpoint or by ids already written, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 16) -> DataFrame:
    """New files of a directory, so many at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(path)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there and stops; a restart goes on after the last committed batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def idempotent_append(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that doubles nothing: a folder for each batch number, overwritten when the batch comes again, without keys that earlier batches have written."""

    def write(df: DataFrame, number: int) -> None:
        rows = df.dropDuplicates([key])
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = [f"{path}/batch={i}" for i in range(number) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={i}/_SUCCESS"))]
        if before:
            rows = pending(rows, spark.read.schema(df.schema).parquet(*before), key)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling window: an extension for event tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def each_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps all rows, and that a repeated batch doesn't double: a folder for each batch number, overwritten."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")
