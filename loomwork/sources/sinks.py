"""Writers: sharded tables, CSV results, JSON documents, logs, metric logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType


def sharded(rows: DataFrame, path: str, shard_rows: int = 200_000, mode: str = "errorifexists") -> None:
    """Parquet files of at most shard_rows rows."""
    rows.write.option("maxRecordsPerFile", shard_rows).mode(mode).parquet(path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key, for joins without a shuffle."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def result_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: for results of bounded size."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def json_documents(rows: DataFrame, path: str, column: str = "doc") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def named_files(rows: DataFrame, path: str, name: str = "file", column: str = "doc") -> None:
    """A file for each row, by its own name, written by the executors; a task that runs again writes the same files again.

    Rows are dealt to all cores, a folder's own together, as the time goes into files, not bytes: a small table of one partition can name a million.
    """
    from loomwork.sources.paired import _system

    def run(batches):
        system, root = _system(path)
        system.create_dir(root, recursive=True)
        last = ""
        for b in batches:
            for file, doc in zip(b.column(name).to_pylist(), b.column(column).to_pylist(), strict=True):
                if (folder := file.rpartition("/")[0]) != last:
                    system.create_dir(f"{root}/{folder}", recursive="/" in folder)
                    last = folder
                with system.open_output_stream(f"{root}/{file}") as out:
                    out.write((doc or "").encode())
        yield from ()

    rows = rows.select(name, column).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, F.regexp_replace(name, "/[^/]*$", ""))
    rows.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()


def log(rows: DataFrame, path: str) -> None:
    """Appends (report_id, reason, detail)."""
    rows.select("report_id", "reason", "detail").write.mode("append").json(path)


def metric_log(rows: DataFrame, path: str) -> None:
    """Appends (step, epoch, split, metric, value, walltime), partitioned by split."""
    rows.select("step", "epoch", "metric", "value", "walltime", "split").write.mode("append").partitionBy("split").parquet(path)


def encoded_pixels(x):
    """[0, 1] as 16-bit integers, halves up."""
    return F.least(F.greatest(F.floor(x * 65535 + 0.5), F.lit(0)), F.lit(65535)).cast("int")


def stamped(rows: DataFrame, order: list, shard_rows: int = 200_000, start: int = 0) -> DataFrame:
    """rows with shard and row, in order: whole shards from number `start`, ranks by buckets of a range sort."""
    from loomwork.operators.splits import positions

    at = positions(rows, order, "_at")
    return at.withColumn("shard", (F.floor(F.col("_at") / shard_rows) + start).cast("int")).withColumn("row", F.pmod("_at", F.lit(shard_rows)).cast("long")).drop("_at")


def shards(rows: DataFrame, path: str, order: list, *, shard_rows: int = 200_000, start: int = 0, half: str | None = None, mode: str = "append") -> None:
    """Parquet, a folder for each shard, rows stamped with shard and row; `half`: a vector column kept as 16-bit floats (bytes)."""
    out = stamped(rows, order, shard_rows, start)
    if half is not None:
        out = halves(out, half)
    out.write.mode(mode).partitionBy("shard").parquet(path)


def halves(rows: DataFrame, column: str) -> DataFrame:
    """A vector column as the bytes of 16-bit floats."""
    return _converted(rows, column, to_bytes=True)


def floats(rows: DataFrame, column: str) -> DataFrame:
    """The vectors of such bytes."""
    return _converted(rows, column, to_bytes=False)


def _converted(rows: DataFrame, column: str, to_bytes: bool) -> DataFrame:
    to = BinaryType() if to_bytes else ArrayType(FloatType())
    schema = StructType([StructField(f.name, to if f.name == column else f.dataType) for f in rows.schema.fields])

    def made(cells: list) -> pa.Array:
        if to_bytes:
            return pa.array([None if c is None else np.asarray(c, "<f2").tobytes() for c in cells], pa.binary())
        return pa.array([None if c is None else np.frombuffer(c, "<f2").astype(np.float32) for c in cells], pa.list_(pa.float32()))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([made(b.column(n).to_pylist()) if n == column else b.column(n) for n in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, schema)


def document_files(rows: DataFrame, path: str, key: str = "report_id", column: str = "doc") -> None:
    """One JSON document for each id, in a folder of its own: `<key>=<id>/part-*.txt`; rewritten ids are replaced."""
    rows.select(F.col(key), F.col(column).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def concept_log(rows: DataFrame, path: str) -> None:
    """Appends (step, epoch, split, concept, metric, value, walltime), partitioned by split."""
    rows.select("step", "epoch", "concept", "metric", "value", "walltime", "split").write.mode("append").partitionBy("split").parquet(path)


def built(spark, path: str, make) -> DataFrame:
    """The table at path; made by make() and written first where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)
