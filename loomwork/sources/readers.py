"""Readers: reports, JSON directories, keyed sentence files, indexes, shards of arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from loomwork.functions import text as T
from loomwork.session import stored
from loomwork.sources import paired, pictures


def text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with quoted multi-line cells: all STRING, words for missing cells as null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return raw.select(*(T.or_null(F.col(c)).alias(c) for c in columns))


def reports(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(report_id, examination, report_text, ord): ids trimmed, null ids out, the first row of each id."""
    rows = text_table(spark, path, columns or ["report_id", "examination", "report_text"]).withColumn("report_id", F.trim("report_id"))
    rows = rows.where(F.coalesce("report_id", F.lit("")) != "").withColumn("ord", F.monotonically_increasing_id())
    return rows.withColumn("turn", F.row_number().over(W.partitionBy("report_id").orderBy("ord"))).where("turn = 1").drop("turn")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet index, by its ending."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True)
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"neither csv nor parquet: {path}")


def first_of(rows: DataFrame, names: list[str], default=None):
    """The first of the named columns that the table has."""
    for n in names:
        if n in rows.columns:
            return F.col(n)
    if default is None:
        raise ValueError(f"none of {names} in {rows.columns}")
    return F.lit(default)


def json_documents(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(report_id, doc, has_json): one scan of a directory of `<id>_structured.json` files.

    With ids (report_id): one row for each, exact name before any other file that
    starts with the id; without a file, or malformed: doc null, has_json false.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("doc"))
    files = files.withColumn("report_id", F.coalesce(F.nullif(T.report_id(F.col("file")), F.lit("")), F.regexp_extract("file", r"^(.*?)(_[^_]*)?\.json$", 1)))
    files = files.withColumn("exact", F.endswith("file", F.lit("_structured.json")))
    best = files.withColumn("turn", F.row_number().over(W.partitionBy("report_id").orderBy(F.desc("exact"), "file"))).where("turn = 1")
    best = best.select("report_id", F.when(F.try_parse_json("doc").isNotNull(), F.col("doc")).alias("doc"))
    if ids is not None:
        best = ids.select("report_id").join(best, "report_id", "left")
    return best.withColumn("has_json", F.col("doc").isNotNull())


def sentences(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """(name, idx, sentence) of a JSON file {name: [sentence, ..]}, maybe below a wrapper key; empty ones out."""
    raw = spark.read.text(path, wholetext=True).select((F.get_json_object("value", f"$.{wrapper}") if wrapper else F.col("value")).alias("value"))
    each = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "pool"))
    kept = F.filter(F.transform("pool", lambda s: T.clean(s)), lambda s: s != "")
    return each.select("name", F.posexplode(kept).alias("idx", "sentence"))


def pools(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """(name, pool)"""
    rows = sentences(spark, path, wrapper)
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda s: s["sentence"]).alias("pool"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, positive, idx, text) of {"concept_prompts": {name: {"positive": [..], "negative": [..]}}}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.concept_prompts"), "map<string,map<string,array<string>>>")).alias("name", "sides"))
    return raw.select("name", F.explode("sides").alias("side", "texts")).select("name", (F.col("side") == "positive").alias("positive"), F.posexplode("texts").alias("idx", "text"))


def concepts(spark: SparkSession, path: str | None = None, inline: str = "") -> DataFrame:
    """(idx, name): inline names first, then the file's lines without blanks and comments; first occurrences."""
    names = [n.strip() for n in inline.split(",") if n.strip()]
    if path:
        names += [r["value"].strip() for r in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").collect()]
    return spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "idx int, name string")


def split_map(rows: DataFrame, id_column: str = "report_id", split_column: str = "split") -> DataFrame:
    """(report_id, split): trimmed, the first row of each id by row order."""
    key = F.trim(first_of(rows, [id_column, "report_id", "accession", "group_id"]))
    out = rows.withColumn("ord", F.monotonically_increasing_id()).select(key.alias("report_id"), F.trim(split_column).alias("split"), "ord")
    return out.groupBy("report_id").agg(F.min_by("split", "ord").alias("split"))


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(concept, thr_f1, thr_j) of {concept: {"thr_f1": .., "thr_j": ..}}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<thr_f1:double,thr_j:double>>")).alias("concept", "t"))
    return raw.select("concept", "t.thr_f1", "t.thr_j")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, class, height, width, counts) of {image: {class: {"size": [h, w], "counts": ..}}}."""
    kind = "map<string,map<string,struct<size:array<int>,counts:string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("image_id", "classes"))
    return raw.select("image_id", F.explode("classes").alias("class", "m")).select("image_id", "class", F.col("m.size")[0].alias("height"), F.col("m.size")[1].alias("width"), F.col("m.counts").alias("counts"))


def cases(spark: SparkSession, root: str, first: str, second: str, most: int | None = None) -> DataFrame:
    """(case, first, second): directories with both files, in order of path.

    Tasks list the directories, a level of the tree at a time, so that neither the driver nor a
    job holds a file for each case.  Patterns, and paths that only Spark knows, are listed by Spark.
    """
    try:
        system, top = paired._system(root)
    except (pa.ArrowException, OSError):
        system = None
    if system is None or re.search(r"[*?\[\]{}\\]", first + second):
        listing = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("case"), "path")
        both = listing(first).withColumnRenamed("path", "first").join(listing(second).withColumnRenamed("path", "second"), "case")
        return both.orderBy("case").limit(most) if most is not None else both
    top = top.rstrip("/")
    scheme = root.rstrip("/").removesuffix(top) if "://" in root else "file:"

    def listed(batches):
        system, _ = paired._system(root)
        rows = lambda names, kind: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kind] * len(names), pa.bool_())], ["path", "both"])
        for b in batches:
            held = []
            for folder in b.column("path").to_pylist():
                files, folders = set(), []
                for f in system.get_file_info(fs.FileSelector(folder)):
                    if f.type == fs.FileType.File:
                        files.add(f.base_name)
                    elif f.type == fs.FileType.Directory and not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name):
                        folders.append(f.path)
                for a in range(0, len(folders), 10_000):
                    yield rows(folders[a : a + 10_000], False)
                if first in files and second in files:
                    held.append(scheme + folder)
            yield rows(held, True)

    level, n, both = spark.createDataFrame([(top,)], "path string"), 1, None
    while n:
        parts = max(1, min(n // 64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        found = stored(level.repartition(parts).mapInArrow(listed, "path string, both boolean"), "listing")
        here = found.where("both").select(F.col("path").alias("case"), F.concat("path", F.lit(f"/{first}")).alias("first"), F.concat("path", F.lit(f"/{second}")).alias("second"))
        both = here if both is None else both.union(here)
        level = found.where("not both").select("path")
        n = level.count()
    return both.orderBy("case").limit(most) if most is not None else both


class ShardSource(DataSource):
    """`npy_shards`: rows (shard, row, vector) of `<kind>_NNNNN.npy` files in a directory.

    A partition is a range of `rows` rows of a file; filters on `shard` leave the other
    files unopened.  Files are reached through pyarrow's file systems, and only a
    partition's own rows are read.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return "shard int, row long, vector array<float>"

    def reader(self, schema):
        return ShardReader(self.options)


@dataclass
class ShardRows(InputPartition):
    shard: int
    file: str
    first: int
    last: int


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.rows = options["path"], options.get("kind", "embeddings"), int(options.get("rows", paired.ROWS))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if paired.keeps(f, 0) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        system, root = paired._system(self.path)
        out = []
        for f in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name):
            found = re.fullmatch(rf"{re.escape(self.kind)}_(\d+)\.npy", f.base_name)
            if found and all(paired.keeps(x, int(found[1])) for x in self.filters):
                n = paired.array_shape(system, f.path)[0]
                out += [ShardRows(int(found[1]), f.path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out or [None]

    def read(self, partition):
        if partition is None:
            return
        system, _ = paired._system(self.path)
        for a in range(partition.first, partition.last, 4096):
            block = paired.array_rows(system, partition.file, a, min(a + 4096, partition.last)).astype(np.float32)
            n = len(block)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * block.shape[1]), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.shard, np.int32)), pa.array(np.arange(a, a + n)), vectors], ["shard", "row", "vector"])


def shards(spark: SparkSession, path: str, kind: str = "embeddings", rows: int = paired.ROWS) -> DataFrame:
    spark.dataSource.register(ShardSource)
    spark.conf.set(paired._PUSHED, "true")
    return spark.read.format("npy_shards").option("path", path).option("kind", kind).option("rows", rows).load()


def decode_arrays(rows: DataFrame, content: str = "content") -> DataFrame:
    """binaryFile rows with `pixels`, height and width: see `pictures.decoded`."""
    return pictures.decoded(rows, content).drop("error")
