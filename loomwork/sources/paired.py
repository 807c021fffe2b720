"""Paired shards: an array file and a table of metadata for each shard, written together or not at all.

`paired_shards` is a Python data source in both directions.  Each write task stages
its shards below `_staging`, under names of its own attempt; the driver's commit moves
the files of the tasks that succeeded, and only then writes a manifest, which is the one thing
that readers go by.  A task that dies, or runs twice, leaves staged files that no
manifest names, and commit or abort removes them.  An append is one more manifest; an
overwrite first writes its manifest, then removes what older ones name.

A reader opens only the shards that filters on `shard` leave (told to Spark as
pushed), and cuts each into ranges of `rows` rows, a task each; array rows and metadata
rows of one number are one row.

Files are reached through pyarrow's file systems, so the path may be a URI that
all executors reach.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = 65_536
_PUSHED = "spark.sql.python.filterPushdown.enabled"


def _system(path: str):
    """(file system, path within it)"""
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def _manifests(system, root: str) -> list[dict]:
    """The manifests in force, oldest first: those from the last overwrite on."""
    found = system.get_file_info(fs.FileSelector(posixpath.join(root, "_manifest"), allow_not_found=True))
    read = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.type == fs.FileType.File and f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as s:
                read.append(json.loads(s.read()) | {"file": f.path})
    last = max((i for i, m in enumerate(read) if m["overwrite"]), default=0)
    return read[last:]


def keeps(filter_, shard: int) -> bool | None:
    """Whether a pushed filter on `shard` lets a shard through; None for filters that tell nothing of it."""
    if getattr(filter_, "attribute", None) != ("shard",):
        return None
    if isinstance(filter_, In):
        return shard in filter_.value
    for kind, test in ((EqualTo, shard.__eq__), (EqualNullSafe, shard.__eq__), (GreaterThan, shard.__gt__), (GreaterThanOrEqual, shard.__ge__), (LessThan, shard.__lt__), (LessThanOrEqual, shard.__le__)):
        if type(filter_) is kind:
            return bool(test(filter_.value))
    return None


@dataclass
class Rows(InputPartition):
    """Rows [first, last) of a shard, and its two files."""

    shard: int
    first: int
    last: int
    array: str
    meta: str


class PairedReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.rows, self.fields = options["path"], int(options.get("rows", ROWS)), [f.name for f in schema.fields]
        self.vector = options.get("vector", "vector")
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if keeps(f, 0) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        system, root = _system(self.path)
        out = []
        for m in _manifests(system, root):
            for s in m["shards"]:
                if all(keeps(f, s["shard"]) for f in self.filters):
                    out += [Rows(s["shard"], a, min(a + self.rows, s["rows"]), s["array"], s["meta"]) for a in range(0, s["rows"], self.rows)]
        return out or [None]

    def read(self, part):
        if part is None:
            return
        system, root = _system(self.path)
        n = part.last - part.first
        block = array_rows(system, posixpath.join(root, part.array), part.first, part.last)
        with system.open_input_file(posixpath.join(root, part.meta)) as file:
            meta = _table_rows(pq.ParquetFile(file), part.first, part.last)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * block.shape[1]), pa.array(block.astype(np.float32).ravel()))
        own = {"shard": pa.array(np.full(n, part.shard, np.int32)), "row": pa.array(np.arange(part.first, part.last, dtype=np.int64)), self.vector: vectors}
        for a in range(0, n, 4096):
            cells = [(own[f] if f in own else meta.column(f).combine_chunks()).slice(a, 4096) for f in self.fields]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells], self.fields)


def _header(file):
    """(shape, dtype, offset of the data) of a .npy file."""
    head = io.BytesIO(file.read_at(min(4096, file.size()), 0))
    version = np.lib.format.read_magic(head)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    return shape, kind, head.tell()


def array_shape(system, path: str) -> tuple:
    with system.open_input_file(path) as file:
        return _header(file)[0]


def array_rows(system, path: str, first: int, last: int) -> np.ndarray:
    """Rows [first, last) of a .npy file: its header and that range are read, no more."""
    with system.open_input_file(path) as file:
        shape, kind, at = _header(file)
        size = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        return np.frombuffer(file.read_at(size * (last - first), at + size * first), kind).reshape(last - first, *shape[1:])


def _table_rows(file: pq.ParquetFile, first: int, last: int) -> pa.Table:
    """Rows [first, last) of a Parquet file: the row groups that hold them."""
    at, groups, skip = 0, [], 0
    for g in range(file.num_row_groups):
        n = file.metadata.row_group(g).num_rows
        if at < last and at + n > first:
            skip = skip if groups else first - at
            groups.append(g)
        at += n
    return file.read_row_groups(groups).slice(skip, last - first)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: shard, rows, and its files by their staged names."""

    shards: list[dict]


class PairedWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.vector, self.kind = options.get("vector", "vector"), np.dtype(options.get("dtype", "float32"))
        self.job = uuid.uuid4().hex
        names = [f.name for f in schema.fields]
        if not {"shard", "row", self.vector} <= set(names):
            raise ValueError(f"needs columns shard, row and {self.vector}")
        self.meta = [n for n in names if n not in ("shard", "row", self.vector)]
        self.schema = schema.json()

    def write(self, iterator):
        """Rows sorted by shard and row: each shard becomes two staged files."""
        system, root = _system(self.path)
        at = posixpath.join(root, "_staging", self.job, uuid.uuid4().hex)
        system.create_dir(at, recursive=True)
        done: list[dict] = []
        now, held = None, []
        for batch in iterator:
            shards = batch.column("shard").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b > a:
                    if now is not None and shards[a] != now:
                        done.append(self._staged(system, at, now, held))
                        held = []
                    now = int(shards[a])
                    held.append(batch.slice(a, b - a))
        if held:
            done.append(self._staged(system, at, now, held))
        if len({d["shard"] for d in done}) < len(done):
            raise ValueError("rows of a shard do not follow each other")
        return Staged(done)

    def _staged(self, system, at: str, shard: int, held: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(held)
        rows = table.column("row").to_numpy()
        if (rows != np.arange(len(rows))).any():
            raise ValueError(f"shard {shard}: rows are not 0 .. n - 1 in order")
        cells = table.column(self.vector).combine_chunks()
        cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
        if cells.null_count or len(cells.flatten()) % max(1, len(cells)):
            raise ValueError(f"shard {shard}: vectors are null or not of one length")
        block = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1).astype(self.kind)
        if len(set(np.diff(np.asarray(cells.offsets)).tolist())) > 1:
            raise ValueError(f"shard {shard}: vectors are not of one length")
        array, meta = (posixpath.join(at, f"{kind}_{shard:05d}.{end}") for kind, end in (("embeddings", "npy"), ("meta", "parquet")))
        with system.open_output_stream(array) as out:
            data = io.BytesIO()
            np.lib.format.write_array_header_2_0(data, {"descr": np.lib.format.dtype_to_descr(block.dtype), "fortran_order": False, "shape": block.shape})
            out.write(data.getvalue())
            out.write(np.ascontiguousarray(block).data)
        with system.open_output_stream(meta) as out:
            pq.write_table(table.select(["row", *self.meta]), out, row_group_size=ROWS)
        return {"shard": shard, "rows": len(rows), "array": array, "meta": meta}

    def commit(self, messages):
        system, root = _system(self.path)
        system.create_dir(posixpath.join(root, "_manifest"), recursive=True)
        old = _manifests(system, root)
        shards = [s for m in messages if m is not None for s in m.shards]
        taken = [] if self.overwrite else [s["shard"] for m in old for s in m["shards"]]
        numbers = [s["shard"] for s in shards]
        try:
            if len(set(numbers + taken)) < len(numbers) + len(taken):
                raise ValueError("a shard number is written twice")
            home = posixpath.join(root, self.job)
            system.create_dir(home, recursive=True)
            for s in shards:
                for kind in ("array", "meta"):
                    to = posixpath.join(home, posixpath.basename(s[kind]))
                    system.move(s[kind], to)
                    s[kind] = posixpath.relpath(to, root)
            name = posixpath.join(root, "_manifest", f"{time.time_ns():020d}-{self.job}.json")
            with system.open_output_stream(name + ".tmp") as out:
                out.write(json.dumps({"overwrite": self.overwrite, "schema": self.schema, "shards": sorted(shards, key=lambda s: s["shard"])}).encode())
            system.move(name + ".tmp", name)
        finally:
            self._unstage(system, root)
        if self.overwrite:
            for m in old:
                for s in m["shards"]:
                    for kind in ("array", "meta"):
                        system.delete_file(posixpath.join(root, s[kind]))
                system.delete_file(m["file"])

    def abort(self, messages):
        self._unstage(*_system(self.path))

    def _unstage(self, system, root: str) -> None:
        at = posixpath.join(root, "_staging", self.job)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class PairedShards(DataSource):
    """`paired_shards`: rows (shard int, row long, vector array<float>, metadata ..)."""

    @classmethod
    def name(cls) -> str:
        return "paired_shards"

    def schema(self):
        system, root = _system(self.options["path"])
        found = _manifests(system, root)
        if not found:
            raise ValueError(f"no shards at {self.options['path']}")
        return StructType.fromJson(json.loads(found[-1]["schema"]))

    def reader(self, schema):
        return PairedReader(self.options, schema)

    def writer(self, schema, overwrite):
        return PairedWriter(self.options, schema, overwrite)


def write(rows: DataFrame, path: str, *, vector: str = "vector", dtype: str = "float32", mode: str = "append") -> None:
    """Rows stamped with shard and row (`sinks.stamped`): a task each for the shards, all of them or none.

    Each shard is held by its task while it is written: 4 bytes a component.
    """
    rows.sparkSession.dataSource.register(PairedShards)
    laid = rows.withColumn("shard", F.col("shard").cast("int")).withColumn("row", F.col("row").cast("long")).withColumn(vector, F.col(vector).cast("array<float>"))
    laid = laid.repartition("shard").sortWithinPartitions("shard", "row")
    laid.write.format("paired_shards").option("path", path).option("vector", vector).option("dtype", dtype).mode(mode).save()


def read(spark: SparkSession, path: str, *, vector: str = "vector", rows: int = ROWS) -> DataFrame:
    """The pairs' rows; filters on `shard` open only those shards (the session's push-down to Python sources is switched on)."""
    spark.dataSource.register(PairedShards)
    spark.conf.set(_PUSHED, "true")
    return spark.read.format("paired_shards").option("path", path).option("vector", vector).option("rows", rows).load()
