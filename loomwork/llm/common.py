"""Helpers shared by the corpus operators: shared folder, word hashing, sizes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All hashing is
done per Arrow batch in numpy, straight on the UTF-8 buffers.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILAR = 0.8
NULL_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _TRIM = None
_U = np.uint64
_LONG = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOW = _powers(0x9E3779B97F4A7C15, _LONG)
_HIGH = _powers(0xD1342543DE82EF95, _LONG)
ROLL = 0xBF58476D1CE4E5B9
_RUN = 1 << 21
_RUNS: list[np.ndarray] = []


def _run_powers() -> list[np.ndarray]:
    """Powers of the low base, and of its inverse: a word's sum may be taken at its place in the text and moved to 0."""
    if not _RUNS:
        for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
            x = np.full(_RUN, base, np.uint64)
            x[0] = 1
            _RUNS.append(np.multiply.accumulate(x))
    return _RUNS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


# ---------------------------------------------------------------- session


def importable(spark: SparkSession) -> None:
    """Python workers find this package: where the driver found it, or, on other machines, in an archive that Spark sends."""
    sc = spark.sparkContext
    if getattr(sc, "_loomwork_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.environment.setdefault("PYTHONPATH", os.path.dirname(package))
    made = os.path.join(tempfile.mkdtemp(), "loomwork.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(package)))
    sc.addPyFile(made)
    sc._loomwork_sent = True


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: later plans start from files.

    The shuffle files of the write go when it ends (no later plan reads them), the
    table itself by `forget`, or when the session ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(at)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._loomwork_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Removes stored tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loomwork_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that df has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add."""
    return df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in names}))


def quoted(name: str) -> str:
    """A column's name where an expression is expected, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def plain(df: DataFrame, *own: str) -> DataFrame:
    """df with plain names: columns of `own` keep theirs, others are c0, c1, .. by place; `named` gives the names back."""
    return df.toDF(*(c if c in own else f"c{i}" for i, c in enumerate(df.columns)))


def named(df: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    """The columns of a `plain` frame, under like's names, and then `more` of its own."""
    return df.select(*df.columns[: len(like.columns)], *more).toDF(*like.columns, *more)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def extent(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """Bytes of text, and rows."""
    r = docs.agg(F.sum(F.octet_length(col)), F.count("*")).first()
    return r[0] or 0, r[1]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_key(col: str = "doc_id"):
    """Documents without an id come after all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


# ---------------------------------------------------------------- words


def one(col) -> pa.Array:
    """The column as one array."""
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    a = one(col)
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = pc.fill_null(a, "")
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse; by a hash table, so that only distinct values are sorted."""
    code, values = pd.factorize(x)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[code]


class Words:
    """Words of a run of documents: byte spans, 64-bit hashes, and the index of each document's first word."""

    __slots__ = ("data", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray, hashes: bool = True, space: np.ndarray = _SPACE):
        self.data = data
        word = ~space[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        cut = off[:-1][off[:-1] < len(data)]
        begin[cut] = word[cut]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        cut = off[1:][off[1:] > 0] - 1
        cut = cut[cut < len(data)]
        stop[cut] = word[cut]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = np.empty(0, np.uint64)
        if hashes and len(self.start):
            size = self.end - self.start
            if len(data) <= _RUN and size.max() <= _LONG:
                low, back = _run_powers()
                x = np.where(space, _U(0), _BYTE)[data]
                x *= low[: len(data)]
                self.hash = mix(np.add.reduceat(x, self.start) * back[self.start] + size.astype(np.uint64))
                return
            lead = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(lead, size)
            x = _BYTE[data[word]] * _LOW[at & (_LONG - 1)]
            if size.max() > _LONG:
                x *= _HIGH[(at >> 12) & (_LONG - 1)]
            self.hash = mix(np.add.reduceat(x, lead) + size.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)


def trim() -> None:
    """Freed memory goes back to the system: Python workers live on, and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(col, limit: int = 1 << 20):
    """(first row, last row, bytes, offsets) of runs of rows with about limit bytes: temporaries stay in cache."""
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial of each k consecutive values; unmixed, so that windows can be joined: w[i] * ROLL**k + w[i + k]."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, done, power, size, block = None, 0, ROLL, 1, h
    while True:
        if k & size:
            at = block[done:]
            if out is None:
                out, done = at, size
            else:
                n = min(len(out), len(at))
                out, done = out[:n] * _U(power) + at[:n], done + size
        if done == k:
            return out[: len(h) - k + 1]
        n = len(block) - size
        block = block[:n] * _U(power) + block[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document: k-word runs; of fewer words, the whole sequence as one."""
    roll = mix(rolling(words.hash, k) + _U(k))
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = b - a
        if n >= k:
            s = np.sort(roll[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(mix(rolling(words.hash[a:b], int(n)) + _U(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df and one more column."""
    return StructType([*df.schema.fields]).add(name, kind)
