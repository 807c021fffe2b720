"""Packed exchange: batches of documents ask, key partitions answer.

Documents are dealt into batches by a hash of their id.  A batch names its
*distinct* 64-bit keys once each (so a key that a third of all documents hold
reaches its partition once per batch, not once per document), packed into one
binary cell per key partition.  A partition joins the cells, and returns one
answer per key in the batch's own order.  Row overhead in the JVM is thus per
cell, not per key, and every stage is a plain Spark shuffle that survives lost
executors.

A batch has about `UNIT` bytes of text, and a key partition as much, up to a GB of
text; beyond, both grow with the root of the whole up to `LARGEST`, so that the
number of cells grows in proportion to the text, and each cell keeps hundreds of
keys up to some TB (tasks then need memory for `LARGEST`).  Small tables have at
least two batches for each shuffle partition, so that short rows are spread too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C

UNIT = 6 << 20
LARGEST = 96 << 20
LEAST_ROWS = 256
_ROW = "part int, batch int, keys binary, extra binary"
_ANSWER = "batch int, part int, answer binary"


class Layout:
    """How a table of so many bytes and rows is dealt: number of batches, and of key partitions (a power of two)."""

    def __init__(self, n_bytes: int, n_rows: int, n_shuffle: int):
        self.n_bytes = n_bytes
        unit = min(LARGEST, max(UNIT, int(UNIT * (n_bytes / (1 << 30)) ** 0.5)))
        self.batches = max(1, n_bytes // unit, min(n_rows // LEAST_ROWS, 2 * n_shuffle))
        self.parts = 1 << max(2, int(np.ceil(np.log2(max(1, n_bytes / unit)))))

    def batch(self, key: str = "doc_id"):
        """The batch of an id."""
        return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(-1))), F.lit(self.batches)).cast("int")


def layout(docs: DataFrame) -> Layout:
    return Layout(*C.extent(docs), C.n_shuffle(docs.sparkSession))


def batched(docs: DataFrame, to: Layout, key: str = "doc_id") -> DataFrame:
    """docs with a column `batch`, dealt by it.  Uses of the result within one plan share the exchange."""
    dealt = max(C.n_shuffle(docs.sparkSession), to.n_bytes // (64 << 20))
    return docs.withColumn("batch", to.batch(key)).repartition(dealt, "batch")


def _packed(keys: np.ndarray, bits: int, wide: bool) -> bytes:
    if wide:
        return keys.tobytes()
    k = (keys << np.uint64(bits)) >> np.uint64(24)  # the partition tells the first bits
    return (k >> np.uint64(8)).astype(np.uint32).tobytes() + (k & np.uint64(255)).astype(np.uint8).tobytes()


def _unpacked(cell: bytes, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(cell, np.uint64)
    n = len(cell) // 5
    return (np.frombuffer(cell, np.uint32, n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(cell, np.uint8, n, 4 * n)


class Answers:
    """Rows (batch, part, answer) and the dtype of the packed answers."""

    def __init__(self, rows: DataFrame, kind: str):
        self.rows, self.kind = rows, kind


def exchange(batches: DataFrame, parts: int, emit: Callable, reduce: Callable, extra: str, answer: str, *, wide: bool, given: tuple[Answers, ...] = (), note: Callable | None = None) -> Answers:
    """Answers for the keys of each batch.

    emit(table, answers...) -> (sorted distinct uint64 keys, values of dtype `extra`).
    reduce(group index of each key, number of groups, values) -> one answer of dtype `answer` per key.
    wide=False sends 40 bits of a key beyond those that name its partition: for filters whose false hits do no harm.
    given: answers of earlier exchanges, handed to emit.
    note(distinct keys, their answers) -> bytes: kept for each partition in a row with batch -1.
    """
    bits = parts.bit_length() - 1

    def send(table: pa.Table, *got: np.ndarray) -> pa.Table:
        rows: dict[str, list] = {"part": [], "batch": [], "keys": [], "extra": []}
        if table.num_rows:
            keys, values = emit(table, *got)
            part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows["part"].append(int(part[a]))
                rows["batch"].append(table.column("batch")[0].as_py())
                rows["keys"].append(_packed(keys[a:b], bits, wide))
                rows["extra"].append(values[a:b].tobytes() if values is not None else b"")
        return pa.table(rows, pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]))

    def resolve(table: pa.Table) -> pa.Table:
        cells = [_unpacked(x, wide) for x in table.column("keys").to_pylist()]
        values = np.concatenate([np.frombuffer(x, extra) for x in table.column("extra").to_pylist()]) if extra else None
        keys = np.concatenate(cells)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        out = reduce(group, int(new.sum()), values).astype(answer)
        cut = np.cumsum([0, *map(len, cells)])
        packed = [np.packbits(out[a:b]).tobytes() if answer == "bool" else out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cells = [len(x).to_bytes(4, "little") + y for x, y in zip(cells, packed, strict=True)]
        whose, part = table.column("batch").to_pylist(), table.column("part").to_pylist()
        if note:
            cells, whose, part = [*cells, note(ranked[new], out[order][new])], [*whose, -1], [*part, part[0]]
        del order, ranked, group, keys, values, packed
        C.trim()
        return pa.table({"batch": pa.array(whose, pa.int32()), "part": pa.array(part, pa.int32()), "answer": pa.array(cells, pa.binary())})

    sent = consume(batches, given, send, _ROW) if given else batches.groupBy("batch").applyInArrow(lambda t: send(t), _ROW)
    dealt = sent.repartition(min(parts, max(C.n_shuffle(batches.sparkSession), parts // 4)), "part")
    return Answers(dealt.groupBy("part").applyInArrow(resolve, _ANSWER), answer)


def packed(rows: DataFrame, column: str) -> Answers:
    """A column of longs (column, batch), sorted within each batch, as answers."""

    def pack(table: pa.Table) -> pa.Table:
        x = np.sort(table.column(column).to_numpy().astype(np.int64))
        return pa.table({"batch": table.column("batch")[:1], "part": pa.array([0], pa.int32()), "answer": pa.array([len(x).to_bytes(4, "little") + x.tobytes()], pa.binary())})

    return Answers(rows.groupBy("batch").applyInArrow(pack, _ANSWER), "int64")


def _merged(table: pa.Table, kind: str) -> np.ndarray:
    """A batch's answers, in the order of its sorted keys."""
    if not table.num_rows:
        return np.empty(0, kind)
    out = []
    for i in np.argsort(table.column("part").to_numpy(), kind="stable"):
        cell = table.column("answer")[int(i)].as_py()
        n = int.from_bytes(cell[:4], "little")
        out.append(np.unpackbits(np.frombuffer(cell, np.uint8, -1, 4), count=n).astype(bool) if kind == "bool" else np.frombuffer(cell, kind, n, 4))
    return np.concatenate(out)


def consume(batches: DataFrame, given: tuple[Answers, ...], use: Callable, schema) -> DataFrame:
    """use(table, answers...) -> Arrow table, for each batch."""
    kinds, both = [g.kind for g in given], None
    for i, g in enumerate(given):
        rows = g.rows.where("batch >= 0").withColumn("part", F.col("part") * len(given) + i)
        both = rows if both is None else both.union(rows)

    def call(table: pa.Table, got: pa.Table) -> pa.Table:
        part = got.column("part").to_numpy()
        return use(table, *(_merged(got.filter(pa.array(part % len(kinds) == i)), k) for i, k in enumerate(kinds)))

    return batches.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(call, schema)
