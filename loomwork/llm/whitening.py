"""Embedding whitening by a tall-skinny QR (TSQR).

Components become integers, x = floor(SCALE * c) + SHIFT, so sums are exact.  The fit
list is each distinct x vector once.  Its rows are centred by the exact sums, (n * x -
S) / n in integers before the one division; each partition keeps the R factor of what
it has read, block by block; R factors are merged `FAN` at a time by further QRs, a
shuffle a level; the last R (components x components) is decomposed on the driver.
Its right vectors are the eigenvectors of the covariance, its squared singular values
n times the eigenvalues: the covariance is never formed.

Copies are merged by partial aggregation before their shuffle, so a vector that a
third of all rows hold is no hot spot.  Only sums (a row a dimension) and the last R
reach the driver.

Edge cases: rows whose vector is null or holds null, NaN or infinite components, or
no component, are dropped; of vectors of differing length those of the most frequent
length stay (of equally frequent, the longest); repeated rows, ties and rows with a
null id stay in the result, each with its own values; a component without variance
(an eigenvalue of at most `FLAT` times the largest) can't be whitened and is left out,
so equal vectors, or a single one, give no rows; x beyond 2**62 is held there; a
deviation beyond a long is null; an empty table gives no rows; columns of any name
pass through `whitened`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from loomwork.llm import common as C

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
FAN = 8
FLAT = 1e-20
ROWS = 4096
_HALF = 1 << 31


def _integers(col: str):
    """x - SHIFT of each component, as longs."""
    edge = float(1 << 62)
    return F.transform(F.col(col).cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c * F.lit(float(SCALE))))).cast("long"))


def _fine(col: str):
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(F.col(col).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def usable(vectors: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(rows with a usable vector, and its integers in `_y`; number of components)."""
    rows = vectors.where(_fine(col)).withColumn("_y", _integers(col))
    size = rows.groupBy(F.size("_y").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    dims = size[0] if size else 0
    return rows.where(F.size("_y") == dims), dims


def _matrix(column, dims: int) -> np.ndarray:
    return C.one(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: n, sums of x - SHIFT, eigenvalues (falling), components (dims x k), trace, and identity_error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int

    def off(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
        """n * x - S, exact, as doubles divided by n, and the sum of its squares in each row (None beyond a long)."""
        if 2 * self.n * max(1, self.largest) < 1 << 62:
            d = y * np.int64(self.n) - np.array(self.sums, np.int64)
            if y.shape[1] * (2 * self.n * max(1, self.largest)) ** 2 < 1 << 63:
                return d / self.n, (d * d).sum(1)
        else:
            d = None
        exact = y.astype(object) * self.n - np.array(self.sums, object) if d is None else d.astype(object)
        squares = [int(x) for x in (exact * exact).sum(1)]
        centred = (exact / self.n).astype(np.float64) if d is None else d / self.n
        return centred, [x if x < 1 << 63 else None for x in squares]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, "r")


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Rows, exact sums, and the largest absolute value."""

    def partial(batches):
        n, high, low, most = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for batch in batches:
            y = _matrix(batch.column(0), dims)
            if len(y):
                n, high, low = n + len(y), high + (y >> 31).sum(0), low + (y & (_HALF - 1)).sum(0)
                most = max(most, int(np.abs(y).max()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low), pa.array(np.full(dims, most))], ["dim", "n", "high", "low", "most"])

    parts = fit.select("_y").mapInArrow(partial, "dim int, n long, high long, low long, most long")
    got = parts.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.max("most").alias("most")).orderBy("dim").collect()
    return (got[0].n, [int(r.high) * _HALF + int(r.low) for r in got], got[0].most) if got else (0, [], 0)


def _factor(fit: DataFrame, model: Whitening, dims: int) -> np.ndarray:
    """R of the centred fit list: a QR a partition, then a tree of merges."""

    def local(batches):
        r = np.empty((0, dims))
        for batch in batches:
            y = _matrix(batch.column(0), dims)
            for a in range(0, len(y), ROWS):
                r = _r(np.concatenate((r, model.off(y[a : a + ROWS])[0])))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["id", "r"])

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        cells = table.column("r").to_pylist()
        r = np.empty((0, dims))
        for i in order:
            r = _r(np.concatenate((r, np.frombuffer(cells[i]).reshape(-1, dims))))
        return pa.table({"id": pa.array([int(table.column("id")[int(order[0])].as_py()) // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = C.stored(fit.select("_y").mapInArrow(local, "id long, r binary"), "factors")
    many = (factors.agg(F.max("id")).first()[0] or 0) + 1
    while many > 1:
        factors = factors.groupBy(F.floor(F.col("id") / FAN).alias("to")).applyInArrow(merge, "id long, r binary")
        many = -(-many // FAN)
    return np.frombuffer(factors.first().r).reshape(-1, dims)


def _moments(parts):
    """(n, mean, centred second moment) of parts, merged pairwise."""
    n, mean, second = 0, None, None
    for m, a, s in parts:
        if not n:
            n, mean, second = m, a, s
        else:
            gap = a - mean
            second = second + s + np.outer(gap, gap) * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
    return n, mean, second


def _identity_error(fit: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying; partial moments are merged as the R factors are."""
    k = len(model.values)

    def row(at: int, m) -> dict:
        return {"id": pa.array([at], pa.int64()), "n": pa.array([m[0]], pa.int64()), "m": pa.array([np.concatenate((m[1], m[2].ravel())).tobytes()], pa.binary())}

    def cut(n, cell):
        x = np.frombuffer(cell)
        return n, x[:k], x[k:].reshape(k, k)

    def local(batches):
        def blocks():
            for batch in batches:
                y = _matrix(batch.column(0), dims)
                for a in range(0, len(y), ROWS):
                    w = model.project(model.off(y[a : a + ROWS])[0])
                    mean = w.mean(0)
                    yield len(w), mean, (w - mean).T @ (w - mean)

        m = _moments(blocks())
        if m[0]:
            yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId(), m))

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        parts = [cut(table.column("n")[int(i)].as_py(), table.column("m")[int(i)].as_py()) for i in order]
        return pa.table(row(int(table.column("id")[int(order[0])].as_py()) // FAN, _moments(parts)))

    rows = C.stored(fit.select("_y").mapInArrow(local, "id long, n long, m binary"), "moments")
    many = (rows.agg(F.max("id")).first()[0] or 0) + 1
    while many > 1:
        rows = rows.groupBy(F.floor(F.col("id") / FAN).alias("to")).applyInArrow(merge, "id long, n long, m binary")
        many = -(-many // FAN)
    got = rows.first()
    n, _, second = cut(got.n, got.m)
    return float(np.abs(second / n - np.eye(k)).max())


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, stored: dealt evenly, whatever the number of copies."""
    return C.stored(rows.select("_y").distinct(), "fit")


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None if nothing varies."""
    n, sums, most = _sums(fit, dims)
    if not n:
        return None
    model = Whitening(n, sums, np.empty(0), np.empty((dims, 0)), 0.0, max(most, 1))
    _, s, vt = np.linalg.svd(_factor(fit, model, dims), full_matrices=False)
    values = s**2 / n
    live = int((values > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = min(components, live)
    return Whitening(n, sums, values[:k], vt[:k].T.copy(), float(values.sum()), max(most, 1)) if k else None


def digest(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = usable(vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(col).alias(col)), col)
    rows = C.stored(rows.select(id_col, "_y"), "rows")
    fit = fit_list(rows)
    model = fitted(fit, dims, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, model, dims)
    k = len(model.values)
    share = model.values / model.trace

    def out(batches):
        for batch in batches:
            y = _matrix(batch.column(1), dims)
            for a in range(0, len(y), ROWS):
                centred, deviation = model.off(y[a : a + ROWS])
                w = model.project(centred)
                m = len(w)
                many = pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                ids = C.one(batch.column(0)).slice(a, m).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), many, pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(out, schema)


def whitened(vectors: DataFrame, col: str = "embedding", into: str = "whitened", components: int = COMPONENTS) -> DataFrame:
    """vectors with a column of whitened components (array<double>; null for rows that can't be used).

    The whitening is fitted on the distinct usable vectors of the same table.
    """
    names = vectors.columns
    plain = vectors.select(*(F.col(C.quoted(c)).alias(f"_{i}") for i, c in enumerate(names)))
    at = f"_{names.index(col)}"
    rows, dims = usable(plain.select(at), at)
    model = fitted(fit_list(rows), dims, components)
    plain = plain.withColumn("_y", F.when(_fine(at) & (F.size(at) == dims), _integers(at)))
    schema = StructType([*plain.drop("_y").schema.fields]).add("w", ArrayType(DoubleType()))

    def out(batches):
        for batch in batches:
            y = C.one(batch.column(batch.num_columns - 1))
            have = np.flatnonzero(~np.asarray(y.is_null()))
            cells: list = [None] * len(y)
            if model is not None and len(have):
                for i, w in zip(have, model.project(model.off(_matrix(y.take(pa.array(have)), dims))[0]), strict=True):
                    cells[i] = w
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cells, pa.list_(pa.float64()))], schema.names)

    kept = [(i, c) for i, c in enumerate(names) if c.lower() != into.lower()]
    return plain.mapInArrow(out, schema).select(*(F.col(f"_{i}").alias(c) for i, c in kept), F.col("w").alias(into))
