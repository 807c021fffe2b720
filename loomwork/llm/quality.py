"""Quality by ordinal cumulative-link regression on graded ratings.

For grades 0 < 1 < ... < K - 1 the model is

    P(grade >= k | x) = logistic(w . x - t_k),   t_1 < t_2 < ... < t_{K-1}

with one weight vector for all grades.  x has hashed text features: per word its
form (upper, lower, digit, mark and non-ASCII counts, length, last mark), the
forms of two neighbouring words, the word itself and whether it is the one
before, each as a share of all words; and of the text the share of different
words, their mean length and the log of their number.  The result is the expected
grade, and the tail probability P(grade >= k) by which documents are selected.

Training uses at most `most` rated documents, taken by a hash of their id (a
documented bound), in numpy on the driver, on features built by Spark.  Every
document's whole text is scored, without a shuffle of it.

Edge cases: null or wordless text has only zeros as features; a very long text is
scored whole; ratings that are null, or of a null doc_id, are left out; with one grade
all documents have that grade; with none, grade and tail are null; repeated rows count
as often as they come, and get the same score; columns of any name come through (but
expected_grade and tail are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C
from loomwork.llm.toxicity import fold

MOST = 8_000
BITS = 14
_DENSE = 3


def _classes() -> np.ndarray:
    out = np.full(256, 3, np.int64)
    for i in range(256):
        c = chr(i)
        out[i] = 4 if i > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    return out


_CLASS = _classes()


def _word_features(w: C.Words, bits: int) -> list[np.ndarray]:
    """Feature numbers of each word, one array for each kind."""
    size = w.end - w.start
    spans = np.stack([w.start, w.end], 1).ravel()
    form = np.zeros(len(w), np.uint64)
    data = np.append(w.data, np.uint8(0))
    for c, most in ((0, 2), (1, 2), (2, 2), (3, 3), (4, 2)):
        n = np.add.reduceat(_CLASS[data] == c, spans, dtype=np.int64)[::2]
        form = form * np.uint64(4) + np.minimum(n, most).astype(np.uint64)
    form = form * np.uint64(8) + np.minimum(size // 4, 7).astype(np.uint64)
    last = data[w.end - 1]
    form = C.mix(form * np.uint64(256) + np.where(_CLASS[last] == 3, last, 0).astype(np.uint64))
    mask = np.uint64((1 << bits) - 1)
    starts = w.first[:-1][w.first[:-1] < len(w)]
    before = np.concatenate((form[:1], form[:-1]))
    before[starts] = form[starts]
    same = np.concatenate(([False], w.hash[1:] == w.hash[:-1]))
    same[starts] = False
    return [(x & mask).astype(np.int64) for x in (form, C.mix(form * np.uint64(31) + before), C.mix(w.hash + np.uint64(5)), C.mix(same.astype(np.uint64) + np.uint64(77)))]


def _dense(w: C.Words) -> np.ndarray:
    out = np.zeros((len(w.first) - 1, _DENSE))
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        if b > a:
            out[i] = len(np.unique(w.hash[a:b])) / (b - a), (w.end[a:b] - w.start[a:b]).mean() / 10, np.log(b - a) / 10
    return out


def _texts(text, bits: int):
    """(words, feature numbers, dense features) of runs of texts."""
    for _, _, data, off in C.chunks(text):
        w = C.Words(data, off)
        yield w, _word_features(w, bits) if len(w) else [], _dense(w)


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1 .. K - 1, one row each."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -30, 30)))


def train(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_features: int, *, rounds: int = 300, rate: float = 0.1, l2: float = 1e-6) -> OrdinalModel:
    """Adam on the mean negative log-likelihood; cuts as a first one and positive gaps, so they stay in order."""
    k = int(grades.max()) + 1
    n = len(grades)
    share = np.array([(grades >= j).mean() for j in range(1, k)])
    start = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2)) if k > 2 else np.empty(0)
    theta = np.concatenate((np.zeros(n_features), start[:1], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, first, gap = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1 :])
        cuts = first + np.concatenate(([0.0], np.cumsum(gap)))
        z = np.bincount(rows, vals * w[cols], n)
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
        full = np.column_stack((np.ones(n), s, np.zeros(n)))
        upper, lower = full[np.arange(n), grades], full[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-9)
        slope = np.column_stack((np.zeros(n), s * (1 - s), np.zeros(n)))
        up, low = slope[np.arange(n), grades] / p / n, slope[np.arange(n), grades + 1] / p / n
        by_z = -(up - low)
        by_cut = np.zeros(k + 1)
        np.add.at(by_cut, grades, up)
        np.subtract.at(by_cut, grades + 1, low)
        by_cut = by_cut[1:k]
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(cols, vals * by_z[rows], n_features) + l2 * w, tail[:1], tail[1:] * gap))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_features + 1 :]))))
    return OrdinalModel(theta[:n_features], cuts)


def fit(docs: DataFrame, ratings: DataFrame, *, most: int = MOST, bits: int = BITS) -> OrdinalModel | None:
    """From rows of ratings (doc_id, grade from 0) outside fold 0."""
    ids = ratings.where("doc_id is not null and grade is not null").where(fold() != 0).select("doc_id", F.col("grade").cast("int").alias("grade"))
    ids = C.stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "grade")
    size = 1 << bits

    def features(batches):
        for b in batches:
            grade = b.column("grade").to_pylist()
            at = 0
            for w, kinds, dense in _texts(b.column("text"), bits):
                for d, (x, y) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    ids, n = np.unique(np.concatenate([k[x:y] for k in kinds]), return_counts=True) if y > x else (np.empty(0, np.int64), np.empty(0))
                    cols = np.concatenate((ids, size + np.arange(_DENSE))).astype(np.int32)
                    vals = np.concatenate((n / max(1, y - x), dense[d])).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([grade[at]], pa.int32()), pa.array([cols.tobytes()], pa.binary()), pa.array([vals.tobytes()], pa.binary())], ["grade", "cols", "vals"])
                    at += 1

    got = rows.mapInArrow(features, "grade int, cols binary, vals binary").toArrow()
    if not got.num_rows:
        return None
    cols = [np.frombuffer(x, np.int32) for x in got.column("cols").to_pylist()]
    vals = np.concatenate([np.frombuffer(x, np.float32) for x in got.column("vals").to_pylist()]).astype(np.float64)
    grades = got.column("grade").to_numpy().astype(np.int64)
    if grades.max() == 0:
        return OrdinalModel(np.zeros(size + _DENSE), np.empty(0))
    return train(np.repeat(np.arange(len(cols)), list(map(len, cols))), np.concatenate(cols), vals, grades, size + _DENSE)


def rated(docs: DataFrame, ratings: DataFrame, at_least: int = 1, **options) -> DataFrame:
    """docs with expected_grade and tail = P(grade >= at_least)."""
    docs = C.without(docs, "expected_grade", "tail")
    rows = C.plain(docs, "doc_id", "text")
    model = fit(rows, ratings, **options)
    if model is None:
        return docs.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("tail", F.lit(None).cast("double"))
    bits = (len(model.weights) - _DENSE).bit_length() - 1
    box = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches):
        weights, cuts = box.value
        model = OrdinalModel(weights, cuts)
        for b in batches:
            z = [np.empty(0)]
            for w, kinds, dense in _texts(b.column("text"), bits):
                total = np.zeros(len(w) + 1)
                for k in kinds:
                    total[1:] += weights[k]
                total = np.cumsum(total)
                n = np.diff(w.first)
                z.append((total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(n, 1) + dense @ weights[-_DENSE:])
            tails = model.tails(np.concatenate(z))
            tail = tails[:, at_least - 1] if at_least <= tails.shape[1] else np.zeros(len(tails))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(1)), pa.array(tail)], [*b.schema.names, "expected_grade", "tail"])

    schema = C.with_field(rows, "expected_grade", "double").add("tail", "double")
    return C.named(rows.mapInArrow(run, schema), docs, "expected_grade", "tail")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail, selected of each document, with the labels' quality as grade."""
    rows = rated(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("grade")))
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).cast("int").alias("selected"))
