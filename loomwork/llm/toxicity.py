"""Toxicity by two class-conditional Kneser-Ney models.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII bytes.  In class c
(ordinary, toxic) a word's probability is a product along its letters: the contexts
are its prefixes of 2 to 8 bytes, and, last, the word itself, so that endings not seen
in training still count for their stem.  For a prefix x and the shorter one h before
it,

    P_c(x | h) = max(n_c(x) - D, 0) / n_c(h) + rest_c(h) * P(x | h)

where rest_c is the discounted mass and P(x | h), *shared by both classes*, is the
number of different words below x over that below h: a rare expression backs off to
the same counts in both, and says nothing.  A class that never saw h gives P(x | h).
Prefixes seen fewer than `least` times are left to `rest`; what no prefix tells apart
any more has the same probability in both classes.  (The word before as one more
context was tried: pairs of words come thrice mostly in copied texts, which stand
for one class each, and 0.944 of held-out documents are right instead of 0.984.  D and `least` are
the likeliest of some on the fold that fits the curve.)

Toxic texts are ordinary texts with toxic words, so the toxic model is in turn
interpolated with the ordinary one: (1 - e) * P_0 + e * P_1.  (With e = 1, small
differences of thousands of ordinary words, as of the languages' shares, outweigh a
few toxic ones: 0.886 of held-out documents are then right, 0.985 with e = 0.003.)
A text's length-normalised log-likelihood under the ordinary model is taken from
that under the toxic one; a logistic function of this one difference, its offset,
scale and e fitted on a fold kept out of the counts, is the score.

Training uses at most `most` labelled documents, taken by a hash of their id: a
documented bound, which bounds the model that tasks get too.  Counting is
distributed.  Every document's whole text is scored, without a shuffle of it.

Edge cases: null or wordless text has difference 0 (score: the fit's value
there); a very long text is scored whole; repeated rows count as often as they come,
and get the same score; a null doc_id is never a training row; labels without a
value, and ids without a text, are no training rows; with one class only, or none, the
score is the toxic share of the training rows, or 0; columns of any name come through
`scored` and `kept` as they are (but one named like the score is replaced); an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C

MOST = 20_000
D = 0.75
LEAST = 6
LENGTHS = (2, 3, 4, 5, 6, 7, 8)
SHARES = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 1.0)
_ROOT = np.uint64(0x243F6A8885A308D3)


def fold(doc_id: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def _words(text):
    for i, j, data, off in C.chunks(text):
        yield i, j, C.Words(C.lowered(data), off, space=C.NOT_ALNUM)


def _chains(w: C.Words, at: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes and, last, of the whole word, for words at `at`; 0 where the word is shorter."""
    size = (w.end - w.start)[at]
    out = np.zeros((len(LENGTHS) + 1, len(at)), np.uint64)
    total = np.zeros(len(at), np.uint64)
    for i in range(LENGTHS[-1]):
        live = np.flatnonzero(size > i)
        total[live] = total[live] * np.uint64(C.ROLL) + w.data[w.start[at[live]] + i].astype(np.uint64) + np.uint64(1)
        if i + 1 in LENGTHS:
            out[LENGTHS.index(i + 1)][live] = C.mix(total[live] + np.uint64(i + 1))
    out[-1] = C.mix(w.hash[at] ^ _ROOT)
    return out


def _distinct(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct word, and each word's number among them."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return first, inverse


def _nodes(batches):
    """(node, its parent, word, ordinary count, toxic count) of the words of a batch."""
    for b in batches:
        toxic = np.array(b.column("toxic").to_pylist(), np.int64)
        for i, j, w in _words(b.column("text")):
            if not len(w):
                continue
            first, number = _distinct(w)
            bad = np.repeat(toxic[i:j], np.diff(w.first))
            ones = np.bincount(number, bad, len(first)).astype(np.int64)
            many = np.bincount(number, minlength=len(first))
            up = np.full(len(first), _ROOT, np.uint64)
            for x in _chains(w, first):
                live = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)) for a in (x[live], up[live], w.hash[first][live])] + [pa.array(many[live] - ones[live]), pa.array(ones[live])], ["node", "up", "word", "n0", "n1"])
                up[live] = x[live]


class KneserNey:
    """log P_toxic - log P_ordinary of words.

    Nodes (prefixes and words): node, the parent up, counts n0 and n1, and the number
    of different words below; root: the same counts of the whole.
    """

    def __init__(self, node, up, n0, n1, below, root, d: float = D):
        node = np.append(node, _ROOT)
        by = np.argsort(node)
        self.node = node[by]
        n = np.stack([np.append(n0, root[0]), np.append(n1, root[1])]).astype(np.float64)[:, by]
        below = np.append(below, root[2]).astype(np.float64)[by]
        h = np.searchsorted(self.node, np.append(up, _ROOT)[by])
        inner = self.node != _ROOT
        some = np.maximum(n, 1)
        seen = np.maximum(n - d, 0)
        kept = np.stack([np.bincount(h[inner], seen[c][inner], len(h)) for c in range(2)])
        rest = np.where(n > 0, np.clip(1 - kept / some, 1e-6, 1), 1.0)
        share = below / below[h]
        p = np.where(n[:, h] > 0, seen / some[:, h] + rest[:, h] * share, share)
        step = np.where(inner, np.log(np.maximum(p, 1e-12)), 0.0)
        total = np.zeros_like(step)
        for _ in range(len(LENGTHS) + 1):
            total = step + np.where(inner, total[:, h], 0.0)
        self.gain = (total[1] - total[0]).astype(np.float32)
        self.leave = np.log(rest[1] / rest[0]).astype(np.float32)

    def of_words(self, w: C.Words, at: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of words."""
        deepest, known = np.full(len(at), np.searchsorted(self.node, _ROOT)), np.zeros(len(at), bool)
        live = np.arange(len(at))
        for x in _chains(w, at):
            here = live[x[live] != 0]
            k = np.minimum(np.searchsorted(self.node, x[here]), len(self.node) - 1)
            hit = self.node[k] == x[here]
            deepest[here[hit]] = k[hit]
            known[here] = hit
            gone = np.zeros(len(at), bool)
            gone[here[~hit]] = True
            live = live[~gone[live]]
        return self.gain[deepest].astype(np.float64) + np.where(known, 0.0, self.leave[deepest])

    def differences(self, w: C.Words, shares=SHARES) -> np.ndarray:
        """Of each text, the mean over its words of log((1 - e) * P_0 + e * P_1) - log P_0, one column for each e."""
        out = np.zeros((len(w.first) - 1, len(shares)))
        if len(w):
            first, number = _distinct(w)
            odds = np.expm1(np.clip(self.of_words(w, first), -30, 30))[number]
            for i, e in enumerate(shares):
                total = np.concatenate(([0.0], np.cumsum(np.log1p(e * odds))))
                out[:, i] = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(np.diff(w.first), 1)
        return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 100) -> np.ndarray:
    """Weights and, last, intercept: Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _texts(model: KneserNey, text, shares) -> np.ndarray:
    out = [model.differences(w, shares) for _, _, w in _words(text)]
    return np.concatenate(out) if out else np.empty((0, len(shares)))


def counted(rows: DataFrame, least: int = LEAST) -> KneserNey | None:
    """The models of rows (text, toxic); None without words."""
    found = rows.select("text", "toxic").mapInArrow(_nodes, "node long, up long, word long, n0 long, n1 long")
    found = C.stored(found.groupBy("node", "up", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "nodes")
    root = found.where(F.col("up") == F.lit(int(_ROOT.view(np.int64)))).agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    if root[2] == 0:
        return None
    kept = found.groupBy("node", "up").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("below")).where(F.col("n0") + F.col("n1") >= least).toArrow()
    C.forget(found)
    col = lambda t, c: t.column(c).to_numpy()
    return KneserNey(col(kept, "node").view(np.uint64), col(kept, "up").view(np.uint64), col(kept, "n0"), col(kept, "n1"), col(kept, "below"), root)


def calibrated(x: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """(e, (scale, offset)) of the likeliest logistic function of one column of x (one for each of SHARES)."""
    best = None
    for i, e in enumerate(SHARES):
        unit = x[:, i].std() or 1.0
        w = logistic(x[:, [i]] / unit, toxic)
        z = np.clip(x[:, i] / unit * w[0] + w[1], -30, 30)
        loss = np.log1p(np.exp(np.where(toxic > 0, -z, z))).sum()
        if best is None or loss < best[0] - 1e-9:
            best = loss, e, np.array([w[0] / unit, w[1]])
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST, least: int = LEAST):
    """(model, e, curve), from rows of labels (doc_id, toxic) outside fold 0; (None, None, constant) if a class is missing."""
    spark = docs.sparkSession
    ids = labels.where("doc_id is not null and toxic is not null").where(fold() != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("turn"))
    ids = C.stored(ids.orderBy("turn", "doc_id").limit(most), "sample")
    rows = C.stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", (F.pmod("turn", F.lit(4)) == 0).alias("check")), "train")
    seen = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    n = [sum(v for (_, t), v in seen.items() if t == c) for c in (0, 1)]
    model = counted(rows.where("not check"), least) if all(seen.get((k, c)) for k in (False, True) for c in (0, 1)) else None
    if model is None:
        return None, None, n[1] / max(1, sum(n))
    box = spark.sparkContext.broadcast(model)

    def compared(batches):
        for b in batches:
            x = _texts(box.value, b.column("text"), SHARES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(len(SHARES))), b.column("toxic")], [*(f"x{i}" for i in range(len(SHARES))), "toxic"])

    check = rows.where("check").select("text", "toxic").mapInArrow(compared, ", ".join(f"x{i} double" for i in range(len(SHARES))) + ", toxic int").toArrow()
    x = np.column_stack([check.column(f"x{i}").to_numpy() for i in range(len(SHARES))])
    C.forget(rows, ids)
    return model, *calibrated(x, check.column("toxic").to_numpy().astype(float))


def scored(docs: DataFrame, labels: DataFrame, into: str = "toxicity", **options) -> DataFrame:
    """docs with a column `into`, 0 to 1 (a column that has this name already is replaced).  Only the text decides it."""
    docs = C.without(docs, into)
    rows = C.plain(docs, "doc_id", "text")
    model, e, curve = fit(rows, labels, **options)
    if model is None:
        return C.named(rows.withColumn("_score", F.lit(float(curve))), docs, "_score").withColumnRenamed("_score", into)
    box = docs.sparkSession.sparkContext.broadcast((model, e, curve))

    def run(batches):
        model, e, (scale, offset) = box.value
        for b in batches:
            x = _texts(model, b.column("text"), (e,))[:, 0]
            score = 1 / (1 + np.exp(-np.clip(x * scale + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "_score"])

    return C.named(rows.mapInArrow(run, C.with_field(rows, "_score", "double")), docs, "_score").withColumnRenamed("_score", into)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    rows = scored(docs.select("doc_id", "text"), labels, "score")
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose score is under `least`."""
    own = C.unused(docs, "toxicity")
    return scored(docs, labels, own).where(F.col(C.quoted(own)) < least).drop(own)
