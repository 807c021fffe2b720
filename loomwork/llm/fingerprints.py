"""One-permutation MinHash fingerprints with optimal densification and b-bit packing.

A text's shingle hashes are binned once by their first bits; a bin keeps its
least hash.  An empty bin takes the value of a bin chosen by a hash of (bin,
attempt), for the first attempt that meets a filled bin: the same attempts for
every text, so fingerprints stay comparable.  Each bin scrambles its value with its
own number, so that copies of one unequal value don't all agree by chance; the
`bits` low-order bits are packed.  Two unequal bins agree by chance with probability 2**-bits;
the estimate (agreement - 2**-bits) / (1 - 2**-bits), held to [0, 1], corrects
for that.

A fingerprint is the hex of its packed bins.  A text without words has the empty
string; it is like another such text (1.0) and unlike all others (0.0).  A text
with fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C

BINS = 512
BITS = 4
_TRIES = 64
LOTS = 1 << 16
PER_LOT = 32


def _attempts(bins: int, first: int) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64)[None, :] + np.arange(first, first + _TRIES, dtype=np.uint64)[:, None] * np.uint64(bins)
    return (C.mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, k: int = C.SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bins: a power of two; bits: 1, 2, 4 or 8")
        self.bins, self.bits, self.k = bins, bits, k
        self._shift = np.uint64(64 - (bins.bit_length() - 1))
        self._own = C.mix(np.arange(1, bins + 1, dtype=np.uint64))
        self._tables = [_attempts(bins, 0)]

    def _table(self, i: int) -> np.ndarray:
        while len(self._tables) <= i:
            self._tables.append(_attempts(self.bins, len(self._tables) * _TRIES))
        return self._tables[i]

    def of_shingles(self, s: np.ndarray) -> bytes:
        """s: sorted distinct hashes."""
        if not len(s):
            return b""
        at = (s >> self._shift).astype(np.int64)
        first = np.concatenate(([True], at[1:] != at[:-1]))
        at = at[first]
        least = np.zeros(self.bins, np.uint64)
        least[at] = s[first]
        if len(at) == 1:
            least[:] = least[at[0]]
        elif len(at) < self.bins:
            full = np.zeros(self.bins, bool)
            full[at] = True
            empty, i = np.flatnonzero(~full), 0
            while len(empty):
                to = self._table(i)[:, empty]
                good = full[to]
                which = good.argmax(0)
                cols = np.arange(len(empty))
                done = good[which, cols]
                least[empty[done]] = least[to[which[done], cols[done]]]
                empty, i = empty[~done], i + 1
        low = (C.mix(least + self._own) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        if self.bits == 8:
            return low.tobytes()
        per = 8 // self.bits
        packed = low[0::per].copy()
        for j in range(1, per):
            packed |= low[j::per] << (j * self.bits)
        return packed.tobytes()

    def of_texts(self, texts: pa.Array) -> list[bytes]:
        out = []
        for _, _, data, off in C.chunks(texts):
            out += [self.of_shingles(s) for s in C.shingle_sets(C.Words(data, off), self.k)]
        return out

    def _bins(self, x: np.ndarray) -> np.ndarray:
        per = 8 // self.bits
        return np.stack([(x >> (j * self.bits)) & ((1 << self.bits) - 1) for j in range(per)])

    def likeness(self, a: bytes, b: bytes) -> float:
        if not a or not b:
            return float(a == b)
        same = (self._bins(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)) == 0).mean()
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = C.SHINGLE) -> DataFrame:
    """docs (doc_id, text) with a column `fingerprint`: hex; a column that has this name already is replaced."""
    docs = C.without(docs, "fingerprint")
    rows = C.plain(docs, "text")
    schema = C.with_field(rows, "fingerprint", "string")

    def run(batches):
        maker = Fingerprinter(bins, bits, k)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.hex() for x in maker.of_texts(b.column("text"))], pa.string())], [*b.schema.names, "fingerprint"])

    return C.named(rows.mapInArrow(run, schema), docs, "fingerprint")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(rows, maker: Fingerprinter):
    """(id, text, fingerprint, next text, next fingerprint) of rows (lot, id, ahead, text) in order; `ahead` rows only end a lot."""
    held = None
    for lot, ahead, ids, texts in rows:
        prints = maker.of_texts(texts)
        for g, a, i, t, f in zip(lot, ahead, ids, texts.to_pylist(), prints, strict=True):
            t = t or ""
            if held and held[0] == g:
                yield *held[1:], t, f
            held = None if a else (g, i, t, f)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows, partitions to deal them to).  Rows (lot, ahead, key, doc_id, text): lots are runs of doc_id, each ended by the first rows of the next one.

    The last lot ends with the first document.  Cut points are quantiles of a sample
    of doc_ids by hash, about `PER_LOT` a lot; they decide only where lots end.  There
    are at most `LOTS` lots, so the sample is bounded; a lot is read in a stream,
    whatever its size.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.id_key().alias("key"), "text")
    n_bytes, n_rows = C.extent(docs)
    n = int(min(LOTS, max(4 * C.n_shuffle(spark), n_bytes // (16 << 20))))
    some = docs.where(F.pmod(F.xxhash64("key", F.lit("lot")), F.lit(max(1, n_rows // (PER_LOT * n)))) == 0).select("key").toArrow()
    ids = np.sort(some.column("key").to_numpy())
    least = docs.agg(F.min("key")).first()[0]
    cuts = np.unique(ids[(np.arange(1, n) * len(ids)) // n]) if len(ids) else np.empty(0, np.int64)
    cuts = cuts[cuts > least] if len(cuts) else cuts

    def place(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            lot = np.searchsorted(cuts, key, "right")
            at = np.searchsorted(cuts, key, "left")
            cut = (at < lot) | (key == least)
            rows = np.concatenate((np.arange(len(key)), np.flatnonzero(cut)))
            ahead = np.arange(len(rows)) >= len(key)
            lots = np.concatenate((lot, np.where(key == least, len(cuts), lot - 1)[cut]))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(lots.astype(np.int32)), pa.array(ahead), *(b.column(c).take(take) for c in ("key", "doc_id", "text"))], ["lot", "ahead", "key", "doc_id", "text"])

    return docs.mapInArrow(place, "lot int, ahead boolean, key long, doc_id long, text string"), max(C.n_shuffle(spark), n_bytes // (64 << 20))


def edited_report(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = C.SHINGLE) -> DataFrame:
    """Fingerprints of each document and of its edited text (see op1), and their likeness.

    Edge cases: null text is empty; equal doc_ids (repeated rows too) are ordered by
    text; null doc_ids come last; the only document is its own next one; very long
    texts are taken whole, rows in runs of some MB; columns but doc_id and text are
    not read; an empty table gives no rows.
    """

    def run(batches):
        maker = Fingerprinter(bins, bits, k)
        rows = ((b.column("lot").to_pylist(), b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")) for b in batches)
        out = []

        def flush():
            edited = []
            for _, t, _, u, _ in out:
                n = len(t) // 4
                edited.append(t[: len(t) - n] + u[:n])
            prints = maker.of_texts(pa.array(edited, pa.string()))
            cols = [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([len(x[1]) for x in out], pa.int64()),
                pa.array([C.sha256(t.encode()) for t in edited], pa.string()),
                pa.array([x[2].hex() for x in out], pa.string()),
                pa.array([p.hex() for p in prints], pa.string()),
                pa.array([maker.likeness(x[2], p) for x, p in zip(out, prints, strict=True)], pa.float64()),
                pa.array([maker.likeness(x[2], x[4]) for x in out], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for row in _pairs(rows, maker):
            out.append(row)
            size += len(row[1])
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    rows, n = with_next(docs)
    return rows.repartition(n, "lot").sortWithinPartitions("lot", "ahead", "key", "text").mapInArrow(run, _OUT)
