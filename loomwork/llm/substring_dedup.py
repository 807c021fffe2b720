"""Removal of long word runs that an earlier document already has.

Fixed-block anchors.  A run of `window` words always holds a whole block of
`window // 2` words at a multiple of that length, so:

1. every document indexes its non-overlapping blocks and probes the index with
   every rolling window of a block's length (exchange of packed 40-bit hashes);
2. positions whose probe hits anchor candidates; a candidate is extended to all
   windows that hold it whole, and these windows (64-bit hashes of all their
   words) are looked up for the smallest doc_id that has them;
3. windows with a smaller owner elsewhere are merged to maximal repeats, and the
   words they cover go.

Step 1 only filters: a false hit costs work, not words.  Step 2 decides by a
64-bit hash of the whole window.

Edge cases: null or empty text has no words; text with fewer words than
`window` keeps all; a very long text is part of one batch, whole; a null doc_id comes after all
others; rows with equal doc_id (repeated rows too) don't remove each other's words;
repeats within one document stay; other columns, whatever their names, come through
`cleaned` as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C
from loomwork.llm import exchange as X

WINDOW = 50


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([C.NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _words(table: pa.Table):
    for i, j, data, off in C.chunks(table.column("text")):
        yield i, j, C.Words(data, off)


def _each(words: C.Words, roll: np.ndarray, k: int):
    for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a >= k:
            yield d, a, roll[a : b - k + 1]


def _probes(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rolling hashes of k words, and of each: 1 if seen in two places, 2 if it is a block."""
    found, blocks = [], []
    for _, _, w in _words(table):
        roll = C.mix(C.rolling(w.hash, k) + np.uint64(k))
        for _, _, x in _each(w, roll, k):
            found.append(x)
            blocks.append(x[::k])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    keys = np.sort(np.concatenate(found))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    many = np.diff(np.append(new, len(keys))) > 1
    keys = keys[new]
    flag = many.astype(np.uint8)
    flag[np.searchsorted(keys, np.concatenate(blocks))] |= 2
    return keys, flag


def _hits(group: np.ndarray, n: int, flag: np.ndarray) -> np.ndarray:
    seen = np.bincount(group, 1 + (flag & 1), n)
    block = np.bincount(group, flag >> 1, n)
    return ((seen > 1) & (block > 0))[group]


def _candidates(table: pa.Table, hit: np.ndarray, window: int):
    """(document, first word, mask of candidate starts, hashes of the candidates) of each document that has any."""
    k = window // 2
    keys = _probes(table, k)[0]
    keys = keys[hit]
    if not len(keys):
        return
    for i, _, w in _words(table):
        raw = C.rolling(w.hash, k)
        near = C.mix(raw + np.uint64(k))
        slot = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
        near = keys[slot] == near
        far = pow(C.ROLL, k, 1 << 64)
        whole = raw[: max(0, len(raw) - k)] * np.uint64(far) + raw[k:]
        if window > 2 * k:
            whole = C.rolling(w.hash, window)
        for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            if b - a < window:
                continue
            runs = np.concatenate(([0], np.cumsum(near[a : b - k + 1])))
            n = b - a - window + 1
            mask = runs[window - k + 1 : window - k + 1 + n] > runs[:n]
            if mask.any():
                yield i + d, w, d, mask, C.mix(whole[a : a + n][mask] + np.uint64(window))


def _owners(table: pa.Table, hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidate windows and the smallest doc_id of the batch that has each."""
    ids, keys, who = _ids(table), [], []
    for d, _, _, _, x in _candidates(table, hit, window):
        keys.append(x)
        who.append(np.full(len(x), ids[d], np.int64))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, who = np.concatenate(keys), np.concatenate(who)
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return keys[new], who[new]


def _elsewhere(group: np.ndarray, n: int, who: np.ndarray) -> np.ndarray:
    least = np.full(n, C.NULL_ID, np.int64)
    np.minimum.at(least, group, who)
    return least[group] < who


def _kept(table: pa.Table, hit: np.ndarray, earlier: np.ndarray, window: int) -> list[tuple[int, int, bytes]]:
    """(words, words removed, kept words joined by a space) of each row."""
    ids = _ids(table)
    keys, who = _owners(table, hit, window)
    cover: dict[int, np.ndarray] = {}
    for d, w, x, mask, found in _candidates(table, hit, window) if len(keys) else ():
        at = np.searchsorted(keys, found)
        gone = earlier[at] | (who[at] < ids[d])
        if gone.any():
            starts = np.flatnonzero(mask)[gone]
            edge = np.zeros(w.first[x + 1] - w.first[x] + 1, np.int32)
            edge[starts] += 1
            np.subtract.at(edge, starts + window, 1)
            cover[d] = np.cumsum(edge)[:-1] > 0
    out = []
    for i, j, data, off in C.chunks(table.column("text")):
        raw = data.tobytes()
        for d in range(i, j):
            parts = raw[off[d - i] : off[d - i + 1]].split()
            n = len(parts)
            if d in cover:
                parts = [p for p, c in zip(parts, cover[d].tolist(), strict=True) if not c]
            out.append((n, n - len(parts), b" ".join(parts)))
    return out


def repeats(docs: DataFrame, use, schema: str, window: int = WINDOW) -> DataFrame:
    """use(table, rows of _kept) -> Arrow table, over batches of docs."""
    to = X.layout(docs)
    batches = X.batched(docs, to)
    k = window // 2
    hit = X.exchange(batches, to.parts, lambda t: _probes(t, k), _hits, "uint8", "bool", wide=False)
    earlier = X.exchange(batches, to.parts, lambda t, h: _owners(t, h, window), _elsewhere, "int64", "bool", wide=True, given=(hit,))
    return X.consume(batches, (hit, earlier), lambda t, h, e: use(t, _kept(t, h, e, window)), schema)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""

    def use(table: pa.Table, rows: list) -> pa.Table:
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([C.sha256(r[2]) for r in rows], pa.string())})

    return repeats(docs.select(F.col("doc_id").cast("long"), "text"), use, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated runs cut out of `text` (and n_chars, where there is one, counted anew).

    Text that loses nothing stays as it is, white space included; of other text
    the kept words are joined by one space.  No row is dropped.
    """
    plain = C.plain(docs, "doc_id", "text", "n_chars")
    plain = plain.withColumn("doc_id", F.col("doc_id").cast("long"))

    def use(table: pa.Table, rows: list) -> pa.Table:
        table = table.drop_columns(["batch"])
        text = [r[2].decode() if r[1] else t for r, t in zip(rows, table.column("text").to_pylist(), strict=True)]
        at = table.schema.get_field_index("text")
        table = table.set_column(at, table.schema.field(at), pa.array(text, table.schema.field(at).type))
        if "n_chars" in table.schema.names:
            at = table.schema.get_field_index("n_chars")
            table = table.set_column(at, table.schema.field(at), pa.array([None if t is None else len(t) for t in text], table.schema.field(at).type))
        return table

    out = repeats(plain, use, plain.schema, window)
    return C.named(out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), docs)
