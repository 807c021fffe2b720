"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased, by its
128-bit hash; lines under `LEAST` code points have none.  An index holds:

* postings: a row for each row of documents, with its distinct keys packed;
* shards of the keys by their first bits.  A shard has the *exact table* (key,
  number of rows that hold it, smallest doc_id) as sorted packed arrays, and a
  *cuckoo filter* of 16-bit fingerprints in buckets of four, where a key lies as
  often as it is held, twice at most.

`insert` adds documents, `delete` takes documents out again: the exact counts tell
which keys go from none to one, from one to two, or back, and only those copies are
put into, or taken out of, the filters.  A filter that fills up, or a shard that
grows beyond `SHARD_KEYS`, is made anew from the exact table.  After a deletion the
counts, and what the filters answer, are those of an index that never had the
documents.

`marked` asks the index: documents, dealt into batches, send 40 bits of each
distinct key to its shard's filter; only keys that it holds twice (repeated lines,
and about one in ten thousand others) are looked up in the exact table.

Each batch, and each Arrow batch of an insertion, names a key once, so a line that a
third of all documents hold costs its shard one entry a batch.  Keys travel as packed
cells.  An insertion or deletion reads the whole exact table (28 bytes a key), no
text but that of the new documents.

Edge cases: null or empty text is one empty line; a very long text or line is taken
whole; a null doc_id comes after all others; rows with equal (or null) doc_id are one
document, which doesn't lose lines to itself; `deduped` keeps null texts null, leaves
texts that lose nothing as they are, and passes on columns of any name; an empty
table gives no rows.  A doc_id that is inserted twice is held twice, and `delete`
takes all its rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C
from loomwork.llm import exchange as X

LEAST = 10
SHARD_KEYS = 1 << 16
LEAST_BITS = 4
FULL = 0.8
KICKS = 400
_SHARD = "part int, n long, refs binary, filter binary"
_U = np.uint64
_REF = np.dtype([("h", "u8"), ("g", "u8"), ("n", "u4"), ("first", "i8")])


# ---------------------------------------------------------------- cuckoo filter


class Cuckoo:
    """Fingerprints of 40-bit keys, each as often as it was put in."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.mask = np.int64(len(cells) - 1)

    @classmethod
    def sized(cls, copies: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, copies) / (4 * FULL))))), 4), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray, copies: np.ndarray) -> Cuckoo:
        """A filter with room for the keys, each in as many copies."""
        all_, room = np.repeat(keys, copies), int(copies.sum())
        while True:
            made = cls.sized(room)
            if made.put(all_):
                return made
            room = max(2 * room, 16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.maximum(keys & _U(0xFFFF), _U(1)).astype(np.uint16)
        return mark, (keys >> _U(16)).astype(np.int64) & self.mask

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (C.mix(mark.astype(np.uint64)).astype(np.int64) & self.mask)

    def put(self, keys: np.ndarray) -> bool:
        """False if not all found room; the filter is then of no more use."""
        mark, at = self._places(keys)
        for turn in range(KICKS):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            new = np.concatenate(([True], at[1:] != at[:-1]))
            rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            free = self.cells[at] == 0
            room = free.sum(1)
            fits = rank < room
            slot = np.argmax(np.cumsum(free, 1) == rank[:, None] + 1, 1)
            self.cells[at[fits], slot[fits]] = mark[fits]
            left, far = mark[~fits], at[~fits]
            if turn and len(left):  # both places were full: the first of each bucket takes another's slot, whose owner goes to its other place
                lead = (rank == room)[~fits]
                slot = (C.mix(far[lead].astype(np.uint64) + _U(turn)) & _U(3)).astype(np.int64)
                out = self.cells[far[lead], slot].copy()
                self.cells[far[lead], slot] = left[lead]
                left = left.copy()
                left[lead] = out
            mark, at = left, self._other(left, far)
        return not len(mark)

    def take(self, keys: np.ndarray) -> None:
        """Takes one copy of each out; all must be in it."""
        mark, at = self._places(keys)
        while len(mark):
            pair = np.minimum(at, self._other(mark, at)) << 16 | mark
            _, lead = np.unique(pair, return_index=True)
            m, b = mark[lead], at[lead]
            here = (self.cells[b] == m[:, None]).any(1)
            b = np.where(here, b, self._other(m, b))
            self.cells[b, np.argmax(self.cells[b] == m[:, None], 1)] = 0
            rest = np.ones(len(mark), bool)
            rest[lead] = False
            mark, at = mark[rest], at[rest]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Copies of each key, or of others with its fingerprint."""
        mark, at = self._places(keys)
        far = self._other(mark, at)
        near = (self.cells[at] == mark[:, None]).sum(1)
        return near + np.where(far != at, (self.cells[far] == mark[:, None]).sum(1), 0)


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after those that name the shard."""
    return (h << _U(bits)) >> _U(24)


# ---------------------------------------------------------------- lines and keys


class Lines:
    """Lines of a run of documents: document, span, and 128-bit key (h, g) of those that have one."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int = LEAST):
        ends = np.flatnonzero(data == 10)
        doc = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, ends, "right") - 1))
        start = np.concatenate((off[:-1], ends + 1))
        order = np.lexsort((start, doc))
        self.doc, self.start = doc[order], start[order]
        last = np.concatenate((self.doc[1:] != self.doc[:-1], [True])) if len(doc) else np.empty(0, bool)
        self.end = np.where(last, off[self.doc + 1], np.concatenate((self.start[1:], [0])) - 1) if len(doc) else self.start
        inked = np.flatnonzero(~C._SPACE[data])
        a, b = np.searchsorted(inked, self.start), np.searchsorted(inked, self.end)
        some = np.flatnonzero(a < b)
        s, e = inked[a[some]], inked[b[some] - 1] + 1
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        long = points[e] - points[s] >= least
        self.keyed, s, e = some[long], s[long], e[long]
        low = C.lowered(data).tobytes()
        made = b"".join([hashlib.md5(low[i:j], usedforsecurity=False).digest() for i, j in zip(s.tolist(), e.tolist(), strict=True)])
        self.key = np.frombuffer(made, "<u8").reshape(-1, 2)


def _chunks(table):
    """(first row, Lines, bytes) of runs of the table's rows."""
    for i, _, data, off in C.chunks(table.column("text"), 4 << 20):
        yield i, Lines(data, off), data


def _distinct(who: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (who, key), ordered by who, then key."""
    order = np.lexsort((key[:, 1], key[:, 0], who))
    who, key = who[order], key[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1]).any(1)
    return who[new], key[new]


def _postings(batches):
    """Rows (doc_id, text) -> (doc_id, keys)."""
    for batch in batches:
        cells = [b""] * batch.num_rows
        for i, lines, _ in _chunks(batch):
            who, key = _distinct(lines.doc[lines.keyed], lines.key)
            cut = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True]))) if len(who) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                cells[i + who[a]] = key[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([C.one(batch.column(0)), pa.array(cells, pa.binary())], ["doc_id", "keys"])
    C.trim()


def _merged(h: np.ndarray, g: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The exact table: one entry for each distinct key, in order."""
    order = np.lexsort((g, h))
    h, g, n, first = h[order], g[order], n[order], first[order]
    lead = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(h) else np.empty(0, np.int64)
    out = np.empty(len(lead), _REF)
    out["h"], out["g"] = h[lead], g[lead]
    if len(lead):
        out["n"], out["first"] = np.add.reduceat(n, lead), np.minimum.reduceat(first, lead)
    return out


def _slices(refs: np.ndarray, bits: int):
    """(shard, its entries)."""
    part = (refs["h"] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(refs), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[a]), refs[a:b]


def _cells(postings: DataFrame, bits: int, kind: int) -> DataFrame:
    """Rows (part, kind, n, refs, filter): what each Arrow batch of postings adds to each shard."""

    def make(batches):
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 2)
            size = np.array([len(x) // 16 for x in batch.column(1).to_pylist()], np.int64)
            who = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
            refs = _merged(key[:, 0], key[:, 1], np.ones(len(key), np.uint32), who)
            rows = [(p, kind, len(x), x.tobytes(), None) for p, x in _slices(refs, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _KINDS], _NAMES)

    return postings.mapInArrow(make, _CELL)


_CELL = "part int, kind int, n long, refs binary, filter binary"
_NAMES = ["part", "kind", "n", "refs", "filter"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_OLD, _ADDED, _LEFT = 0, 1, 2


def _table(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), _REF)


def _updated(table: pa.Table, bits: int) -> pa.Table:
    """A shard's rows: the old one, and what is added, or what is left -> its new row."""
    kind = np.array(table.column("kind").to_pylist())
    cells, part = table.column("refs").to_pylist(), table.column("part")[0].as_py()
    old = _table([cells[i] for i in np.flatnonzero(kind == _OLD)])
    left = (kind == _LEFT).any()
    x = _table([cells[i] for i in np.flatnonzero(kind != (_OLD if left else -1))])
    new = _merged(x["h"], x["g"], x["n"], x["first"]) if len(x) else x
    if left:
        new = new[new["n"] > 0]
    before = next((table.column("filter")[int(i)].as_py() for i in np.flatnonzero(kind == _OLD)), None)
    both = _merged(np.concatenate((old["h"], new["h"])), np.concatenate((old["g"], new["g"])), np.concatenate((np.minimum(old["n"], 2), 4 * np.minimum(new["n"], 2))).astype(np.uint32), np.zeros(len(old) + len(new), np.int64))
    had, has = (both["n"] & 3).astype(np.int64), (both["n"] >> 2).astype(np.int64)
    short = _short(both["h"], bits)
    made = None
    if before is not None:
        made = Cuckoo(np.frombuffer(before, np.uint16).reshape(-1, 4).copy())
        made.take(np.repeat(short, np.maximum(had - has, 0)))
        if not made.put(np.repeat(short, np.maximum(has - had, 0))):
            made = None
    if made is None or len(made.cells) > 8 * max(1, int(has.sum())):
        made = Cuckoo.of(short, has)
    C.trim()
    return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(new)], pa.int64()), "refs": pa.array([new.tobytes()], pa.binary()), "filter": pa.array([made.cells.tobytes()], pa.binary())})


# ---------------------------------------------------------------- index


@dataclass(frozen=True)
class LineIndex:
    """postings (doc_id, keys); shards (part, n, refs, filter), 2**bits of them."""

    postings: DataFrame
    shards: DataFrame
    bits: int

    def counts(self) -> DataFrame:
        """The exact table as rows: key (hex), n rows that hold it, first doc_id."""

        def rows(batches):
            for batch in batches:
                x = _table(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([f"{a:016x}{b:016x}" for a, b in zip(x["h"].tolist(), x["g"].tolist(), strict=True)], pa.string()), pa.array(x["n"].astype(np.int64)), pa.array(x["first"].astype(np.int64))], ["key", "n", "first"])

        return self.shards.select("refs").mapInArrow(rows, "key string, n long, first long")


def _bits(keys: int) -> int:
    return max(LEAST_BITS, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


def _n_keys(postings: DataFrame) -> int:
    return (postings.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 16


def _resharded(index: LineIndex, bits: int) -> DataFrame:
    """The old shards as cells, cut into more shards where there are to be more; their filters are then made anew."""
    if bits == index.bits:
        return index.shards.select("part", F.lit(_OLD).alias("kind"), "n", "refs", "filter")

    def cut(batches):
        for batch in batches:
            rows = [(p, _ADDED, len(x), x.tobytes(), None) for cell in batch.column(0).to_pylist() for p, x in _slices(_table([cell]), bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], t) for t in _KINDS], _NAMES)

    return index.shards.select("refs").mapInArrow(cut, _CELL)


def _shards(cells: DataFrame, bits: int) -> DataFrame:
    dealt = cells.repartition(min(1 << bits, 4 * C.n_shuffle(cells.sparkSession)), "part")
    return C.stored(dealt.groupBy("part").applyInArrow(lambda t: _updated(t, bits), _SHARD), "lines")


def insert(index: LineIndex | None, docs: DataFrame) -> LineIndex:
    """index (None: an empty one) with the documents doc_id, text of docs."""
    C.importable(docs.sparkSession)
    rows = docs.select(C.id_key().alias("doc_id"), "text")
    added = C.stored(rows.mapInArrow(_postings, "doc_id long, keys binary"), "postings")
    held = index.shards.agg(F.sum("n")).first()[0] or 0 if index else 0
    bits = max(index.bits if index else 0, _bits(held + _n_keys(added)))
    cells = _cells(added, bits, _ADDED)
    if index:
        cells = cells.union(_resharded(index, bits))
    return LineIndex(index.postings.union(added) if index else added, _shards(cells, bits), bits)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """index without the documents whose doc_id is in ids (doc_id; null: those without one)."""
    gone = ids.select(C.id_key().alias("doc_id")).distinct()
    kept = C.stored(index.postings.join(gone, "doc_id", "left_anti").select("doc_id", "keys"), "postings")
    old = index.shards.select("part", F.lit(_OLD).alias("kind"), "n", "refs", "filter")
    # a shard that loses all its keys still has a row of what is left: an empty one
    none = index.shards.select("part", F.lit(_LEFT).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("refs"), F.lit(None).cast("binary").alias("filter"))
    return LineIndex(kept, _shards(_cells(kept, index.bits, _LEFT).union(old).union(none), index.bits), index.bits)


# ---------------------------------------------------------------- questions


def _keys(table: pa.Table) -> np.ndarray:
    """Distinct keys of a batch, in order."""
    found = [lines.key for _, lines, _ in _chunks(table)]
    key = np.concatenate(found) if found else np.empty((0, 2), "<u8")
    return _distinct(np.zeros(len(key), np.int8), key)[1]


def _asked(batches: DataFrame, index: LineIndex, emit, column: str, resolve, answer: str, given: tuple = ()) -> X.Answers:
    """emit(table, answers...) -> (sorted uint64 h, g or None); resolve(the shard's column, h or its 40 bits, g) -> answers."""
    bits = index.bits

    def send(table: pa.Table, *got: np.ndarray) -> pa.Table:
        rows: dict[str, list] = {"part": [], "batch": [], "keys": [], "extra": []}
        if table.num_rows:
            h, g = emit(table, *got)
            part = (h >> _U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(h) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows["part"].append(int(part[a]))
                rows["batch"].append(table.column("batch")[0].as_py())
                rows["keys"].append(X._packed(h[a:b], bits, g is not None))
                rows["extra"].append(b"" if g is None else g[a:b].tobytes())
        return pa.table(rows, pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]))

    def look(asked: pa.Table, shard: pa.Table) -> pa.Table:
        cells = []
        state = shard.column(column)[0].as_py() if shard.num_rows else None
        for keys, extra in zip(asked.column("keys").to_pylist(), asked.column("extra").to_pylist(), strict=True):
            g = np.frombuffer(extra, np.uint64) if extra else None
            out = resolve(state, X._unpacked(keys, g is not None), g).astype(answer)
            cells.append(len(out).to_bytes(4, "little") + (np.packbits(out) if answer == "bool" else out).tobytes())
        C.trim()
        return pa.table({"batch": asked.column("batch").cast(pa.int32()), "part": asked.column("part").cast(pa.int32()), "answer": pa.array(cells, pa.binary())})

    sent = X.consume(batches, given, send, X._ROW) if given else batches.groupBy("batch").applyInArrow(lambda t: send(t), X._ROW)
    return X.Answers(sent.groupBy("part").cogroup(index.shards.select("part", column).groupBy("part")).applyInArrow(look, X._ANSWER), answer)


def _twice(cells: bytes | None, keys: np.ndarray, _) -> np.ndarray:
    return Cuckoo(np.frombuffer(cells, np.uint16).reshape(-1, 4)).count(keys) >= 2 if cells else np.zeros(len(keys), bool)


def _first(refs: bytes | None, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The smallest doc_id that holds each key; the largest number if none does."""
    x = _table([refs] if refs else [])
    out = np.full(len(h), C.NULL_ID, np.int64)
    at, end = np.searchsorted(x["h"], h), np.searchsorted(x["h"], h, "right")
    while (open_ := at < end).any():  # one turn, unless two keys share 64 bits
        hit = np.flatnonzero(open_)
        same = x["g"][at[hit]] == g[hit]
        out[hit[same]] = x["first"][at[hit[same]]]
        at[hit] += 1
    return out


def _repeated(table: pa.Table, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = _keys(table)[twice]
    return key[:, 0], key[:, 1]


def marked(docs: DataFrame, index: LineIndex, use, schema) -> DataFrame:
    """use(table, [(number of lines, number dropped, kept bytes) of each row]) -> Arrow table, over batches of docs."""
    n_bytes, n_rows = C.extent(docs)
    to = X.Layout(n_bytes, n_rows, C.n_shuffle(docs.sparkSession))
    batch = F.pmod(F.xxhash64(C.id_key(), F.xxhash64("text")), F.lit(to.batches)).cast("int")
    batches = docs.withColumn("batch", batch).repartition(max(C.n_shuffle(docs.sparkSession), n_bytes // (64 << 20)), "batch")
    twice = _asked(batches, index, lambda t: (_keys(t)[:, 0], None), "filter", _twice, "bool")
    first = _asked(batches, index, _repeated, "refs", _first, "int64", given=(twice,))

    def call(table: pa.Table, twice: np.ndarray, first: np.ndarray):
        ids = np.array([C.NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        known = _keys(table)[twice] if len(twice) else np.empty((0, 2), "<u8")
        names = {k.tobytes(): f for k, f in zip(known, first.tolist(), strict=True)}
        rows: list = []
        for i, lines, data in _chunks(table):
            raw = data.tobytes()
            gone = np.zeros(len(lines.start), bool)
            if names:
                flat = lines.key.tobytes()
                held = np.array([names.get(flat[k : k + 16], C.NULL_ID) for k in range(0, len(flat), 16)], np.int64)
                gone[lines.keyed] = held < ids[i + lines.doc[lines.keyed]]
            cut = np.flatnonzero(np.concatenate(([True], lines.doc[1:] != lines.doc[:-1], [True])))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if gone[a:b].any():
                    kept = b"\n".join([raw[lines.start[k] : lines.end[k]] for k in range(a, b) if not gone[k]])
                else:
                    kept = raw[lines.start[a] : lines.end[b - 1]]
                rows.append((int(b - a), int(gone[a:b].sum()), kept))
        return use(table, rows)

    return X.consume(batches, (twice, first), call, schema)


def digest(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document; index: one that holds docs (by default made of them)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    index = index or insert(None, docs)

    def use(table: pa.Table, rows: list) -> pa.Table:
        return pa.table({"doc_id": table.column("doc_id"), "n_lines": pa.array([r[0] for r in rows], pa.int64()), "n_dropped": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([C.sha256(r[2]) for r in rows], pa.string())})

    return marked(docs, index, use, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduped(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs without the lines that a document with a smaller doc_id holds in the index (and n_chars, where there is one, counted anew)."""
    plain = C.plain(docs, "doc_id", "text", "n_chars")
    plain = plain.withColumn("doc_id", F.col("doc_id").cast("long"))
    index = index or insert(None, plain)

    def use(table: pa.Table, rows: list) -> pa.Table:
        table = table.drop_columns(["batch"])
        text = [r[2].decode() if r[1] else t for r, t in zip(rows, table.column("text").to_pylist(), strict=True)]
        for name, values in (("text", text), ("n_chars", [None if t is None else len(t) for t in text])):
            if name in table.schema.names:
                at = table.schema.get_field_index(name)
                table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
        return table

    out = marked(plain, index, use, plain.schema)
    return C.named(out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), docs)
