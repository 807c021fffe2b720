"""SentencePiece encoding and decoding (BPE models) by suffix-array matching.

A batch's distinct units (a run of blanks and what follows it up to the next
blank; a newline is a unit when no piece holds one) are laid end to end.  The
suffixes of that text, cut at their unit's end, are sorted by their first `_SPAN`
bytes; every piece is found by binary search as one range of suffixes.  A longer
piece's range is sorted by the next `_SPAN` bytes and searched again, until the
whole piece is compared, so pieces and units of any length go this one way.  The
ranges become edges (position, length, piece), ordered by position.  Relaxation
then walks the edges in the model's own order: in each round every unit joins the
best-scored of its neighbouring symbols whose span is an edge, for all units at
once.  That is the order of merges of the library, so ids are equal to its own; a
shortest path over the same edges would give other ids for a BPE model.
Characters that are no piece become byte pieces.

A round joins all places of a unit's best edge together, where that is the same as
one after another from the left: if no span that arises on the way, between a
joined symbol and a neighbour, is an edge as good or better.  Else it joins the
leftmost place only.  So a unit of any length (a text without blanks) takes about
as many rounds as it has different merges.

The model file is read on the driver (its path is a parameter), has a fixed size
and is parsed once per Python worker.  Tasks hold one chunk of `CHUNK` bytes of text
at a time (or one longer document), and the ids of `_KNOWN` bytes of units already
met.

Edge cases: null text gives null ids; empty text gives none; a very long text is one
chunk, encoded whole in blocks of units; rows with equal or null doc_ids are rows as
any other; columns but doc_id and text are not read; U+2581 in a text is a blank to the model, and
decodes as one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 2 << 20
_SPAN = 16
_BLOCK = 192 << 10
_KNOWN = 1 << 20
_NONE = np.int64(1) << 40
_MARK = "▁".encode()


def _fields(data: bytes):
    """(number, value) of a protobuf message; lengths-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A BPE model without normalisation rules, user-defined or unused pieces."""

    def __init__(self, data: bytes):
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b""), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != 2 or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or any(k in (4, 5) for *_, k in pieces):
            raise ValueError("only BPE models with the identity rule, a blank put in front and blanks kept are served")
        self.text = [p.replace(_MARK, b" ") if k == 1 else bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else b" \xe2\x81\x87 " for p, _, k in pieces]
        self.byte = np.zeros(256, np.int32)
        for i, (_, _, k) in enumerate(pieces):
            if k == 6:
                self.byte[self.text[i][0]] = i
        own = [i for i, (_, _, k) in enumerate(pieces) if k == 1]
        self.own = {self.text[i]: i for i in own}
        scores = np.array([s for _, s, _ in pieces])
        self.rank = np.full(len(pieces), _NONE, np.int64)
        self.rank[own] = np.unique(-scores[own], return_inverse=True)[1]
        ordered = sorted((self.text[i], i) for i in own)
        short = [x for x in ordered if len(x[0]) <= _SPAN]
        self.short = np.array([i for _, i in short], np.int32)
        self.low = np.array([p for p, _ in short], f"S{_SPAN}")
        self.high = np.array([p + b"\xff" * (_SPAN - len(p)) for p, _ in short], f"S{_SPAN}")
        self.size = np.array([len(p) for p, _ in short], np.int64)
        self.long = [x for x in ordered if len(x[0]) > _SPAN]
        self.longest = max(map(len, self.own), default=0)
        self.known: dict[bytes, np.ndarray] = {}
        self.known_bytes = 0
        lines = not any(b"\n" in self.text[i] for i in own)
        self.unit = re.compile(rb" +[^ \n]*|[^ \n]+|\n" if lines else rb" +[^ ]*")

    # ------------------------------------------------------------ encoding

    @staticmethod
    def _suffixes(buf: np.ndarray, stop: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Up to _SPAN bytes from each place in `at`, cut at the unit's end (stop), as fixed strings."""
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(_SPAN, np.uint8))), _SPAN)[np.minimum(at, len(buf))]
        left = np.clip(stop - at, 0, _SPAN).astype(np.uint8)
        rows[np.arange(_SPAN, dtype=np.uint8)[None, :] >= left[:, None]] = 0
        return rows

    @staticmethod
    def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of rows of _SPAN bytes, and the rows in it as strings."""
        keys = rows.view(">u8")
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        return order, np.ascontiguousarray(rows[order]).view(f"S{_SPAN}")[:, 0]

    def _deeper(self, buf: np.ndarray, stop: np.ndarray, at: np.ndarray, pieces: list, depth: int) -> list[tuple[np.ndarray, int]]:
        """(places, piece) of pieces longer than depth, among suffixes `at` that agree with them up to depth."""
        if not len(at):
            return []
        order, rows = self._sorted(self._suffixes(buf, stop[at], at + depth))
        at, out, i = at[order], [], 0
        while i < len(pieces):
            part, j = pieces[i][0][depth : depth + _SPAN], i + 1
            full = part + b"\xff" * (_SPAN - len(part))
            a, b = np.searchsorted(rows, np.array([part], rows.dtype), "left")[0], np.searchsorted(rows, np.array([full], rows.dtype), "right")[0]
            if len(pieces[i][0]) <= depth + _SPAN:
                out.append((at[a:b], pieces[i][1]))
            else:
                while j < len(pieces) and pieces[j][0][depth : depth + _SPAN] == part and len(pieces[j][0]) > depth + _SPAN:
                    j += 1
                out += self._deeper(buf, stop, at[a:b], pieces[i:j], depth + _SPAN)
            i = j
        return out

    def _edges(self, buf: np.ndarray, stop: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges up to _SPAN bytes, [position, length - 1] -> piece or -1; and of longer ones sorted keys (position * longest + length) and pieces."""
        order, suffixes = self._sorted(self._suffixes(buf, stop[starts], starts))
        a, b = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        many = b - a
        lead = np.cumsum(many) - many
        at = starts[order[np.repeat(a - lead, many) + np.arange(int(many.sum()))]]
        edges = np.full(len(buf) * _SPAN, -1, np.int32)
        edges[at * _SPAN + np.repeat(self.size, many) - 1] = np.repeat(self.short, many)
        keys, which, i = [], [], 0
        while i < len(self.long):
            head, j = self.long[i][0][:_SPAN], i
            while j < len(self.long) and self.long[j][0][:_SPAN] == head:
                j += 1
            a, b = np.searchsorted(suffixes, np.array([head], suffixes.dtype), "left")[0], np.searchsorted(suffixes, np.array([head], suffixes.dtype), "right")[0]
            for places, p in self._deeper(buf, stop, starts[order[a:b]], self.long[i:j], _SPAN) if b > a else ():
                keys.append(places * (self.longest + 1) + len(self.text[p]))
                which.append(np.full(len(places), p, np.int32))
            i = j
        if not keys:
            return edges, np.empty(0, np.int64), np.empty(0, np.int32)
        key, which = np.concatenate(keys), np.concatenate(which)
        order = np.argsort(key, kind="stable")
        return edges, key[order], which[order]

    def _block(self, units: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"".join(units), np.uint8)
        size = np.array([len(u) for u in units], np.int64)
        stop_of = np.cumsum(size)
        owner = np.repeat(np.arange(len(units), dtype=np.int32), size)
        start = np.flatnonzero((buf & 0xC0) != 0x80)
        edges, long_key, long_piece = self._edges(buf, stop_of[owner], start)
        rank_of = np.append(self.rank, _NONE)

        def pieces(a: np.ndarray, e: np.ndarray) -> np.ndarray:
            """The piece of each span, or -1."""
            span = e - a
            out = edges[a * _SPAN + np.minimum(span, _SPAN) - 1]
            far = np.flatnonzero(span > _SPAN)
            if len(far):
                out[far] = -1
                far = far[span[far] <= self.longest]
                if len(far) and len(long_key):
                    key = a[far] * (self.longest + 1) + span[far]
                    slot = np.minimum(np.searchsorted(long_key, key), len(long_key) - 1)
                    out[far] = np.where(long_key[slot] == key, long_piece[slot], -1)
            return out

        def ranks(a: np.ndarray, e: np.ndarray) -> np.ndarray:
            return rank_of[pieces(a, e)]

        def ends(s: np.ndarray, o: np.ndarray) -> np.ndarray:
            return np.minimum(np.append(s[1:], len(buf)), stop_of[o])

        s, o = start, owner[start]
        e = ends(s, o)
        pair = np.full(len(s), _NONE, np.int64)
        inner = np.flatnonzero(o[1:] == o[:-1])
        pair[inner] = ranks(s[inner], e[inner + 1])
        done_s = []
        while len(s):
            head = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            best = np.minimum.reduceat(pair, head)
            count = np.diff(np.append(head, len(s)))
            live = best < _NONE
            if not live.all():
                keep = np.repeat(live, count)
                done_s.append(s[~keep])
                s, o, e, pair = s[keep], o[keep], e[keep], pair[keep]
                if not len(s):
                    break
                best, count = best[live], count[live]
            hit = np.flatnonzero(pair == np.repeat(best, count))
            first = self._together(hit, s, o, e, pair, ranks)
            e[first] = e[first + 1]
            keep = np.ones(len(s), bool)
            keep[first + 1] = False
            at = np.cumsum(keep) - 1
            s, o, e, pair = s[keep], o[keep], e[keep], pair[keep]
            first = at[first]
            for x in (first, first[first > 0] - 1):
                mine = x[x + 1 < len(s)]
                mine = mine[o[mine] == o[mine + 1]]
                pair[x] = _NONE
                pair[mine] = ranks(s[mine], e[mine + 1])
        s = np.sort(np.concatenate(done_s)) if done_s else np.empty(0, np.int64)
        o = owner[s]
        e = ends(s, o)
        span = e - s
        piece = pieces(s, e)
        many = np.where(piece >= 0, 1, span)
        lead = np.cumsum(many) - many
        out = np.repeat(piece, many)
        raw = np.flatnonzero(out < 0)
        if len(raw):
            sym = np.repeat(np.arange(len(s)), many)[raw]
            out[raw] = self.byte[buf[s[sym] + raw - lead[sym]]]
        cut = np.searchsorted(np.repeat(o, many), np.arange(len(units) + 1))
        return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def _together(hit: np.ndarray, s, o, e, pair, ranks) -> np.ndarray:
        """Of the places of the units' best edges those joined in this round: all that don't overlap, or the leftmost of a unit."""
        lone = np.concatenate(([True], o[hit[1:]] != o[hit[:-1]]))
        if lone.all():
            return hit
        run = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | lone[1:]))
        turn = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        some = turn % 2 == 0
        first, many = hit[some], ~(lone[some] & np.append(lone[some][1:], True))
        at = first[many]
        bad = np.zeros(len(at), bool)
        after = at + 2
        fits = np.flatnonzero(np.append(o, -1)[np.minimum(after, len(o))] == o[at])
        bad[fits] = ranks(s[at[fits]], e[after[fits]]) <= pair[at[fits]]
        joined = np.zeros(len(s), bool)
        joined[first + 1] = True
        before = np.maximum(at - 1, 0)
        left = np.where(joined[before], s[np.maximum(at - 2, 0)], s[before])
        fits = np.flatnonzero((at > 0) & (o[before] == o[at]))
        bad[fits] |= ranks(left[fits], e[at[fits] + 1]) <= pair[at[fits]]
        if not bad.any():
            return first
        return first[~np.isin(o[first], o[at[bad]]) | lone[some]]

    def units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit; those of _KNOWN bytes of units are remembered."""
        out = list(map(self.known.get, units))
        block: list[int] = []
        size = 0

        def flush() -> None:
            for i, ids in zip(block, self._block([units[i] for i in block]) if block else (), strict=True):
                out[i] = ids.copy()
                if self.known_bytes < _KNOWN and len(units[i]) <= 64:
                    self.known[units[i]] = out[i]
                    self.known_bytes += len(units[i])
            block.clear()

        for i, ids in enumerate(out):
            if ids is None:
                block.append(i)
                size += len(units[i])
                if size > _BLOCK:
                    flush()
                    size = 0
        flush()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        runs = [np.array([number(u, len(seen)) for u in self.unit.findall(b" " + t.replace(_MARK, b" "))] if t else [], np.int64) for t in texts]
        parts = self.units(list(seen))
        size = np.array([len(p) for p in parts], np.int64)
        lead = np.cumsum(size) - size
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        out = []
        for r in runs:
            n = size[r]
            out.append(ids[np.repeat(lead[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_PARSED: dict[bytes, PieceModel] = {}


def parsed(data: bytes) -> PieceModel:
    """The model of these bytes, parsed once in a Python process; the last one is kept."""
    key = hashlib.sha1(data).digest()
    if key not in _PARSED:
        _PARSED.clear()
        _PARSED[key] = PieceModel(data)
    return _PARSED[key]


def encoded(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, tokens, and whether decoding gives the text again (U+2581 counts as a blank)."""
    data = docs.sparkSession.sparkContext.broadcast(load(model))
    schema = "doc_id long, n_tokens long, tokens array<int>, round_trip boolean"

    def run(batches):
        pieces = parsed(data.value)
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            for i, j, raw, off in C.chunks(text, CHUNK):
                whole = raw.tobytes()
                texts = [whole[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                got = pieces.encode(texts)
                null = text.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                size = np.array([len(x) for x in got], np.int64)
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), mask=pa.array(null))
                same = [pieces.decode(x.tolist()) == t.replace(_MARK, b" ").decode() for x, t in zip(got, texts, strict=True)] if check else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size, mask=null), lists, pa.array(same, pa.bool_(), mask=null)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, tokens)."""
    data = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        pieces = parsed(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else pieces.decode(x) for x in b.column("tokens").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "tokens").mapInArrow(run, "doc_id long, text string")
