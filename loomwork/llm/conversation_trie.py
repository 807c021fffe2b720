"""Prefix trie of conversations: an LCP-aware external mergesort, and a stack of open nodes.

A turn becomes 16 bytes (a 128-bit hash of role and text) and its number of code
points; a conversation is its turns' hashes in a row, so that byte order is an order
in which all conversations below a node follow each other, and no text is shuffled.

1. Equal conversations become one sequence with its number of members, the smallest,
   and the hash of its members' ids.  Ids are packed per range of conv_id and hashed in
   a stream, in order, so copies of a third of the table are a few cells.
2. Tasks sort *runs* of sequences; a run keeps, for each sequence, the LCP with the one
   before it, and only the turns after that.  Runs are cut at the cut points of ranges.
3. A range merges its runs by a loser tree: of two heads with different LCPs to the last
   winner the longer LCP wins unseen; equal LCPs are compared from there on, so shared
   turns are not compared again.
4. The merged stream walks the trie with a stack of the open path; a node is finished,
   and its subtree summed up, when the next LCP is less deep.
5. Nodes whose prefix a cut point has may go on in the next range (the root always):
   these few border nodes come out open, are added up by prefix, and their subtrees'
   sums go to all their ancestors by one aggregation.

Cut points are quantiles of a bounded sample of sequences by hash (`SAMPLE` of them, the
first `CUT_TURNS` turns), each no longer than it takes to tell it from the sample before
it.  One conversation's turns lie in one row, 24 bytes a turn.

Edge cases: rows with a null conv_id are dropped; null turns come first; rows with one
turn number are ordered by role, then by the text's hash; repeated rows are turns of their own; null
role or text is empty; a very long text is hashed whole; a conversation that is left without
turns belongs to the root alone; an empty table gives no rows, not even a root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C

T = 16
BLOCK = 100
MOST = 6
RUN_BYTES = 16 << 20
RANGE_BYTES = 2 << 20
RANGE_ROWS = 1024
SAMPLE = 20_000
CUT_TURNS = 256
ID_CELL = 1 << 15
BROADCAST_BYTES = 32 << 20
NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, up binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary, above array<binary>, points long"
_NODES = ["conv_id", "depth", "up", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "id", "above", "points"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.int64()]


# ---------------------------------------------------------------- conversations


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (hash, points)) of each conversation, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn.alias("hash"), F.char_length(text).cast("long").alias("points"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["hash"].alias("hash"), t["points"].alias("points"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conversations with their first h turns taken from the first of their hundred, h = crc32(conv_id) % 6."""
    own = sequences(turns)
    base = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, MOST - 1).alias("base"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % MOST).cast("int")
    rows = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "base_id", "left")
    lead = F.coalesce(F.slice("base", 1, F.col("h")), F.array().cast("array<struct<hash:binary,points:bigint>>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.withColumn("h", h).select("conv_id", F.concat(lead, rest).alias("turns"))


def packed(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, seq: hashes in a row, points: longs in a row, name: 128-bit hash of seq)."""

    def pack(batches):
        for batch in batches:
            turns = C.one(batch.column(1))
            off = np.asarray(turns.offsets).astype(np.int64)
            flat = turns.flatten()
            if off[-1] > off[0]:
                hashes = pa.concat_arrays([flat.field(0)]).cast(pa.binary())
                data = b"".join(hashes.to_pylist())
                points = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                data, points = b"", np.empty(0, np.int64)
            off = off - off[0]
            seq = [data[T * a : T * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            marks = [points[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([C.one(batch.column(0)), pa.array(seq, pa.binary()), pa.array(marks, pa.binary()), pa.array([hashlib.md5(s, usedforsecurity=False).digest() for s in seq], pa.binary())], ["conv_id", "seq", "points", "name"])

    return convs.mapInArrow(pack, "conv_id long, seq binary, points binary, name binary")


def _id_cells(batches):
    """Rows (conv_id, name), of a range of ids -> (name, least, ids), ids in order."""
    ids, names = [], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        names += batch.column(1).to_pylist()
    if not ids:
        return
    ids = np.concatenate(ids)
    order = sorted(range(len(ids)), key=lambda i: (names[i], ids[i]))
    out: list = []
    for name, run in groupby(order, key=names.__getitem__):
        own = ids[list(run)]
        out += [(name, int(own[a]), own[a : a + ID_CELL].tobytes()) for a in range(0, len(own), ID_CELL)]
    for a in range(0, len(out), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 4096], strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["name", "least", "ids"])


def _ends(batches):
    """Cells (name, least, ids) in order -> (name, n, least, sha) of each name, in a stream."""
    now, n, least, sha, rows = None, 0, 0, None, []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["name", "n", "least", "sha"])
        rows.clear()
        return out

    for batch in batches:
        for name, first, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if name != now:
                if now is not None:
                    rows.append((now, n, least, sha.hexdigest()))
                now, n, least, sha = name, 0, first, hashlib.sha256()
            ids = np.frombuffer(cell, np.int64)
            sha.update((b"," if n else b"") + b",".join([b"%d" % i for i in ids.tolist()]))
            n += len(ids)
        if len(rows) >= 4096:
            yield flush()
    if now is not None:
        rows.append((now, n, least, sha.hexdigest()))
        yield flush()


def distinct(convs: DataFrame) -> DataFrame:
    """(seq, points, n, least, sha) of each distinct sequence of packed conversations."""
    parts = C.n_shuffle(convs.sparkSession)
    cells = convs.select("conv_id", "name").repartitionByRange(max(parts, convs.count() >> 20), "conv_id").mapInArrow(_id_cells, "name binary, least long, ids binary")
    ends = cells.repartition(parts, "name").sortWithinPartitions("name", "least").mapInArrow(_ends, "name binary, n long, least long, sha string")
    one = convs.groupBy("name").agg(F.min("seq").alias("seq"), F.min("points").alias("points"))
    return one.join(ends, "name").select("seq", "points", "n", "least", "sha")


# ---------------------------------------------------------------- runs and their merge


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share; the first `known` are known to be."""
    most = min(len(a), len(b)) // T
    step = 1
    while known < most:
        to = min(known + step, most)
        if a[T * known : T * to] == b[T * known : T * to]:
            known, step = to, 2 * step
        elif step == 1:
            break
        else:
            step = 1
    return known


class Run:
    """A sorted run as it is stored: LCPs, and the turns after them."""

    @staticmethod
    def stored(seqs: list[bytes], rest: list[tuple]) -> tuple:
        shared = [0] + [lcp(a, b) for a, b in zip(seqs[:-1], seqs[1:], strict=True)]
        tails = [s[T * k :] for s, k in zip(seqs, shared, strict=True)]
        return (np.array(shared, np.int32).tobytes(), np.array([len(t) for t in tails], np.int64).tobytes(), b"".join(tails), b"".join(r[0][8 * k :] for r, k in zip(rest, shared, strict=True)), np.array([r[1] for r in rest], np.int64).tobytes(), np.array([r[2] for r in rest], np.int64).tobytes(), b"".join(bytes.fromhex(r[3]) for r in rest))

    @staticmethod
    def read(cells: tuple):
        """(lcp with the one before, seq, points, n, least, sha) in order."""
        shared, size, tails, points, n, least, sha = cells
        at, seq, marks = 0, b"", b""
        for i, (k, m, c, low) in enumerate(zip(np.frombuffer(shared, np.int32).tolist(), np.frombuffer(size, np.int64).tolist(), np.frombuffer(n, np.int64).tolist(), np.frombuffer(least, np.int64).tolist(), strict=True)):
            seq = seq[: T * k] + tails[at : at + m]
            marks = marks[: 8 * k] + points[at // 2 : (at + m) // 2]
            at += m
            yield k, seq, marks, c, low, sha[32 * i : 32 * i + 32]


_RUN = "range int, task long, shared binary, size binary, tails binary, points binary, n binary, least binary, sha binary"
_CELLS = ["shared", "size", "tails", "points", "n", "least", "sha"]


def _runs(cuts: list[bytes]):
    """Rows (seq, points, n, least, sha) -> sorted runs, cut into ranges."""

    def flush(rows: list, made: int):
        rows.sort(key=lambda r: r[0])
        out: list = []
        for to, part in groupby(rows, key=lambda r: bisect_right(cuts, r[0])):
            part = list(part)
            out.append((to, (TaskContext.get().partitionId() << 24) + made, *Run.stored([r[0] for r in part], [r[1:] for r in part])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 7), strict=True)], ["range", "task", *_CELLS])

    def make(batches):
        rows, size, made = [], 0, 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(r)
                size += 2 * len(r[0]) + 64
                if size > RUN_BYTES:
                    yield flush(rows, made)
                    rows, size, made = [], 0, made + 1
        if rows:
            yield flush(rows, made)

    return make


def merged(runs: list):
    """(lcp with the one before, seq, ...) of all runs in order: a loser tree whose inner nodes keep the losers.

    Every head's LCP is one with the last winner, so of two heads the longer LCP is the
    smaller sequence; only equal LCPs are compared, from the first turn not known to be
    shared, and the loser then keeps its LCP with the one that beat it.
    """
    end = (-1, None)
    width = 1
    while width < len(runs):
        width *= 2
    heads = [next(r, end) for r in runs] + [end] * (width - len(runs))
    known = [0 if h[1] is not None else -1 for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        k = known[a]
        x, y = heads[a][1], heads[b][1]
        j = lcp(x, y, k)
        if x[T * j : T * j + T] <= y[T * j : T * j + T]:
            known[b] = j
            return a, b
        known[a] = j
        return b, a

    losers = [0] * width
    level = list(range(width))
    base = width
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            won, losers[(base + i) // 2] = play(level[i], level[i + 1])
            up.append(won)
        level, base = up, base // 2
    top = level[0]
    while known[top] >= 0:
        head = heads[top]
        yield (known[top], *head[1:])
        heads[top] = next(runs[top], end)
        known[top] = heads[top][0]  # within a run the LCP with the one before, which has just won
        node = (width + top) // 2
        while node:
            top, losers[node] = play(losers[node], top)
            node //= 2


# ---------------------------------------------------------------- the open path


def _node(k: int, points: int) -> list:
    """[depth, members, least, children, leaves, saved tokens below, sha, points of the last text, finished children]"""
    return [k, 0, None, 0, 0, 0, None, points, []]


def walked(stream, low: bytes, high: bytes):
    """Rows of nodes, of sequences in order; low, high: the range's cut points.

    A node that neither cut point has as a prefix is whole; it comes out when its parent is
    finished, which knows its own smallest member by then.  Others come out open, with the
    names of their ancestors.
    """
    path = [_node(0, 0)]
    prefix = b""
    edge = 0  # the open path's depth that is also a cut point's

    def names(depth: int) -> list[bytes]:
        return [hashlib.md5(prefix[: T * d], usedforsecurity=False).digest() for d in range(depth + 1)]

    def close():
        depth, n, least, kids, leaves, saved, sha, points, below = path.pop()
        if depth <= edge:
            above = names(depth)
            for row in below:
                yield (*row[:2], above[-1], None, *row[3:], None, None, None)
            yield (least, depth, above[-2] if depth else None, None, n, kids, leaves, saved, sha and sha.hex(), above[-1], above, points)
        else:
            saved, leaves = saved + (n - 1) * points, leaves if kids else 1
            for row in below:
                yield (*row[:2], None, least, *row[3:], None, None, None)
            up = path[-1]
            up[3] += 1
            up[4] += leaves
            up[5] += saved
            up[8].append((least, depth, None, n, kids, leaves, saved, sha.hex() if sha else NONE))
        if path:
            up = path[-1]
            up[1] += n
            up[2] = least if up[2] is None else min(up[2], least)

    any_ = False
    for shared, seq, points, n, least, sha in stream:
        any_ = True
        while len(path) > shared + 1:
            yield from close()
        prefix = seq
        edge = max(lcp(seq, low), lcp(seq, high))
        marks = np.frombuffer(points, np.int64)
        for d in range(shared, len(seq) // T):
            path.append(_node(d + 1, int(marks[d])))
        end = path[-1]
        end[1] += n
        end[2] = least if end[2] is None else min(end[2], least)
        end[6] = sha
    while any_ and path:
        yield from close()


def _cut_points(rows: DataFrame, ranges: int) -> list[bytes]:
    """Up to ranges - 1 cut points, each as short as tells it from the sample before."""
    count = rows.count()
    wanted = min(SAMPLE, 64 * ranges)
    some = rows.select(F.substring("seq", 1, T * CUT_TURNS).alias("seq")) if count <= wanted else rows.where(F.pmod(F.xxhash64("seq", F.lit(7)), F.lit(count)) < wanted).select(F.substring("seq", 1, T * CUT_TURNS).alias("seq"))
    sample = sorted({bytes(r.seq) for r in some.collect()})
    cuts = []
    for i in range(1, ranges):
        at = i * len(sample) // ranges
        if at:
            k = lcp(sample[at - 1], sample[at])
            cuts.append(sample[at][: T * (k + 1)])
    return sorted(set(cuts))


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows of _NODE: whole nodes, and open ones of the ranges' borders."""
    size = rows.agg(F.count("*"), F.sum(F.octet_length("seq"))).first()
    ranges = max(1, (size[1] or 0) // RANGE_BYTES, min(size[0] // RANGE_ROWS, 4 * C.n_shuffle(rows.sparkSession)))
    cuts = _cut_points(rows, ranges) if ranges > 1 else []

    def walk(table: pa.Table) -> pa.Table:
        to = table.column("range")[0].as_py()
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        cells = [table.column(c).to_pylist() for c in _CELLS]
        runs = [Run.read(tuple(c[i] for c in cells)) for i in order]
        out = list(walked(merged(runs), cuts[to - 1] if to else b"", cuts[to] if to < len(cuts) else b""))
        C.trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NODES)

    runs = rows.mapInArrow(_runs(cuts), _RUN)
    return runs.repartition(max(1, min(len(cuts) + 1, 4 * C.n_shuffle(rows.sparkSession))), "range").groupBy("range").applyInArrow(walk, _NODE)


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of distinct sequences (seq, points, n, least, sha)."""
    nodes = C.stored(_nodes(rows), "nodes")
    open_ = nodes.where("id is not null").groupBy("id").agg(
        F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("sha"), F.max("points").alias("points"), F.max("above").alias("above"),
    )
    open_ = C.stored(open_, "open")
    kids = open_.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("more"))
    each = open_.join(kids, "id", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    each = each.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("points"))
    each = C.stored(each, "border")
    below = each.select(F.explode("above").alias("id"), "leaves", "saved").groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    least = open_.select(F.col("id").alias("up"), F.col("conv_id").alias("parent"))
    if (open_.agg(F.sum(F.octet_length("id") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        least = F.broadcast(least)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = each.drop("n_leaves", "saved_tokens").join(below, "id").withColumn("ends_sha256", F.coalesce("sha", F.lit(NONE)))
    border = border.join(least, "up", "left").withColumn("parent_conv_id", F.col("parent")).select(names)
    inner = nodes.where("id is null and up is null").select(names)
    outer = nodes.where("id is null").join(least, "up").withColumn("parent_conv_id", F.col("parent")).select(names)
    return inner.union(outer).union(border)


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the rebuilt conversations."""
    convs = C.stored(packed(rebuilt(turns.select("conv_id", "turn", "role", "text"))), "convs")
    return trie(C.stored(distinct(convs), "sequences"))


def prefixes(turns: DataFrame) -> DataFrame:
    """The same nodes of the conversations as they are."""
    convs = C.stored(packed(sequences(turns.select("conv_id", "turn", "role", "text"))), "convs")
    return trie(C.stored(distinct(convs), "sequences"))


#: Prefixes by their chained hash, then sums over all ancestors.
ORACLE = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS points FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base FROM turns),
bits AS (SELECT c, [ascii(s) FOR s IN string_split(CAST(c AS VARCHAR), '')] AS b FROM convs),
crc AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(y AS BIGINT) FOR y IN b]), lambda a, y:
  list_reduce(list_prepend(xor(a, y), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)) AS z FROM bits),
h AS (SELECT c, xor(z, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc),
parts AS (SELECT v.c, t.i AS i, t.x, t.points, 0 AS own FROM convs v JOIN h USING (c) JOIN turns t ON t.conv_id = v.base AND t.i <= h.h
  UNION ALL SELECT v.c, t.i, t.x, t.points, 1 FROM convs v JOIN h USING (c) JOIN turns t ON t.conv_id = v.c AND t.i > h.h),
seqs AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, x, points FROM parts),
chains AS (SELECT c, d, points, md5(string_agg(x, ',') OVER (PARTITION BY c ORDER BY d)) AS p FROM seqs
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
tops AS (SELECT c, max(d) AS top FROM chains GROUP BY c),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(points) AS points FROM chains GROUP BY p, d),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM chains JOIN tops USING (c) WHERE d = top GROUP BY p),
links AS (SELECT DISTINCT a.p AS p, b.p AS up FROM chains a JOIN chains b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT up AS p, count(*) AS n_children FROM links GROUP BY up),
lines AS (SELECT DISTINCT a.p AS p, b.p AS top FROM chains a JOIN chains b ON a.c = b.c AND b.d <= a.d),
sums AS (SELECT l.top AS p, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.points) AS saved_tokens FROM lines l JOIN nodes n ON n.p = l.p LEFT JOIN kids k ON k.p = l.p GROUP BY l.top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN links l ON l.p = n.p LEFT JOIN nodes u ON u.p = l.up LEFT JOIN kids k ON k.p = n.p JOIN sums s ON s.p = n.p LEFT JOIN ends e ON e.p = n.p
"""
