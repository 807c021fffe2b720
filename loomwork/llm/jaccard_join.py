"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

Texts equal byte for byte are one representative.  Then:

1. A packed exchange counts, for every shingle, the representatives that have
   it.  A shingle of one document can't be in an intersection; so a document
   with fewer than ceil(t * n) shared shingles (of its n) links with nothing and
   is done.  The rest keep their shared shingles, and their *prefix*: the first
   n - ceil(t * n) + 1 in the order of rising count.  Linked documents share a
   shingle of both prefixes.
2. Similar documents are dealt into groups by their smallest shingle hash; a
   set of more than `LARGE` is split by a hash of the id.  Within a group all links are
   found, and joined to cells.
3. Each group's token union is stored, one row a group.  The matrix has a row
   (shingle, group) for each shingle in a prefix of the group.  A document asks the
   groups that hold a shingle of its prefix and a set of a size that can link.  It
   meets the group's union first, alone: only if their overlap reaches
   ceil(t * n) does the pair (document, group) qualify.  Members are shuffled to
   qualifying documents only.  Documents that ask one group are split into lots of
   `ASKERS`, and the group's row or members go to each lot.  Pairs already connected
   need no look: first each document asks, per shingle, only the group of the
   shingle's smallest component; after these links are joined, it asks every
   group that still holds another component (a large set's parts ask as a
   whole).  So all links between components are tried, and a group of thousands
   of near copies isn't opened pair by pair.

Result: per document the number of shingles and the smallest doc_id reachable.

Edge cases: null or blank text has no shingles and links with nothing; fewer
words than a shingle are one shingle; a very long text is one set (its size is the
text's); equal rows are linked; rows with one doc_id and several texts count as
linked; a null doc_id is its own component (null); columns but doc_id and text are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C
from loomwork.llm import exchange as X
from loomwork.llm.components import components

GROUP = 192
LARGE = 1024
ASKERS = 2048
_SETS = "node long, n long, tokens binary, prefix array<long>, low long, same string"


def _need(n, percent: int):
    """ceil(percent / 100 * n)"""
    return -(-n * percent // 100)


def _sets(table: pa.Table, k: int):
    for i, _, data, off in C.chunks(table.column("text")):
        yield from enumerate(C.shingle_sets(C.Words(C.lowered(data), off), k), i)


def _firsts(table: pa.Table, first: np.ndarray) -> pa.Table:
    """The rows that stand for their text: their id is among first, or null."""
    ids = table.column("node").to_pylist()
    node = np.array([-1 if x is None else x for x in ids], np.int64)
    at = np.minimum(np.searchsorted(first, node), max(0, len(first) - 1))
    keep = (first[at] == node) if len(first) else np.zeros(len(node), bool)
    return table.filter(pa.array(keep | np.array([x is None for x in ids], bool)))


def _counted(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [s for _, s in _sets(table, k)]
    keys = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    if not len(keys):
        return keys, np.empty(0, np.uint32)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.diff(np.append(new, len(keys))).astype(np.uint32)


def _total(group: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount(group, count, n), 255)[group]


def _described(table: pa.Table, count: np.ndarray, k: int, percent: int) -> pa.Table:
    keys = _counted(table, k)[0]
    ids, texts = table.column("node").to_pylist(), table.column("text").to_pylist()
    rows: dict[str, list] = {c: [] for c in ("same", "node", "n", "tokens", "prefix", "low")}
    for i, s in _sets(table, k):
        n = len(s)
        seen = count[np.searchsorted(keys, s)] if n else np.empty(0, np.uint8)
        shared = s[seen > 1]
        rows["same"].append(hashlib.md5(texts[i].encode()).hexdigest())
        rows["node"].append(ids[i])
        rows["n"].append(n)
        if n == 0 or len(shared) < _need(n, percent):
            for c in ("tokens", "prefix", "low"):
                rows[c].append(None)
            continue
        first = n - _need(n, percent) + 1 - (n - len(shared))
        order = np.argsort(seen[seen > 1], kind="stable")[:first]
        rows["tokens"].append(shared.tobytes())
        rows["prefix"].append(shared[order].view(np.int64))
        rows["low"].append(int(C.mix(shared).min().view(np.int64)))
    return pa.table({"node": pa.array(rows["node"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "tokens": pa.array(rows["tokens"], pa.binary()), "prefix": pa.array(rows["prefix"], pa.list_(pa.int64())), "low": pa.array(rows["low"], pa.int64()), "same": pa.array(rows["same"], pa.string())})


class _Group:
    """The members of one group: their sets, and the rows of the matrix that name it."""

    def __init__(self, table: pa.Table):
        self.node = table.column("node").to_pylist()
        self.size = table.column("n").to_numpy()
        self.comp = table.column("comp").to_pylist()
        self.sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.member = np.repeat(np.arange(len(self.sets)), list(map(len, self.sets)))[order]
        self.union = np.unique(self.tokens)

    def links(self, s: np.ndarray, n: int, percent: int, among: np.ndarray | None = None) -> np.ndarray:
        """Members that link with the set s of size n; nothing is opened when the union's overlap is too small."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        if not len(self.union) or (self.union[at] == s).sum() < _need(n, percent):
            return np.empty(0, np.int64)
        a, b = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        size = b - a
        lead = np.cumsum(size) - size
        pick = np.repeat(a - lead, size) + np.arange(int(size.sum()))
        both = np.bincount(self.member[pick], minlength=len(self.sets))
        return np.flatnonzero(100 * both >= percent * (n + self.size - both))


_LINKS = "a long, b long"


def _inside(table: pa.Table, percent: int) -> pa.Table:
    """Links within a group: to the first of those linked that is not yet in the same cell."""
    g = _Group(table)
    root = list(range(len(g.node)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i, s in enumerate(g.sets):
        for j in g.links(s, int(g.size[i]), percent).tolist():
            x, y = top(i), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(g.node[i])
                b.append(g.node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _union(table: pa.Table) -> pa.Table:
    """A group's token union."""
    tokens = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]))
    return pa.table({"group": table.column("group")[:1], "tokens": pa.array([tokens.tobytes()], pa.binary())})


def _qualified(union: pa.Table, asking: pa.Table, percent: int) -> pa.Table:
    """The asking documents whose overlap with a group's union can reach a link."""
    good = []
    if union.num_rows and asking.num_rows:
        tokens = np.frombuffer(union.column("tokens")[0].as_py(), np.uint64)
        for i, (n, cell) in enumerate(zip(asking.column("q_n").to_pylist(), asking.column("q_tokens").to_pylist(), strict=True)):
            s = np.frombuffer(cell, np.uint64)
            if (tokens[np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)] == s).sum() >= _need(n, percent):
                good.append(i)
    return asking.select(["q_node", "target", "q_lot"]).take(pa.array(good, pa.int64()))


def _opened(members: pa.Table, asking: pa.Table, percent: int) -> pa.Table:
    """Links of the asking documents with a group, one for each component linked."""
    a, b = [], []
    if members.num_rows and asking.num_rows:
        g = _Group(members)
        for node, n, comp, cell in zip(*(asking.column(f"q_{c}").to_pylist() for c in ("node", "n", "comp", "tokens")), strict=True):
            known = {comp}
            for j in g.links(np.frombuffer(cell, np.uint64), n, percent).tolist():
                if g.comp[j] not in known:
                    known.add(g.comp[j])
                    a.append(node)
                    b.append(g.node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open(sets: DataFrame, unions: DataFrame, asks: DataFrame, percent: int) -> DataFrame:
    """asks (node, target): documents meet the target's stored union, and those that qualify its members."""
    lots = asks.groupBy("target").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("lots"))
    asks = asks.join(lots, "target").select("node", "target", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int").alias("lot"))
    dealt = lots.select(F.col("target").alias("group"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    own = sets.select(*(F.col(c).alias(f"q_{c}") for c in ("node", "n", "comp", "tokens")))
    asking = asks.select(F.col("node").alias("q_node"), "target", F.col("lot").alias("q_lot")).join(own.drop("q_comp"), "q_node")
    bound = unions.join(dealt, "group").groupBy("group", "lot").cogroup(asking.groupBy("target", "q_lot"))
    good = C.stored(bound.applyInArrow(lambda u, q: _qualified(u, q, percent), "q_node long, target long, q_lot int"), "qualified")
    asking = good.join(own, "q_node")
    members = sets.select("node", "n", "comp", "tokens", "group").join(good.select(F.col("target").alias("group"), F.col("q_lot").alias("lot")).distinct(), "group")
    return members.groupBy("group", "lot").cogroup(asking.groupBy("target", "q_lot")).applyInArrow(lambda m, q: _opened(m, q, percent), _LINKS)


def _joined(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with components after these links."""
    ends = sets.select("node", "comp")
    comps = links.join(ends.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(ends.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    root = components(comps)
    return C.stored(ends.join(root.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comps")


def classes(docs: DataFrame, k: int = C.SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.md5("text").alias("same"))
    first = keyed.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"))

    to = X.layout(docs)
    batches = X.batched(docs.withColumnRenamed("doc_id", "node"), to, "node")
    chosen = X.packed(first.select("node", to.batch("node").alias("batch")), "node")
    count = X.exchange(batches, to.parts, lambda t, f: _counted(_firsts(t, f), k), _total, "uint32", "uint8", wide=False, given=(chosen,))
    described = C.stored(X.consume(batches, (chosen, count), lambda t, f, c: _described(_firsts(t, f), c, k, percent), _SETS), "sets")

    live = described.where("tokens is not null and node is not null")
    large = live.groupBy("low").count().where(F.col("count") > LARGE).select("low", F.ceil(F.col("count") / LARGE).alias("split"))
    lots = max(1, live.count() // GROUP)
    sets = live.join(large, "low", "left").withColumn(
        "group",
        F.when(F.col("split").isNull(), F.pmod(F.xxhash64("low"), F.lit(lots))).otherwise(F.xxhash64("low", F.pmod(F.xxhash64("node"), F.coalesce("split", F.lit(1))))),
    )
    sets = C.stored(sets.select("node", "n", "tokens", "prefix", "group", F.col("split").isNotNull().alias("whole")), "groups")

    inside = sets.withColumn("comp", F.col("node")).select("group", "node", "n", "comp", "tokens").groupBy("group").applyInArrow(lambda t: _inside(t, percent), _LINKS)
    comps = _joined(sets.select("node", F.col("node").alias("comp")), C.stored(inside, "links"))
    unions = C.stored(sets.select("group", "tokens").groupBy("group").applyInArrow(_union, "group long, tokens binary"), "unions")

    def matrix() -> DataFrame:
        """Prefix shingles that more than one component has."""
        rows = sets.join(comps, "node").select("node", "n", "group", "whole", "comp", F.explode("prefix").alias("token"))
        hub = rows.groupBy("token").agg(F.min(F.struct("comp", "group")).alias("hub"), F.max("comp").alias("last")).where("hub.comp <> last").select("token", "hub")
        return rows.join(hub, "token")

    star = matrix().where("comp <> hub.comp").select("node", F.col("hub.group").alias("target")).distinct()
    comps = _joined(comps, C.stored(_open(sets.join(comps, "node"), unions, C.stored(star, "asks"), percent), "links"))
    rest = C.stored(matrix().select("token", "node", "n", "group", "comp", "whole"), "matrix")
    span = (F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    cells = rest.groupBy("token", F.col("group").alias("target")).agg(*span)
    unit = F.when(~F.col("whole"), F.col("node"))
    units = rest.groupBy("token", "group", unit.alias("unit")).agg(*span)
    sizes = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    asks = units.join(cells.withColumnsRenamed({c: f"{c}2" for c in ("low", "high", "least", "most")}), "token").where("group < target and (low <> low2 or high <> high2 or low <> high)").where(sizes).select("unit", "group", "target").distinct()
    asks = C.stored(asks, "asks")
    members = sets.where("whole").select("node", "group")
    asks = asks.where("unit is not null").select(F.col("unit").alias("node"), "target").union(members.join(asks.where("unit is null"), "group").select("node", "target"))
    comps = _joined(comps, C.stored(_open(sets.join(comps, "node"), unions, C.stored(asks, "asks"), percent), "links"))

    per_text = described.select("same", "node", "n").join(comps, "node", "left").select("same", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component"))
    per_text = per_text.groupBy("same").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"))
    out = keyed.join(per_text, "same").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def kept(docs: DataFrame, k: int = C.SHINGLE, percent: int = 80) -> DataFrame:
    """docs without those whose class has a smaller doc_id.

    Of rows equal in doc_id and text one stays; different texts under one doc_id all
    stay if that is their class's smallest; rows with a null doc_id all stay.
    """
    rows = C.plain(docs, "doc_id", "text")
    reach = classes(rows, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    once = rows.where("doc_id is not null").withColumn("_same", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_same"]).drop("_same")
    return C.named(once.join(reach, "doc_id", "left_semi").select(rows.columns).unionByName(rows.where("doc_id is null")), docs)
