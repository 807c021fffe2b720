"""Whitening, the conversation trie and reversible line dedup against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from loomwork.llm import common as C
from loomwork.llm import conversation_trie as T
from loomwork.llm import line_dedup as D
from loomwork.llm import whitening as H


@pytest.fixture(scope="module", autouse=True)
def _sent(spark):
    C.importable(spark)


# ---------------------------------------------------------------- whitening


def brute(rows, k=16):
    x = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    a = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    out = []
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums)]
        w = np.array(d) / n @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, sum(y * y for y in d), float(w[c]), float(values[c] / values.sum())) for c in range(k)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, `a.b` string, component int"


def vectors(dims=20, n=150, seed=1):
    r = np.random.default_rng(seed)
    x = np.float32(r.normal(size=(n, dims)) * np.linspace(9, 1, dims) + r.normal(size=dims) * 50)
    rows = [(i, x[i].tolist()) for i in range(n)] + [(n + i, x[0].tolist()) for i in range(60)]
    return rows + [(7, x[3].tolist())]


def same_signs(got, want):
    """Both as {(id, deviation, component): whitened}, each component turned to agree."""
    flip = {}
    for (i, d, c), v in sorted(want.items()):
        if c not in flip and abs(v) > 0.1:
            flip[c] = np.sign(v) * np.sign(got[i, d, c])
    return {k: v * flip[k[2]] for k, v in got.items()}


def test_whitening_equals_eigenvectors(spark):
    rows = vectors()
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, []), (905, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows + odd], VECTORS).repartition(7)
    got = H.digest(df).collect()
    want = brute([*rows, (None, rows[5][1])])
    assert len(got) == len(want)
    key = lambda i: -1 if i is None else i
    have = {(key(r.vec_id), r.deviation, r.component): r.whitened for r in got}
    wanted = {(key(i), d, c): v for i, c, _, d, v, _ in want}
    assert have.keys() == wanted.keys()
    turned = same_signs(have, wanted)
    assert max(abs(turned[k] - wanted[k]) for k in wanted) < 1e-8
    share = {c: s for _, c, _, _, _, s in want}
    assert all(r.n == want[0][2] and abs(r.explained / share[r.component] - 1) < 1e-9 for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_few_dimensions_and_flat_ones(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v), 5.0, float(2 * v), float(w)]) for i, (v, w) in enumerate(r.integers(-30, 30, (40, 2)))]
    got = H.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x.component for x in got} == {1, 2} and len(got) == 80 and got[0].identity_error < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert H.digest(same).count() == 0
    none = spark.createDataFrame([], VECTORS)
    assert H.digest(none).count() == 0 and H.whitened(none).count() == 0


def test_whitening_of_huge_values_is_exact(spark):
    rows = [(i, [float(v), float(w)]) for i, (v, w) in enumerate([(1e9, 1.0), (-1e9, 2.0), (3e8, 3.0), (0.0, 5.0)])]
    got = H.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {i: d for i, _, _, d, _, _ in brute(rows)}
    assert {r.vec_id: r.deviation for r in got} == {k: d if d < 1 << 63 else None for k, d in want.items()}
    rows = [(i, [float(v), float(w)]) for i, (v, w) in enumerate([(3e6, 1.0), (-1e6, 2.0), (3e5, 3.0), (0.0, 5.0)])]
    got = H.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {i: d for i, _, _, d, _, _ in brute(rows)}
    assert max(want.values()) > 1 << 58 and {r.vec_id: r.deviation for r in got} == {k: d if d < 1 << 63 else None for k, d in want.items()}


def test_whitened_keeps_rows_and_columns(spark):
    rows = [(i, v, 1, "x", 2) for i, v in vectors()] + [(999, None, 1, "y", 2), (998, [float("nan")] * 20, 1, "y", 2)]
    out = H.whitened(spark.createDataFrame(rows, VECTORS).repartition(3), components=5)
    assert out.columns == ["vec_id", "embedding", "label", "a.b", "component", "whitened"]
    got = out.collect()
    assert len(got) == len(rows) and sum(r.whitened is None for r in got) == 2
    assert {len(r.whitened) for r in got if r.whitened is not None} == {5}
    fit = np.array(list({tuple(r.embedding): r.whitened for r in got if r.whitened is not None}.values()))
    assert np.abs(fit.T @ fit / len(fit) - np.eye(5)).max() < 1e-8


# ---------------------------------------------------------------- conversations


def nodes(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - int(math.fmod(c, 100))
        built[c] = turns.get(base, [])[:h] + t[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got_nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string, n_convs int, `a.b` int"


def conversations(seed=5, n=330):
    r = random.Random(seed)
    say = ["hello", "how are you", "Été çà", "", None, "x" * 50, "bye"]
    out = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 3, 4, 7, 9])):
            out.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", say[0] if not t and r.random() < 0.4 else r.choice(say)))
    out += [(c, t, "user", "copy") for c in range(1000, 1120) for t in range(3)]
    out += [(c, t, "user", f"deep {t}") for c in (2000, 2001, 2305) for t in range(300)] + [(2001, 300, "user", "more")]
    out += [(None, 0, "user", "no id"), (-7, 0, "user", "neg"), (-107, 1, "a", "neg"), (-107, 1, "a", "neg"), (-107, 1, "b", "tie"), (5000, 0, "user", "y" * 100_000)]
    r.shuffle(out)
    return out


def test_trie_against_brute_force(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], TURNS).repartition(5)
    want = nodes(rows)
    assert got_nodes(T.digest(df)) == want
    monkeypatch.setattr(T, "RANGE_ROWS", 16)  # more ranges, with shared prefixes across them
    assert got_nodes(T.digest(df)) == want
    assert got_nodes(T.prefixes(df)) == nodes(rows, rebuild=False)


def test_trie_of_small_tables(spark):
    assert T.digest(spark.createDataFrame([], TURNS)).count() == 0
    one = [(100, 0, None, None), (100, 1, "", "")]
    assert got_nodes(T.digest(spark.createDataFrame([(*x, 1, 2) for x in one], TURNS))) == nodes(one)


def test_lcp_and_loser_tree():
    r = random.Random(2)
    seqs = sorted({b"".join(bytes([r.choice([1, 2])]) * T.T for _ in range(r.randint(0, 12))) for _ in range(500)})
    for many in (1, 2, 3, 5, 8, 13):
        dealt = [[] for _ in range(many)]
        for s in seqs:
            r.choice(dealt).append(s)
        runs = [T.Run.read(T.Run.stored(d, [(bytes(len(s) // 2), 1, 0, "00" * 32) for s in d])) for d in dealt if d]
        out = list(T.merged(runs))
        assert [x[1] for x in out] == seqs
        assert [x[0] for x in out[1:]] == [T.lcp(a, b) for a, b in zip(seqs[:-1], seqs[1:], strict=True)]
    a = b"".join(i.to_bytes(16, "big") for i in range(100))
    assert [T.lcp(a, a[: 16 * k] + b"z" * 16) for k in (0, 1, 2, 3, 50, 99)] == [0, 1, 2, 3, 50, 99]


# ---------------------------------------------------------------- lines


SPACE = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return k if len(k) >= 10 else None


def lines(rows, known=None):
    """(doc_id, lines, dropped, kept) of rows; known: the documents of the index."""
    big = float("inf")
    first = {}
    for i, t in known if known is not None else rows:
        for line in (t or "").split("\n"):
            if key(line):
                first[key(line)] = min(first.get(key(line), big), big if i is None else i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (key(x) and first.get(key(x), big) < (big if i is None else i))]
        out.append((-1 if i is None else i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got_lines(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


DOCS = "doc_id long, text string, n_chars long, batch int, `a.b` string, part int"


def texts(seed=4, n=160, start=0):
    r = random.Random(seed)
    common = ["Read more about us", "  ALL rights reserved\t", "short", "123456789", "Ééééééééé", "Éééééééééé", "", "x" * 5000]
    rows = []
    for i in range(start, start + n):
        parts = [r.choice(common) if r.random() < 0.5 else f"line number {r.randrange(400)}" for _ in range(r.randint(0, 9))]
        rows.append((i, "\n".join(x.swapcase() if r.random() < 0.2 else x for x in parts) + ("\n" if r.random() < 0.3 else "")))
    return rows


ODD = [(5000, None), (5001, ""), (5002, "\n\n"), (None, "read more ABOUT us\nno id line one"), (None, "no id line one"), (None, None), (5003, "twice in one\ntwice in one"), (5004, "same id lines\nread more about us"), (5004, "same id lines"), (5004, "same id lines"), (5005, "same id lines\r\n\x0bSAME ID LINES\x0c"), (5006, "\n".join(f"long {i} document" for i in range(20000)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), 1, "x", 2) for i, t in rows], DOCS)


def test_lines_against_brute_force(spark):
    rows = texts() + ODD
    assert got_lines(D.digest(frame(spark, rows).repartition(6))) == lines(rows)
    none = frame(spark, [])
    assert D.digest(none).count() == 0 and D.deduped(none).count() == 0


def test_lines_keep_columns(spark):
    rows = texts() + ODD
    df = frame(spark, rows)
    out = D.deduped(df)
    assert out.columns == df.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert got == sorted((i, s) for i, _, _, s in lines(rows))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def counts(index):
    return sorted(tuple(r) for r in index.counts().collect())


def answers(index, keys):
    """Copies that the filters hold of each key."""
    held = {r.part: D.Cuckoo(np.frombuffer(r.filter, np.uint16).reshape(-1, 4)) for r in index.shards.collect()}
    h = np.array([int(k[:16], 16) for k in keys], np.uint64)
    part = (h >> np.uint64(64 - index.bits)).astype(int)
    return [int(held[p].count(D._short(h[i : i + 1], index.bits))[0]) if p in held else 0 for i, p in enumerate(part)]


def test_index_inserts_and_deletes(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_KEYS", 64)
    a, b, c = texts(1, 80), texts(2, 60, 1000) + ODD, texts(3, 50, 500)
    one = D.insert(None, frame(spark, a))
    two = D.insert(one, frame(spark, b))
    three = D.insert(two, frame(spark, c))
    assert three.bits >= one.bits
    whole = D.insert(None, frame(spark, a + b + c))
    assert counts(three) == counts(whole) and len(counts(whole)) > 300
    assert got_lines(D.digest(frame(spark, c), three)) == lines(c, a + b + c)
    assert got_lines(D.digest(frame(spark, a + b + c), three)) == lines(a + b + c)
    ids = frame(spark, b).select("doc_id").union(frame(spark, a[:10]).select("doc_id"))
    back = D.delete(three, ids)
    left = a[10:] + c
    plain = D.insert(None, frame(spark, left))
    assert counts(back) == counts(plain)
    assert got_lines(D.digest(frame(spark, left), back)) == lines(left)
    kept = {k: n for k, n, _ in counts(plain)}
    for k, n in zip(kept, answers(back, list(kept)), strict=True):
        assert n >= min(kept[k], 2)
    gone = [k for k, _, _ in counts(whole) if k not in kept]
    assert gone and sum(n > 0 for n in answers(back, gone)) <= 2
    again = D.insert(back, frame(spark, b + a[:10]))
    assert counts(again) == counts(whole)
    nothing = D.delete(back, frame(spark, left).select("doc_id"))
    assert counts(nothing) == [] and got_lines(D.digest(frame(spark, a), nothing)) == lines(a, [])


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 40, 20000, dtype=np.uint64))
    copies = r.integers(1, 3, len(keys))
    made = D.Cuckoo.of(keys, copies)
    assert made.cells.size < 4 * copies.sum() and (made.count(keys) >= copies).all()
    others = np.setdiff1d(r.integers(0, 1 << 40, 200000, dtype=np.uint64), keys)
    assert (made.count(others) > 0).mean() < 4e-4
    made.take(np.repeat(keys[:9000], copies[:9000]))
    assert (made.count(keys[9000:]) >= copies[9000:]).all() and (made.count(keys[:9000]) > 0).mean() < 4e-4
    assert made.put(np.repeat(keys[:9000], copies[:9000])) and (made.count(keys) >= copies).all()
    made.take(np.repeat(keys, copies))
    assert not made.cells.any()
    small = D.Cuckoo(np.zeros((4, 4), np.uint16))
    assert not small.put(keys[:40])
    assert D.Cuckoo.of(keys[:0], copies[:0]).count(keys[:3]).tolist() == [0, 0, 0]
