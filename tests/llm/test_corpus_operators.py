"""Corpus operators against brute force, on small documents with nulls, empty and long texts, copies, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from loomwork.llm import common as C
from loomwork.llm import fingerprints, jaccard_join, language_model, licenses, mixing, neighbours, pieces, quality, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch int, part int, size long, node long"


def make(seed=3, n=90):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "ÇA", "naïve"]
    passage = " ".join(r.choice(words) for _ in range(70))
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 160))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        text = r.choice(base)
        parts = text.split()
        kind = i % 6
        if kind == 1 and len(parts) > 20:
            parts[r.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        if kind == 2:
            text = text.upper().replace(" ", "\n\t ")
        if kind == 3:
            text = " ".join(parts[:10] + [passage] + parts[10:])
        rows.append((i * 3, text, "en", f"s{i % 4}" if i % 7 else None, len(text), 1, 2, 3, 4))
    rows += [(1000, None, None, "s0", None, 0, 0, 0, 0), (1001, "", "en", "s0", 0, 0, 0, 0, 0), (1002, " \n ", "en", None, 3, 0, 0, 0, 0), (1003, "one", "en", "s1", 3, 0, 0, 0, 0)]
    rows += [(1004, " ".join(r.choice(words) for _ in range(6000)), "en", "s1", 1, 0, 0, 0, 0), (1005, "x" * 9000 + " y", "en", "s2", 9002, 0, 0, 0, 0)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    C.importable(spark)
    return spark.createDataFrame(make(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return sorted((i, t or "") for i, t, *_ in make())


def lower(t):
    return bytes(c | 32 if 65 <= c <= 90 else c for c in t.encode())


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_word_hashes_and_rolling():
    w = C.Words(*C.buffers(pa.array(["ab c", None, "", " x", "y z ", " q"])))
    assert w.first.tolist() == [0, 2, 2, 2, 3, 5, 6]
    assert len(set(w.hash.tolist())) == 6
    h = np.arange(40, dtype=np.uint64)
    for k in (1, 2, 7, 25, 40):
        want = [sum(int(v) * pow(C.ROLL, k - 1 - j, 1 << 64) for j, v in enumerate(h[i : i + k])) % (1 << 64) for i in range(40 - k + 1)]
        assert C.rolling(h, k).tolist() == want


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprints.edited_report(docs).collect()}
    all_ = texts()
    assert len(got) == len(all_)
    errors = []
    for k, (i, t) in enumerate(all_):
        u = all_[(k + 1) % len(all_)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + u[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t.encode().split()), shingles(edited.encode().split())
        errors.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.03
    by_text = collections.defaultdict(set)
    for i, t in all_:
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_report(none).count() == 0


def test_fingerprint_estimate_is_unbiased():
    maker = fingerprints.Fingerprinter()
    r = np.random.default_rng(1)
    for size, shared in ((40, 20), (3000, 2400)):
        errors = []
        for _ in range(60):
            x = r.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64) * np.uint64(2)
            errors.append(maker.likeness(*(maker.of_shingles(np.sort(v)) for v in (x[:size], x[-size:]))) - shared / (2 * size - shared))
        assert abs(np.mean(errors)) < 0.03


def test_substring_dedup(docs, none):
    first = {}
    for i, t in texts():
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r.doc_id: r for r in substring_dedup.digest(docs).collect()}
    cut = 0
    for i, t in texts():
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        cut += sum(gone)
    assert cut > 500
    clean = substring_dedup.cleaned(docs.drop("batch", "part"))
    assert clean.columns == docs.drop("batch", "part").columns and clean.count() == docs.count()
    assert substring_dedup.digest(none).count() == 0


def components_of(rows):
    sets = {i: shingles(lower(t).split()) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_join(docs, none):
    want = components_of(texts())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect()} == want
    kept = jaccard_join.kept(docs.drop("batch", "part", "node"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    assert jaccard_join.classes(none).count() == 0


def test_jaccard_join_splits_large_groups(spark, monkeypatch):
    """Small group sizes, so that near copies fall into many groups and links cross them."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "LARGE", 6)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(60)] = f"e{r.randrange(6)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_mixing(docs, none):
    got = {r.doc_id: r for r in mixing.digest(docs).collect()}
    size = {i: len((t or "").encode().split()) for i, t, *_ in make()}
    source = {i: s for i, _, _, s, *_ in make()}
    tokens = collections.Counter()
    for i, n in size.items():
        tokens[source[i]] += n
    names = sorted((s for s in tokens if s is not None), key=lambda s: s.encode()) + ([None] if None in tokens else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(tokens.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * tokens[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * tokens[s]
            rest -= target[s]
        open_ -= over
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == tokens[source[i]] and r.taken <= 2 * r.size
        assert abs(r.target - target[source[i]]) < 1e-6
    assert got == {r.doc_id: r for r in mixing.digest(docs.repartition(5)).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    count = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(count[i] * size[i] == r.taken for i, r in got.items())
    assert mixing.digest(none).count() == 0


def test_licences(spark, docs, none):
    model = licenses.LicenceModel()
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    assert all(model.predict(f"This file is {t}.")[3] for t in lines)
    assert not any(model.predict(t)[3] for t in licenses.NEGATIVE)
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    apache = "Licensed under the\nApache License,\nVersion 2.0 (the \"License\")"
    wrapped = [(10, "x\n\n" + gpl.format(3)), (11, gpl.format(2) + "\n\ny"), (12, apache), (13, "Licensed under the\n\nApache"), (14, " ".join(["word"] * 20_000) + " released under the MIT license"), (None, apache)]
    got = sorted(((r.doc_id or 0), r.n_lines, tuple(r.families)) for r in licenses.scan(spark.createDataFrame(wrapped, "doc_id long, text string"), model).collect())
    assert got == [(0, 1, ("apache-2.0",)), (10, 1, ("gpl-3.0",)), (11, 1, ("gpl-2.0",)), (12, 1, ("apache-2.0",)), (13, 0, ()), (14, 1, ("mit",))]
    rows = [(1, "a b\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (2, None), (3, "the license plate"), (4, ""), (4, "Licensed under CC BY-NC 4.0.\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, tuple(r.families)) for r in licenses.scan(df, model).collect())
    assert got == [(1, 2, ("apache-2.0", "mit")), (2, 0, ()), (3, 0, ()), (4, 0, ()), (4, 3, ("cc-by-nc-4.0",))]
    for r in licenses.paragraphs(df, model).collect():
        text = next(t for i, t in rows if i == r.doc_id and t)
        want = model.predict(" ".join(text.split("\n")[r.line : r.line + r.lines]))
        assert r.family == want[0] and abs(r.probability - want[1]) < 1e-6 and abs(r.coverage - want[2]) < 1e-9 and r.confirmed == want[3]
    assert licenses.scan(none, model).count() == 0


def test_pieces_equal_the_library(docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.PieceModel(pieces.load())
    r = random.Random(2)
    odd = ["", " ", "  a", "a\n\n b", "\x00a", "▁x y", "中文没有空格" * 60, "😀 é́", "=" * 150, " " * 50 + "x", "\t\tif (x) {\n}"] + ["".join(r.choice("abeinrst  \n中é😀=_-") for _ in range(r.randint(1, 200))) for _ in range(60)]
    assert [x.tolist() for x in model.encode([t.encode() for t in odd])] == library.encode(odd)
    got = {x.doc_id: x for x in pieces.encoded(docs).collect()}
    for i, t, *_ in make():
        assert got[i].tokens == (None if t is None else library.encode(t)) and got[i].round_trip in (True, None)
    back = {x.doc_id: x.text for x in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back == {i: t for i, t, *_ in make()}
    assert pieces.encoded(none).count() == 0


def sample(n, seed, bad=("idiot", "scumbag", "scumling")):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("la", "mo", "nu", "pe", "ri", "sa", "to")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        junk = i % 4 == 0
        text = " ".join(x.upper() + "!!" if junk else x for x in w)
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    C.importable(spark)
    rows, labels = sample(900, 1)
    df, lab = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (7000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(df, lab).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert 0 <= got[5000].score <= 1 and got[5000].score == got[5001].score
    assert toxicity.digest(df, lab.where("toxic = 0")).where("score <> 0").count() == 0
    assert toxicity.digest(df.limit(0), lab).count() == 0
    assert toxicity.kept(df, lab).columns == df.columns


def test_toxicity_probabilities_equal_a_plain_model():
    """The counts by dictionaries, P_c along the prefixes in plain Python; mass of known and unknown continuations is 1."""
    rows, labels = sample(60, 4)
    train = [(t, y) for (_, t), (_, _, y) in zip(rows, labels, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in train]), pa.array([y for _, y in train], pa.int32())], ["text", "toxic"])
    found = pa.Table.from_batches(list(toxicity._nodes([batch]))).group_by(["node", "up", "word"]).aggregate([("n0", "sum"), ("n1", "sum")])
    top = found.filter(pa.compute.equal(found["up"], int(toxicity._ROOT.view(np.int64))))
    root = (sum(top["n0_sum"].to_pylist()), sum(top["n1_sum"].to_pylist()), top.num_rows)
    per = found.group_by(["node", "up"]).aggregate([("n0_sum", "sum"), ("n1_sum", "sum"), ("word", "count")])
    per = per.filter(pa.compute.greater_equal(pa.compute.add(per["n0_sum_sum"], per["n1_sum_sum"]), 3))
    col = lambda c: per[c].to_numpy()
    model = toxicity.KneserNey(col("node").view(np.uint64), col("up").view(np.uint64), col("n0_sum_sum"), col("n1_sum_sum"), col("word_count"), root)

    word_re = re.compile("[a-z0-9\x80-\xff]+")
    chain = lambda w: [*(w[:n] for n in toxicity.LENGTHS if len(w) >= n), w + "$"]
    n, below = collections.Counter(), collections.defaultdict(set)
    for t, y in train:
        for w in word_re.findall(t.lower()):
            for x in ["", *chain(w)]:
                n[x, y] += 1
                below[x].add(w)
    kept = {x for x in below if n[x, 0] + n[x, 1] >= 3}
    children = collections.defaultdict(set)
    for t, _ in train:
        for w in word_re.findall(t.lower()):
            for h, x in zip(["", *chain(w)], chain(w)):
                children[h].add(x)

    def rest(h, c):
        return 1 - sum(max(n[x, c] - toxicity.D, 0) for x in children[h] & kept) / n[h, c] if n[h, c] else 1.0

    def prob(x, h, c):
        shared = len(below[x]) / len(below[h])
        return max(n[x, c] - toxicity.D, 0) / n[h, c] + rest(h, c) * shared if n[h, c] else shared

    for h in [h for h in kept if h[-1:] != "$"][:80]:
        for c in (0, 1):
            known = children[h] & kept
            unknown = rest(h, c) * (1 - sum(len(below[x]) for x in known) / len(below[h]))
            assert abs(sum(prob(x, h, c) for x in known) + unknown - 1) < 1e-9
    for w in [*sorted({w for t, _ in train for w in word_re.findall(t.lower())})[:60], "zzz", "idi", "scumlike", "b"]:
        want, h = 0.0, ""
        for x in chain(w):
            if x not in kept:
                want += math.log(rest(h, 1) / rest(h, 0))
                break
            want, h = want + math.log(prob(x, h, 1) / prob(x, h, 0)), x
        words = next(toxicity._words(pa.array([w])))[2]
        assert abs(model.of_words(words, np.array([0]))[0] - want) < 1e-4
        e = 0.01
        assert abs(model.differences(words, (e,))[0, 0] - math.log(1 - e + e * math.exp(want))) < 1e-4


def test_quality(spark):
    C.importable(spark)
    rows, labels = sample(600, 2)
    df, lab = spark.createDataFrame([*rows, (5000, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.digest(df, lab).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].selected == labels[i][1] for i in held]) > 0.97
    assert quality.digest(df, lab.limit(0)).where("selected is not null").count() == 0
    assert quality.digest(df.limit(0), lab).count() == 0


def test_ordinal_fit_recovers_weights_and_ordered_cuts():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    y = np.digitize(x @ [1, -2, 0.5] + r.logistic(size=4000), [-1, 1, 2])
    i, j = np.nonzero(np.ones_like(x))
    m = quality.train(i, j, x[i, j], y, 3)
    assert np.abs(m.weights - [1, -2, 0.5]).max() < 0.2 and np.abs(m.cuts - [-1, 1, 2]).max() < 0.2
    assert (np.diff(m.tails(np.array([0.3]))[0]) < 0).all()


def test_language_model(docs, none):
    got = {r.doc_id: r for r in language_model.likelihoods(docs).collect()}
    tokens = {i: [*lower(t).split(), None] for i, t in texts()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert language_model.likelihoods(none).count() == 0


def test_language_model_learns_from_all_texts(spark):
    words = ["ka", "lo", "mi", "nu", "pe", "ri"]
    rows = [(i, " ".join(words[(i + j) % 6] for j in range(1500))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in language_model.likelihoods(df).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_language_model_gradients_and_batched_scores():
    v = language_model.Vocabulary(np.arange(1, 60, dtype=np.uint64) * np.uint64(999), np.arange(1, 60)[::-1], np.ones(language_model.TAILS), np.ones(language_model.TAILS), 5)
    m = language_model.GRU(v)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    r = np.random.default_rng(0)
    x, y, live = r.integers(0, v.n_inputs, (6, 3)), r.integers(0, v.n_inputs, (6, 3)), np.ones((6, 3))
    live[3, 1] = 0
    h = np.zeros((3, language_model.HIDDEN))
    g = m.gradients(x, y, live, h)[0]
    for k in m.NAMES:
        at = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        keep, loss = m.p[k][at], []
        for e in (1e-5, -1e-5):
            m.p[k][at] = keep + e
            loss.append(m.gradients(x, y, live, h)[2])
        m.p[k][at] = keep
        assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-7
    texts_ = [r.integers(0, v.stop, n) for n in (0, 5, 300, 17)]
    assert np.allclose(m.score(texts_), [m.score([t])[0] for t in texts_])
    one = m.score([np.array([], np.int64)])[0]
    heads = [m.score([np.array([i])])[0] for i in range(v.stop)]
    assert one < 0 and all(s < 0 for s in heads)


def test_neighbours(spark):
    C.importable(spark)
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[700:730] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for q in neighbours.nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
        assert [(-v, i) for i, v in got[q]] == sorted((-v, i) for i, v in got[q])
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
    assert set(got) == set(range(0, 1500, 20)) and hit / (75 * 20) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(q.rank, q.vec_id) for q in neighbours.nearest(few, "vec_id % 20 = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_neighbours_search_goes_on_until_nothing_is_left(spark):
    C.importable(spark)
    n = 400
    each = spark.createDataFrame([(i, [math.cos(i / n), math.sin(i / n)]) for i in range(n)], "vertex long, x array<double>")
    links = spark.createDataFrame([(i, neighbours._pack(np.array([j for j in (i - 1, i + 1) if 0 <= j < n]), np.zeros(2 - (i in (0, n - 1))))) for i in range(n)], "vertex long, near binary")
    found = neighbours.search(links, each, each.where("vertex = 200").select("vertex"), 2, beam=20)
    assert set(np.frombuffer(found.first()["ids"], np.int64)[:19].tolist()) == set(range(191, 210))
    assert neighbours.recall(found, each, 2, 19) == 1.0


EDGE = "doc_id long, text string, lang string, source string, n_chars long, batch int, part int, size long, node long, toxicity double, _toxicity int, tail int, expected_grade int, fingerprint int, tokens int, same int, lot int, target int, grade int, rate int, `a.b` int, `c``d e` int"


def edge_rows():
    """Null and repeated ids, repeated rows, one id with two texts, null, empty, blank and very long texts, ties; every column clashes with some inner name."""
    long_ = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(None, "no id here", None), (None, None, "s"), (None, "no id here", None), (7, "alpha beta gamma delta epsilon zeta", "s"), (7, "alpha beta gamma delta epsilon zeta", "s"), (7, "one two three four five six", "s"), (8, None, "s"), (9, "", None), (10, " \n\t ", "s"), (11, long_, "t"), (12, long_ + " end", "t"), (13, "x" * 200_000, "t"), (14, "alpha beta gamma delta epsilon zeta", None), (1 << 60, "far", "s")]
    return [(i, t, "en", s, len(t or ""), *[1] * 4, 0.5, *[1] * 12) for i, t, s in rows]


@pytest.fixture(scope="module")
def edge(spark):
    C.importable(spark)
    return spark.createDataFrame(edge_rows(), EDGE).repartition(2)


def test_neighbours_of_repeated_ids_against_brute_force(spark):
    """Ids with several vectors, repeated rows, unusable vectors, and columns that clash with inner names."""
    C.importable(spark)
    r = np.random.default_rng(12)
    rows = [(int(i), [float(v) for v in r.normal(size=8)]) for i in range(700)]
    rows += [(i % 40, [float(v) for v in r.normal(size=8)]) for i in range(120)] + rows[:30] + [(i, rows[5][1]) for i in range(800, 860)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows + odd], "vec_id long, embedding array<double>, vertex int, `a.b` int, x double").repartition(3)
    found = neighbours.nearest(df, "vec_id % 20 = 0", k=10)
    got = collections.defaultdict(list)
    for row in sorted(found.collect(), key=lambda row: row["rank"]):
        got[row.query_id].append((row.vec_id, row.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = whole = 0
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        best = {}
        for v in x[ids == q]:
            for i, s in zip(ids.tolist(), (x @ v).tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -9e9), s)
        want = sorted(best.items(), key=lambda t: (-round(t[1], 9), t[0]))[:10]
        assert len(got[q]) == 10 and len({i for i, _ in got[q]}) == 10
        assert all(abs(best[i] - s) < 1e-9 for i, s in got[q])
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        whole += 10
    assert set(got) == {i for i, _ in rows if i % 20 == 0} and hits / whole > 0.95


def test_edge_cases_of_digests(spark, edge):
    n, ids = len(edge_rows()), collections.Counter(r[0] for r in edge_rows())
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0), "x") for i in (7, 8, 9, 10, 11, 12, 13, 14)] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    jobs = {
        "op1": lambda d: fingerprints.edited_report(d), "op2": lambda d: substring_dedup.digest(d), "op3": lambda d: jaccard_join.classes(d), "op4": lambda d: licenses.scan(d), "op5": lambda d: mixing.digest(d),
        "op6": lambda d: language_model.likelihoods(d), "op7": lambda d: pieces.encoded(d), "op8": lambda d: toxicity.digest(d, labels), "op9": lambda d: quality.digest(d, labels),
    }
    got = {k: f(edge).collect() for k, f in jobs.items()}
    for k, rows in got.items():
        assert collections.Counter(r.doc_id for r in rows) == ids and len(rows) == n, k
    removed = {r.doc_id: r.n_removed for r in got["op2"] if r.doc_id in (11, 12)}
    assert removed == {11: 0, 12: 30_000}
    links = {r.doc_id: r.component_id for r in got["op3"]}
    assert links[14] == 7 and links[12] == 11 and links[None] is None and links[9] == 9
    assert sorted(r.n_tokens for r in got["op6"] if r.doc_id in (8, 9, 10)) == [1, 1, 1]
    assert {r.tokens is None for r in got["op7"] if r.doc_id == 8} == {True} and {len(r.tokens) for r in got["op7"] if r.doc_id == 9} == {0}
    assert len({r.score for r in got["op8"] if r.doc_id in (8, 9, 10)}) == 1
    for k, f in jobs.items():
        assert f(edge.limit(0)).count() == 0, k


def test_edge_cases_of_tables_with_clashing_columns(spark, edge):
    """Operators that return the table itself keep its columns and rows."""
    rows = edge_rows()
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 15)], "doc_id long, toxic int")
    clean = substring_dedup.cleaned(edge)
    assert clean.columns == edge.columns and clean.count() == len(rows) and clean.schema == edge.schema
    fine = toxicity.kept(edge, labels)
    assert fine.columns == edge.columns and fine.count() <= len(rows)
    kept = jaccard_join.kept(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted([(0, "no id"), (0, ""), (0, "no id"), (7, "alpha"), (7, "one t"), (8, ""), (9, ""), (10, " \n\t "), (11, "w0 w1"), (13, "xxxxx"), (1 << 60, "far")])
    mixed = mixing.mixed(edge)
    assert mixed.columns == edge.columns
    assert set(fingerprints.fingerprints(edge).columns) == set(edge.columns)
    grades = quality.rated(edge, spark.createDataFrame([(i, i % 3) for i in range(7, 15)], "doc_id long, grade int"), at_least=2)
    assert set(grades.columns) == set(edge.columns) and grades.where("tail between 0 and 1 and expected_grade between 0 and 2").count() == len(rows)
    assert toxicity.scored(edge, labels, "tail").columns.count("tail") == 1


def test_fingerprint_lots_of_large_ids(spark):
    C.importable(spark)
    for far in (0, 1 << 60):
        rows, parts = fingerprints.with_next(spark.createDataFrame([(far + i * 1001, f"t {i}") for i in range(400)], "doc_id long, text string"))
        assert rows.select("lot").distinct().count() >= 4 * C.n_shuffle(spark) and parts >= 1


def test_exchange_layout_grows_with_the_root():
    from loomwork.llm import exchange as X

    gb = 1 << 30
    cells = lambda n: X.Layout(n, n // 2000, 64).batches * X.Layout(n, n // 2000, 64).parts
    assert cells(256 * gb) <= 512 * cells(gb) and X.Layout(50 << 20, 50_000, 211).batches == 50_000 // X.LEAST_ROWS
    assert X.Layout(0, 0, 8).batches == 1


def test_quality_grades_against_a_plain_model(spark):
    """Three grades through `rated`: tails and expected grades equal a plain sum over the words' features."""
    C.importable(spark)
    r = random.Random(6)
    texts_ = [(i, " ".join(r.choice(["good", "fine", "bad"][g : g + 1] + ["ka", "lo", "mi"]) for _ in range(30))) for i in range(400) for g in [i % 3]]
    df, marks = spark.createDataFrame(texts_, "doc_id long, text string"), spark.createDataFrame([(i, 2 - i % 3) for i, _ in texts_], "doc_id long, grade int")
    model = quality.fit(df, marks)
    got = {x.doc_id: x for x in quality.rated(df, marks, at_least=2).collect()}
    bits = (len(model.weights) - quality._DENSE).bit_length() - 1
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    for i, t in texts_[:40]:
        w, kinds, dense = next(quality._texts(pa.array([t]), bits))
        z = sum(model.weights[int(k[j])] for k in kinds for j in range(len(w))) / len(w) + float(dense[0] @ model.weights[-quality._DENSE :])
        tails = [1 / (1 + math.exp(c - z)) for c in model.cuts]
        assert abs(got[i].tail - tails[1]) < 1e-6 and abs(got[i].expected_grade - sum(tails)) < 1e-6
    held = [i for i, _ in texts_ if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([round(got[i].expected_grade) == 2 - i % 3 for i in held]) > 0.95


def test_language_model_score_equals_a_plain_loop():
    """ln P of a text, token by token, with the recurrent step, class and word softmax written out."""
    L = language_model
    v = L.Vocabulary(np.arange(1, 90, dtype=np.uint64) * np.uint64(77), np.arange(1, 90)[::-1], np.arange(1, L.TAILS + 1), np.ones(L.TAILS), 9)
    m = L.GRU(v)
    r = np.random.default_rng(3)
    m.p = {k: (x + r.normal(0, 0.1, x.shape) * (x > -1e8)).astype(np.float64) for k, x in m.p.items()}
    sig = lambda a: 1 / (1 + np.exp(-a))
    for text in ([], [3], r.integers(0, v.stop, 40).tolist()):
        h, x, total, n = np.zeros(L.HIDDEN), v.stop, 0.0, L.HIDDEN
        for y in [*text, v.stop]:
            g, q = m.p["inp"][x], h @ m.p["rec"]
            z, reset = sig(g[:n] + q[:n]), sig(g[n : 2 * n] + q[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + reset * q[2 * n :])
            logit, c = h @ m.p["out"] + m.p["out_b"], int(v.classes(np.array([y]))[0])
            total += logit[c] - math.log(sum(math.exp(a) for a in logit))
            if c < v.n_head:
                word = h @ m.p["word"][c] + m.p["word_b"][c]
                total += word[v.slot[y]] - math.log(sum(math.exp(a) for a in word))
            x = y
        assert abs(m.score([np.array(text, np.int64)])[0] - total) < 1e-4


def test_language_model_beats_the_base_on_held_out_texts(spark):
    C.importable(spark)
    r = random.Random(8)
    follow = {w: [r.choice(range(60)) for _ in range(3)] for w in range(60)}
    rows = []
    for i in range(300):
        w, out = r.randrange(60), []
        for _ in range(300):
            w = r.choice(follow[w])
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    got = [x for x in language_model.likelihoods(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    n = sum(x.n_tokens for x in got)
    assert sum(x.score for x in got) / n > sum(x.base_score for x in got) / n + 0.3


def test_language_model_does_not_depend_on_partitions(spark):
    """The same documents under few and many shuffle partitions, and in another order of rows."""
    C.importable(spark)
    r = random.Random(21)
    words = [f"v{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(1, 400)))) for i in range(1500)], "doc_id long, text string")
    assert language_model.n_shards(df.agg({"text": "count"}).first()[0]) == 1 and language_model.n_shards(864 << 20) == 144 and language_model.n_shards(25 << 20) == 16
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (3, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append({x.doc_id: x.score for x in language_model.likelihoods(df.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][i], got[1][i], rel_tol=1e-5) for i in got[0])


def test_neighbours_are_all_found_among_near_copies_and_lengths_far_apart(spark):
    """Tight groups that no link leaves, lengths from 1e-3 to 1e4 and more ties than answers: every neighbour is found."""
    C.importable(spark)
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 12))
    x = np.repeat(centres, 60, axis=0) + 1e-7 * r.normal(size=(2400, 12))
    x[::3] *= 10.0 ** r.integers(-3, 4, (800, 1))
    x[7] *= 1e4
    x = np.concatenate((x, x[:200], np.eye(12)[r.integers(0, 12, 300)] * np.repeat([1.0, 2.0], 150)[:, None]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for q in neighbours.nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert set(got) == set(range(0, len(x), 20))
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        best = np.sort(s)[::-1][:20]
        assert np.allclose([v for _, v in got[q]], best, rtol=1e-12, atol=0) and len({i for i, _ in got[q]}) == 20
        assert all(abs(s[i] - v) <= 1e-12 * abs(v) for i, v in got[q])


def test_exact_check_keeps_what_reaches_the_floor():
    r = np.random.default_rng(2)
    x, q = r.normal(size=(5000, 6)), r.normal(size=(30, 6))
    x[100:4000] = x[100] + 1e-9 * r.normal(size=(3900, 6))
    names = r.permutation(5000).astype(np.int64)
    s = q @ x.T
    want = [np.lexsort((names, -a))[:25] for a in s]
    for floor in (np.full(30, -np.inf), np.sort(s, 1)[:, -25] - 1e-9, np.full(30, 1e9)):
        row, ids, near = neighbours._reached(names, x, q, floor, 25, wide=700, high=7)
        for i in range(30):
            assert ids[row == i].tolist() == (names[want[i]].tolist() if floor[i] < 1e9 else [])
            assert np.allclose(near[row == i], s[i, want[i]][: (row == i).sum()], rtol=1e-12)


def test_word_hashes_at_their_place_in_the_text_and_distinct_values():
    """Words are hashed as one by one from place 0, by either way; distinct is np.unique."""
    col = pa.chunked_array([pa.array(["", None, " a\tbc  bc ", "é ü a", " \n", "z" * 4096, "q"])])
    for far in ("", "y" * 5000):
        data, off = C.buffers(pa.concat_arrays([*col.chunks, pa.array([far])]))
        w = C.Words(data, off)
        for a, b, h in zip(w.start, w.end, w.hash, strict=True):
            x = 0
            for i, c in enumerate(data[a:b].tolist()):
                x += int(C._BYTE[c]) * int(C._LOW[i & 4095]) * (int(C._HIGH[i >> 12]) if b - a > 4096 else 1)
            assert int(h) == int(C.mix(np.array([(x + int(b - a)) & (2**64 - 1)], np.uint64))[0])
    for x in (w.hash, np.array([5, 1, 5, 1 << 63, 0], np.uint64), np.empty(0, np.uint64)):
        for got, want in zip(C.distinct(x), np.unique(x, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()
