"""Order statistics, two-level sums, tiles, run-length masks, pictures, paired shards, epochs and buffers against plain models."""

import glob
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import grounding as G
from loomwork.operators import imaging as I
from loomwork.operators import labels as L
from loomwork.operators import metrics as M
from loomwork.operators import ranks
from loomwork.operators import retrieval as R
from loomwork.operators import splits as P
from loomwork.operators import stats as S
from loomwork.sources import paired, pictures, readers, sinks
from loomwork.streaming import buffers, resume


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


# ------------------------------------------------------------ order statistics


def test_quota_by_refined_prefixes(spark):
    import hashlib

    rows = [(i, "hot") for i in range(3000)] + [(i, f"c{i % 7}") for i in range(300)] + [(5, "twice")] * 4 + [(9, "none")]
    quota = {"hot": 1234, "c0": 10, "c1": 0, "c2": 10_000, "c3": 43, "twice": 2}
    df = spark.createDataFrame(rows, "doc_id long, name string").repartition(5)
    quotas = spark.createDataFrame(list(quota.items()), "name string, quota int")
    code = lambda i, n: hashlib.sha1(f"42|{i}|{n}".encode()).hexdigest()
    want = []
    for name, q in quota.items():
        want += sorted((r for r in rows if r[1] == name), key=lambda r: (code(*r), r[0]))[:q]
    for limits in ({}, {"digits": 1, "most": 5}):
        got = L.within_quota(df, quotas, **limits)
        assert got.columns == df.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        flags = L.quota_flags(df, quotas, **limits).collect()
        assert len(flags) == len(rows) and sum(r.chosen for r in flags) == len(want)
    assert L.within_quota(df.limit(0), quotas).count() == 0 and L.within_quota(df, quotas.limit(0)).count() == 0


def test_no_window_holds_a_concept(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("name"))
    out = L.quota_flags(rows, spark.createDataFrame([("hot", 1000)], "name string, quota int"))
    ranked = out.where("chosen is not null")
    assert ranked.where("chosen").count() == 1000
    # only the border's rows, of one prefix in 65,536, reach the window
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_turn" in plan


def test_exact_quantiles(spark):
    r = random.Random(7)
    rows = [("hot", r.gauss(0, 1)) for _ in range(2000)] + [("flat", 3.5)] * 500 + [("two", float(i % 2)) for i in range(101)] + [("one", -7.0), (None, 4.0), (None, 6.0), ("wide", -1e308), ("wide", 1e308), ("wide", 0.0)]
    odd = [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows + odd, "k string, v double").repartition(4)
    shares = (0.0, 0.01, 0.5, 0.77, 0.99, 1.0)
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for n, v in rows if n == k)
        for s in shares:
            p = s * (len(values) - 1)
            a, b = values[math.floor(p)], values[math.ceil(p)]
            want[k, s] = a if a == b else a + (b - a) * (p - math.floor(p))
    for limits in ({}, {"bins": 16, "most": 20}):
        got = {(x.k, x.share): x.quantile for x in ranks.quantiles(df, ["k"], "v", shares, **limits).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)
    whole = ranks.quantiles(df.where("k = 'hot'"), [], "v", (0.5,)).collect()
    assert len(whole) == 1 and math.isclose(whole[0].quantile, want["hot", 0.5])
    assert ranks.quantiles(df.limit(0), ["k"], "v", (0.5,)).count() == 0
    spread = {x.k: x for x in S.spread(df.where("not isnan(v) and abs(v) < 1e300"), ["k"], "v").collect()}
    assert math.isclose(spread["hot"].q1, want["hot", 0.01]) and spread[None].q99 == pytest.approx(want[None, 0.99])


def test_running_sums_of_one_key_are_dealt(spark):
    rows = spark.range(5000).select(F.lit("all").alias("k"), (F.col("id") * 7 % 5000 / 10).alias("score"), (F.col("id") % 3).alias("n")).unionByName(spark.createDataFrame([(None, 1.5, 2), ("b", 1.0, 5), ("b", 2.0, 6)], "k string, score double, n long"))
    out = ranks.running(rows, ["k"], "score", ["n"])
    total, want = 0, {}
    for r in sorted((r for r in rows.collect() if r.k == "all"), key=lambda r: -r.score):
        total += r.n
        want[r.score] = total
    got = out.collect()
    assert {r.score: r.n_upto for r in got if r.k == "all"} == want and {r.n_all for r in got if r.k == "all"} == {total}
    assert sorted((r.score, r.n_upto, r.n_all) for r in got if r.k == "b") == [(1.0, 11, 11), (2.0, 6, 11)]
    assert [(r.n_upto, r.n_all) for r in got if r.k is None] == [(2, 2)]
    sizes = [r["count"] for r in rows.repartitionByRange(4, "k", F.desc("score")).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2500
    y = rows.where("k = 'all'").select("k", "score", (F.col("n") > 0).cast("int").alias("y"))
    plain = sorted(((r.score, r.y) for r in y.collect()), reverse=True)
    pos = sum(v for _, v in plain)
    seen = above = 0
    for _, v in plain:
        seen += v
        above += seen * (1 - v)
    assert math.isclose(M.ranking(y, ["k"]).first().auroc, above / (pos * (len(plain) - pos)), rel_tol=1e-12)


# ------------------------------------------------------------ tiles


def test_tiles_are_sized_by_bytes(spark):
    r = np.random.default_rng(4)
    bank = [("a" if i % 5 else "b", i, f"text {i % 90}" + ("y" * 20_000 if i == 3 else ""), r.normal(size=6).tolist()) for i in range(1500)]
    odd = [("a", 9000, None, [1.0] * 6), (None, 9001, "x", [1.0] * 6)]
    queries = [(i, "a" if i % 2 else "b", r.normal(size=6).tolist()) for i in range(400)] + [(900, "nowhere", [1.0] * 6)]
    b = spark.createDataFrame(bank + odd, "concept string, text_idx long, text string, raw array<double>")
    q = spark.createDataFrame(queries, "query_id long, concept string, v array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for i, c, v in queries:
        best = {}
        for concept, idx, text, raw in bank:
            if concept == c:
                s = float(unit(v) @ unit(raw))
                if text not in best or (-s, idx) < best[text]:
                    best[text] = (-s, idx)
        for rank, (text, (s, _)) in enumerate(sorted(best.items(), key=lambda x: x[1])[:4]):
            want[i, rank + 1] = (text, -s)
    for tile in (R.TILE_BYTES, 8000):
        got = {(x.query_id, x.rank): (x.text, x.sim) for x in R.top_texts(q, b, 4, tile).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    left, right = R.tiled(q, b, 8000)
    cells = ["concept", "q_tile", "b_tile"]
    most_q = left.groupBy(*cells).agg(F.sum(8 * F.size("v") + 32).alias("n")).agg(F.max("n")).first()[0]
    most_b = right.where("text_idx <> 3").groupBy(*cells).agg(F.sum(8 * F.size("u") + F.octet_length("text") + 64).alias("n")).agg(F.max("n")).first()[0]
    assert most_q < 2 * 8000 and most_b < 2 * 8000
    copies = left.groupBy("q_id", "concept").count().agg(F.max("count")).first()[0]
    assert copies == right.agg(F.max("b_tile")).first()[0] + 1 > 1


# ------------------------------------------------------------ masks and pictures


def _masks(seed, n=200):
    r = random.Random(seed)
    return [r.random() < 0.4 for _ in range(n)]


def test_masks_as_edges(spark):
    for bits in ([], [True], [False], [True, True, False], _masks(1), _masks(2), [True] * 30):
        edges = [i for i, (a, b) in enumerate(zip([False, *bits], [*bits, False], strict=True)) if a != b]
        mask = F.array(*map(F.lit, bits)) if bits else F.array().cast("array<boolean>")
        assert one(spark, G.edges_of(mask)) == edges
        assert one(spark, G.mask_from(G.edges_of(mask), F.lit(len(bits)))) == bits
        assert one(spark, G.edge_area(G.edges_of(mask))) == sum(bits)
    rows = spark.createDataFrame([(i, [k for k, v in enumerate(zip([False, *a], [*a, False])) if v[0] != v[1]]) for i, a in enumerate((_masks(3), _masks(4), []))] + [(9, None)], "id int, edges array<long>")
    back = {r.id: (r.edges, r.again) for r in G.with_edges(G.with_counts(rows), "counts", "again").collect()}
    assert all(a == b or (a and b and [x for x in b if b.count(x) == 1] == a) for a, b in back.values())


def test_picture_forms_equal_pixel_forms(spark):
    r = random.Random(6)
    rows = []
    for case in range(7):
        for pos in range(r.choice([1, 5, 40, 90])):
            rows.append((case, pos * 3, r.choice([0.1, 0.25, 0.5, 0.75, r.random()]), r.random() < (0.0 if case == 3 else 0.4), case == 5 or r.random() < 0.8))
    px = spark.createDataFrame(rows, "case int, pos int, a double, gt boolean, inside boolean").repartition(3)
    pics = G.pictures(px, ["case"])
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) and v == v else str(v) for v in x) for x in df.collect())
    for options in ({}, {"threshold": 0.25}, {"method": "percentile", "percentile": 80.0}, {"method": "topk"}):
        wide = G.picture_metrics(pics, ["case"], **options)
        assert rounded(wide) == rounded(G.case_metrics(px, ["case"], **options).select(wide.columns))
    masks = pics.select("case", "gt", G.edges_of(F.transform("a", lambda x: x >= 0.5)).alias("pred"))
    assert rounded(G.mask_overlap(masks, ["case"])) == rounded(G.overlap(px.withColumn("pred", F.col("a") >= 0.5), ["case"]))
    some = px.where("inside")
    assert rounded(G.picture_sweep(pics, [])) == rounded(G.sweep(some, ["case"]))
    assert G.picture_metrics(pics.limit(0), ["case"]).count() == 0
    with pytest.raises(ValueError):
        G.picture_metrics(pics, ["case"], method="best")


def test_taps_sum_to_one(spark):
    for kind in ("nearest", "linear", "bilinear"):
        for a, b in ((1, 1), (1, 5), (7, 3), (3, 7), (8, 8), (518, 37)):
            taps = one(spark, I.taps(F.lit(a), F.lit(b), kind))
            assert len(taps) == b and all(abs(sum(t.weights) - 1) < 1e-12 and t.first >= 0 and t.first + len(t.weights) <= a for t in taps)
    flat = F.array(*[F.lit(0.25)] * 12)
    assert one(spark, I.resized(flat, F.lit(3), F.lit(4), 5, 2)) == pytest.approx([0.25] * 10)
    assert one(spark, I.stretched(flat)) == [0.25] * 12 and one(spark, I.normalised(flat, "cxr_per_image")) == [0.0] * 12
    assert one(spark, I.normalised(F.array(F.lit(2.0)), "cxr_per_image")) == [0.0]
    assert one(spark, I.normalised(F.lit(None).cast("array<double>"), "cxr_percentile")) is None
    assert one(spark, I.letterboxed(F.lit(None).cast("array<double>"), F.lit(2), F.lit(2), 4)) is None
    rows = spark.createDataFrame([(1, [0.0, 0.5, 1.0, 1.0]), (2, None), (3, []), (4, [0.3])], "id int, pixels array<double>")
    got = {r.id: r.pixels for r in I.equalised(rows, ["id"], levels=4).collect()}
    assert got[2] is None and got[3] == [] and len(got) == 4 and got[1][0] == 0.0 and got[1][3] == 1.0
    with pytest.raises(ValueError):
        I.normalised("pixels", "other")


def test_png_round_trip_and_broken_files(spark, tmp_path):
    r = np.random.default_rng(8)
    made = {}
    for i, (kind, shape) in enumerate([(np.uint8, (13, 7)), (np.uint16, (11, 5)), (np.uint8, (1, 1)), (np.uint16, (6, 40)), (np.uint8, (5, 300))]):
        pixels = r.integers(0, np.iinfo(kind).max, shape, dtype=kind, endpoint=True)
        data = pictures.png_bytes(pixels)
        assert (pictures.png_pixels(data) == pixels).all() and pictures.png_pixels(data).dtype == kind
        (tmp_path / f"{i}.png").write_bytes(data)
        made[f"{i}.png"] = pixels / np.iinfo(kind).max
    good = (tmp_path / "0.png").read_bytes()
    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1], [0, 0, 0, 0, 0, 0, 0, 0, 1]])
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)
    assert (pictures.png_pixels(pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 2, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")) == bits).all()
    bad = {"cut": good[:50], "sum": good[:-20] + b"xx" + good[-18:], "text": b"hello", "head": pictures.SIGNATURE}
    for name, data in bad.items():
        (tmp_path / f"bad_{name}.png").write_bytes(data)
    got = {os.path.basename(x.path): x for x in pictures.picture_files(spark, str(tmp_path)).collect()}
    assert len(got) == len(made) + len(bad)
    for name, x in made.items():
        assert got[name].error is None and (got[name].height, got[name].width) == x.shape and np.allclose(got[name].pixels, x.ravel(), atol=1e-6)
    assert all(got[f"bad_{n}.png"].pixels is None and got[f"bad_{n}.png"].error for n in bad)


# ------------------------------------------------------------ shards


def _rows(spark, n=500, start=0):
    df = spark.range(start, start + n).select(F.col("id").alias("key"), F.concat(F.lit("m"), "id").alias("name"), F.transform(F.array(*map(F.lit, range(4))), lambda i: (F.col("id") * 10 + i).cast("float")).alias("vector"))
    return sinks.stamped(df, ["key"], 64, start=start // 64)


def test_paired_shards_round_trip(spark, tmp_path):
    at = str(tmp_path / "p")
    paired.write(_rows(spark), at)
    back = paired.read(spark, at, rows=30)
    assert back.columns == ["key", "name", "vector", "shard", "row"]
    want = sorted((i, f"m{i}", [i * 10.0 + k for k in range(4)], i // 64, i % 64) for i in range(500))
    assert sorted(tuple(r) for r in back.collect()) == want
    paired.write(_rows(spark, 100, 512), at, dtype="float16")
    assert paired.read(spark, at).count() == 600
    with pytest.raises(Exception, match="written twice"):
        paired.write(_rows(spark, 100, 512), at)
    assert paired.read(spark, at).count() == 600
    paired.write(_rows(spark, 70), at, mode="overwrite")
    assert sorted(r.key for r in paired.read(spark, at).collect()) == list(range(70))
    files = [f for f in glob.glob(f"{at}/**", recursive=True) if os.path.isfile(f)]
    assert len(files) == 5 and not glob.glob(f"{at}/_staging/*")  # two shards, two files each, and a manifest


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "p")
    paired.write(_rows(spark, 128), at)
    broken = _rows(spark, 256, 128).withColumn("name", F.when(F.col("key") == 300, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="killed"):
        paired.write(broken, at)
    assert sorted(r.key for r in paired.read(spark, at).collect()) == list(range(128))
    files = [f for f in glob.glob(f"{at}/**", recursive=True) if os.path.isfile(f)]
    assert len(files) == 5 and not glob.glob(f"{at}/_staging/*")
    ragged = _rows(spark, 64, 128).withColumn("vector", F.when(F.col("key") == 130, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="length"):
        paired.write(ragged, at)


def test_filters_open_only_their_shards(spark, tmp_path):
    at = str(tmp_path / "p")
    paired.write(_rows(spark), at)
    for f in glob.glob(f"{at}/*/embeddings_*.npy"):
        if "00003" not in f and "00006" not in f:
            os.remove(f)
    assert sorted({r.key // 64 for r in paired.read(spark, at).where("shard = 3 or shard = 6").where(F.col("shard").isin(3, 6)).collect()}) == [3, 6]
    assert paired.read(spark, at).where("shard > 5 and shard < 7 and key % 2 = 0").count() == 32
    with pytest.raises(Exception):
        paired.read(spark, at).where("shard = 4").collect()
    plain = tmp_path / "plain"
    plain.mkdir()
    for i in range(3):
        np.save(plain / f"embeddings_{i:05d}.npy", np.full((100, 3), i, np.float16))
    (plain / "embeddings_00007.npy").write_bytes(b"not an array")
    got = readers.shards(spark, str(plain), rows=33).where("shard <= 1")
    assert got.rdd.getNumPartitions() == 8 and got.count() == 200 and {r.shard for r in got.collect()} == {0, 1}


# ------------------------------------------------------------ windows, epochs, buffers


def test_windows_cover_each_text(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(23))), (2, "a b c"), (3, ""), (4, None), (5, " \n "), (6, " ".join("x" * (i + 1) for i in range(8)))]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = R.windows(df, size=8, overlap=3).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.window):
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, 2, 6} and [len(by[i]) for i in (1, 2, 6)] == [4, 1, 1]
    assert [r.start for r in by[1]] == [0, 5, 10, 15] and by[1][-1].window_text.split()[-1] == "w22"
    assert all(r.n_tokens == len(r.window_text.split()) <= 8 and r.n_windows == len(by[r.id]) for r in rows)
    assert [r.id for r in R.long_texts(df, ["id"], size=8, overlap=3).collect()] == [1]
    encode = lambda w: w.withColumn("vector", F.array(F.length("window_text").cast("double"), F.lit(1.0)))
    for weighted in (False, True):
        got = {r.id: r for r in R.window_means(df, ["id"], encode, 2, weighted=weighted, normalise=False, size=8, overlap=3).collect()}
        assert got[3].vector == [0.0, 0.0] == got[4].vector and got[5].n_windows == 0 and len(got) == 6
        w = [r.n_tokens if weighted else 1 for r in by[1]]
        assert got[1].vector == pytest.approx([sum(len(r.window_text) * k for r, k in zip(by[1], w, strict=True)) / sum(w), 1.0])
        assert got[1].n_tokens == sum(r.n_tokens for r in by[1])
    with pytest.raises(ValueError):
        R.windows(df, size=4, overlap=4)


def test_epochs_are_permutations(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        places = [r.x for r in spark.range(n).select(P.permuted("id", n, "k|1").alias("x")).collect()]
        assert sorted(places) == list(range(n))
    rows = spark.range(103).select((F.col("id") * 3).alias("key"))
    a, b = ([r.key for r in P.epoch(rows, ["key"], 10, number=e).orderBy("place").collect()] for e in (0, 1))
    assert sorted(a) == sorted(b) == [i * 3 for i in range(103)] and a != b and a != sorted(a)
    assert a == [r.key for r in P.epoch(rows.repartition(7), ["key"], 10, number=0).orderBy("place").collect()]
    sizes = P.epoch(rows, ["key"], 10, drop_last=True).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(i, 10) for i in range(10)]
    assert P.epoch(rows.limit(0), ["key"], 10).count() == 0


def test_buffers_flush_whole_and_by_time(spark, tmp_path):
    import time

    rows = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("u"))
    buffer = lambda **wait: buffers.buffered(resume.files(spark, f"{tmp_path}/in", "k long, u string"), "k", "u", 8, **wait)
    done = lambda: spark.read.schema("k long, flush long, whole boolean, units array<string>").parquet(f"{tmp_path}/out").collect()
    for low, high in ((0, 25), (25, 50)):  # the second run goes on with what the first has held back
        rows.where(F.col("u").cast("int").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        resume.run_available(buffer(), resume.each_batch(f"{tmp_path}/out"), f"{tmp_path}/check")
    out = done()
    assert [len(r.units) for r in out] == [8] * 6 and all(r.whole for r in out) and len({u for r in out for u in r.units}) == 48
    assert all({int(u) % 2 for u in r.units} == {r.k} for r in out)
    assert sorted((r.k, r.flush) for r in out) == [(k, i) for k in (0, 1) for i in range(3)]
    run = buffer(wait_ms=300).writeStream.foreachBatch(resume.each_batch(f"{tmp_path}/late")).option("checkpointLocation", f"{tmp_path}/check2").trigger(processingTime="300 milliseconds").start()
    until = time.time() + 90
    while time.time() < until:
        time.sleep(1)
        late = [r for f in glob.glob(f"{tmp_path}/late/batch=*/_SUCCESS") for r in spark.read.parquet(os.path.dirname(f)).collect()]
        if sum(len(r.units) for r in late) >= 50:
            break
    run.stop()
    assert sorted(len(r.units) for r in late if not r.whole) == [1, 1] and sorted(int(u) for r in late for u in r.units) == list(range(50))


def test_labels_by_json_type(spark):
    cases = {'"2.0"': (0, False), "2.0": (1, True), '"true"': (0, False), "true": (0, True), "false": (0, False), '" 3 "': (1, True), "4": (0, False), '{"label": "present"}': (1, True), "{}": (0, False), "x": (0, False), "1.5": (0, False)}
    y, valid = L.json_label("doc")
    got = {r.doc: (r.y, r.valid) for r in spark.createDataFrame([(k,) for k in cases], "doc string").select("doc", y.alias("y"), valid.alias("valid")).collect()}
    assert got == cases
    assert json.loads('"2.0"') == "2.0"


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    from loomwork.operators import runs

    calls = []

    def make(name, value):
        def made(tables):
            calls.append(name)
            if value is None:
                raise RuntimeError("stopped")
            rows = spark.range(3).withColumn("v", F.lit(value))
            return rows if not tables else rows.unionByName(next(iter(tables.values())).select("id", "v"))

        return made

    steps = lambda v: [runs.Step("a", make("a", 1)), runs.Step("b", make("b", v), ("a",), {"v": 2}), runs.Step("c", make("c", 3), ("b",))]
    run = runs.Run(spark, str(tmp_path / "r"))
    with pytest.raises(RuntimeError):
        run(steps(None))
    run = runs.Run(spark, str(tmp_path / "r"))
    assert run(steps(2))["c"].count() == 9 and run.made == ["b", "c"] and run.skipped == ["a"] and calls == ["a", "b", "b", "c"]
    other = [runs.Step("a", make("a", 1)), runs.Step("b", make("b", 5), ("a",), {"v": 5}), runs.Step("c", make("c", 3), ("b",))]
    run = runs.Run(spark, str(tmp_path / "r"))
    assert sorted(r.v for r in run(other)["b"].collect()) == [1, 1, 1, 5, 5, 5] and run.made == ["b", "c"]
    with pytest.raises(ValueError):
        run([runs.Step("x", make("x", 1), ("y",))])


def test_streams_do_not_double_keys_across_batches(spark, tmp_path):
    write = resume.idempotent_append(str(tmp_path / "out"), "k")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    for number, df in ((0, rows(1, 2, 2)), (1, rows(2, 3)), (1, rows(2, 3)), (2, rows(1, 4))):
        write(df, number)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_units_leave_out_and_count_once(spark):
    reports = spark.createDataFrame([(1, " full  text "), (2, None), (3, "only full")], "doc_id int, full string")
    leaves = spark.createDataFrame([(1, 0, "comparison", "old"), (1, 1, "report_date.x", "1999"), (1, 2, "lung.a", "same"), (1, 3, "lung.a", "same"), (1, 4, "lung", "top"), (1, 5, "lungs.b", "far"), (2, 0, "heart", ""), (4, 0, "heart", "big")], "doc_id int, at int, name string, text string")
    imputed = spark.createDataFrame([(1, 0, "lung.c", "made"), (2, 0, "heart", "none")], "doc_id int, at int, name string, text string")
    got = {(r.doc_id, r.field, r.text, r.is_imputed) for r in L.units(reports, leaves, imputed, groups=("lung",)).collect()}
    assert got == {
        (1, "unstructured.full", "full text", False), (1, "structured.lung.a", "same", False), (1, "structured.lung", "top", False), (1, "structured.lungs.b", "far", False), (1, "structured.lung.c", "made", True),
        (1, "structured.grouped.lung", "same ; same ; top ; made", False), (1, "structured.full", "same same top far made", False), (1, "report.full", "full text same same top far made", False),
        (2, "structured.heart", "none", True), (2, "structured.full", "none", False), (2, "report.full", "none", False), (3, "unstructured.full", "only full", False), (3, "report.full", "only full", False), (4, "structured.heart", "big", False), (4, "structured.full", "big", False),
    }
    full = {r.field for r in L.units(reports, leaves, imputed, level="full", groups=("lung",)).collect()}
    assert full == {"unstructured.full", "structured.grouped.lung", "structured.full", "report.full"}
    leaf = L.units(reports, leaves, level="leaf", prefix=True)
    assert {(r.field, r.text) for r in leaf.where("doc_id = 1").collect()} == {("structured.lung.a", "lung.a: same"), ("structured.lung", "lung: top"), ("structured.lungs.b", "lungs.b: far")}
    with pytest.raises(ValueError):
        L.units(reports, leaves, level="some")


def test_cases_are_listed_by_tasks_and_their_files_dealt(spark, tmp_path):
    """A directory's place in the tree does not matter; no plan holds a file for each case, and one partition's files are written by several tasks."""
    at = str(tmp_path / "cases")
    names = [f"c{i}/{f}" for i in range(300) for f in ("a.json", "b.json") if i % (2 if f == "a.json" else 3) == 0] + ["deep/er/x/a.json", "deep/er/x/b.json", "_tmp/y/a.json", "_tmp/y/b.json", "a.json", "b.json"]
    rows = spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).withColumn("doc", F.col("file"))
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dealt", "dealt")
    sinks.named_files(rows, at)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [before.getStageInfo(s) for j in before.getJobIdsForGroup("dealt") for s in before.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    found = readers.cases(spark, at, "a.json", "b.json")
    want = {f"file:{at}/c{i}" for i in range(0, 300, 6)} | {f"file:{at}/deep/er/x", f"file:{at}"}
    assert {(r["case"], r["first"], r["second"]) for r in found.collect()} == {(c, f"{c}/a.json", f"{c}/b.json") for c in want}
    assert not any(f.endswith(".json") for f in found.inputFiles())
    by_spark = readers.cases(spark, at, "[a].json", "[b].json")
    assert {tuple(r) for r in by_spark.select("case", "first", "second").collect()} == {tuple(r) for r in found.select("case", "first", "second").collect()}
    assert [r["case"] for r in readers.cases(spark, at, "a.json", "b.json", 3).collect()] == sorted(want)[:3]
    assert open(f"{at}/c6/b.json").read() == "c6/b.json"
