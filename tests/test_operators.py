"""Rules, edge cases and properties of the library's operators, on small tables."""

import asyncio
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork import config
from loomwork.functions import documents as D
from loomwork.functions import numeric as N
from loomwork.functions import text as T
from loomwork.operators import grounding as G
from loomwork.operators import labels as L
from loomwork.operators import metrics as M
from loomwork.operators import retrieval as R
from loomwork.operators import services, splits, stats
from loomwork.sources import readers, sinks
from loomwork.streaming import resume


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_text_rules(spark):
    assert one(spark, T.clean(F.lit(" a \n b "))) == "a b"
    assert one(spark, T.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, T.field(F.lit("structured.structured.a"))) == "structured.a"
    assert one(spark, T.listed(F.lit("b, a,,b ,"))) == ["b", "a"]
    assert one(spark, T.safe_name(F.lit("a b/c:d.e\\f"))) == "a_b_c_d_e_f"
    assert one(spark, T.image_id(F.lit("x/patient1/study2/view1_frontal.JPG"))) == "patient1_study2_view1_frontal"
    assert one(spark, T.report_id(F.lit("dir/A_1_structured.json"))) == "A_1"
    with pytest.raises(Exception, match="no image id"):
        one(spark, T.image_id(F.lit("nothing.png")))


def test_numeric_rules(spark):
    got = [one(spark, N.numeric_label(F.lit(x))) for x in ("true", "2", "2.0", "2.5", "x", "")]
    assert got == [1, 2, 2, None, None, None]
    assert [one(spark, N.lenient_int(F.lit(x))) for x in ("3.9", "-3.9", "nan", "")] == [3, -3, None, None]
    assert [one(spark, N.rounded(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, N.hash32(F.lit("42"), F.lit("RPT001"), F.lit("support_devices.airway"))) == 431751998
    assert one(spark, N.divided(F.lit(1.0), F.lit(0.0), 0.0)) == 0.0
    assert abs(one(spark, N.softplus(F.lit(-800.0)))) < 1e-300
    assert one(spark, N.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_labels_follow_the_table(spark):
    words = ["present", " Not Present ", "0", "1", "2", "3", "4", "x", None]
    label, valid = L.label_and_mask(F.col("value"))
    rows = spark.createDataFrame([(w,) for w in words], "value string").select(label, valid).collect()
    assert [tuple(r) for r in rows] == [(1, True), (0, True), (0, False), (0, True), (1, True), (1, True), (0, False), (0, False), (0, False)]


def test_quota_zero_and_absent_keep_none(spark):
    rows = spark.createDataFrame([(i, n) for i in range(20) for n in "abc"], "doc_id long, name string")
    quota = spark.createDataFrame([("a", 5), ("b", 0)], "name string, quota int")
    got = {r["name"]: r["count"] for r in L.within_quota(rows, quota).groupBy("name").count().collect()}
    assert got == {"a": 5}


SEVERITY = {"p.a": 0, "p.b": 2, "p.c": 3}


def test_context_leaves_out_the_target(spark):
    rows = spark.createDataFrame([(1, n, s) for n, s in SEVERITY.items()] + [(2, "p.a", 0)], "doc_id long, name string, sev int")
    got = {(r.doc_id, r.name): (r.n_other, r.ratio) for r in L.with_context(rows, F.col("sev") != 0).collect()}
    assert got == {(1, "p.a"): (2, 100.0), (1, "p.b"): (2, 50.0), (1, "p.c"): (2, 50.0), (2, "p.a"): (0, 0.0)}
    assert [r.doc_id for r in L.eligible_labels(rows).collect()] == [1]


def test_documents(spark):
    doc = {"data": {"x": {"text": " a ", "label": 1}, "list": [{"text": "b"}, "c", 5], "empty": {"text": "", "label": "not present"}, "n": 3}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "not json"), (3, None)], "id int, doc string")
    got = {(r.id, r.path): r.text for r in D.text_leaves(df.where("id = 1"), "doc").collect()}
    assert got == {(1, "data.x"): "a", (1, "data.list.[0]"): "b", (1, "data.list.[1]"): "c", (1, "data.list.[2]"): "5", (1, "data.n"): "3"}
    assert {r.path for r in D.labelled_leaves(df, "doc").collect()} == {"data.x", "data.empty", "data.list.[0]"}
    found = {(r.id, r.path, r.problem) for r in D.violations(df.where("id < 3"), "doc", {"data.x": (0, 1), "data.empty": ("present",), "data.gone": (1,)}).collect()}
    assert found == {(1, "data.empty", "not allowed"), (1, "data.gone", "missing"), (1, "data.list.[0]", "extra"), (2, "", "malformed")}
    schema = D.answer_schema(["a.b", "c"])
    assert schema["required"] == ["a", "c", "overall"] and schema["properties"]["a"]["additionalProperties"] is False


def test_nan_is_skipped(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert rows.agg(stats.nan_mean("v"), stats.nan_max("v")).first()[:] == (1.0, 1.0)


def test_ranking_of_one_class_and_ties(spark):
    rows = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.2), ("b", 1, 0.5), ("b", 0, 0.5)], "name string, y int, score double")
    got = {r.name: r for r in M.ranking(rows, ["name"]).collect()}
    assert np.isnan(got["a"].auroc) and got["a"].best_f1 == 0 and got["a"].best_thr == 0.5
    assert got["b"].auroc == 0.5 and got["b"].auprc == 0.5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 500)), min_size=2, max_size=40))
def test_grid_thresholds_match_a_loop(spark, data):
    rows = spark.createDataFrame([("c", y, s / 500) for y, s in data], "name string, y int, score double")
    got = M.grid_thresholds(rows, ["name"]).first()
    y = np.array([a for a, _ in data])
    s = np.array([b / 500 for _, b in data])
    if y.min() == y.max():
        assert np.isnan(got.thr_f1)
        return
    best = (-1.0, None)
    for i in range(501):
        p = s >= i / 500
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        if f1 > best[0] + 1e-12:
            best = (f1, i / 500)
    assert abs(got.f1 - best[0]) < 1e-9 and got.thr_f1 == best[1]


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60))
def test_runs_round_trip(runs):
    assert G.decode_runs(G.encode_runs(runs)) == runs


def test_mask_is_column_major():
    assert G.mask_of([1, 2, 3], 2, 3).astype(int).tolist() == [[0, 1, 0], [1, 0, 0]]


def test_first_per_key_and_split_sizes(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, ord int, v string")
    assert {r.k: r.v for r in stats.first_per_key(rows, ["k"], ["ord"]).collect()} == {"a": "y", "b": "z"}
    groups = spark.createDataFrame([(i % 37,) for i in range(100)] + [(None,)], "g int")
    got = {r["split"]: r["count"] for r in splits.group_split(groups, "g", val=0.2, test=0.1).groupBy("split").count().collect()}
    assert got == {"test": 4, "val": 7, "train": 26}
    with pytest.raises(ValueError):
        splits.group_split(groups, "g", val=0.6, test=0.5)


def test_weighted_draws_follow_weights(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "k int, w double")
    got = {r.k: r["count"] for r in splits.weighted_draw(rows, "k", "w", 4000).groupBy("k").count().collect()}
    assert 0 not in got and sum(got.values()) == 4000 and abs(got[4] / 4000 - 0.4) < 0.05


def test_evidence_defaults_and_ranks(spark):
    found = spark.createDataFrame([(1, "c", 2, 0.9, 0, "second"), (1, "c", None, 0.99, 1, "none"), (1, "d", 1, 0.1, 0, "first")], "case_id int, concept string, rank int, sim double, ord int, text string")
    assert {r.concept: r.text for r in R.best_match(found, 1).collect()} == {"c": "second", "d": "first"}
    with pytest.raises(ValueError, match="unknown"):
        R.head_map(["a"], ["b"])


def test_hash_vectors_differ_and_repeat(spark):
    rows = spark.createDataFrame([("No endotracheal tube.",), ("No enteral tube.",)], "text string")
    a, b = (r.vector for r in R.hash_vectors(rows).collect())
    assert a != b and abs(sum(x * x for x in a) - 1) < 1e-5


def test_chat_retries_and_objections(spark):
    rows = services.requests(spark.createDataFrame([("a", "x"), ("b", "y")], "report_id string, body string"), "system", "say {t}", t="body")

    def provider():
        calls = {}

        async def chat(messages):
            await asyncio.sleep(0)
            key = messages[1]["content"]
            calls[key] = calls.get(key, 0) + 1
            if key == "say x" and calls[key] == 1:
                raise TimeoutError("slow")
            return "bad" if key == "say y" else "good"

        return chat

    got = {r.report_id: r for r in services.asked(rows, provider, lambda t: "no" if t == "bad" else None, tries=2, pause=0.0).collect()}
    assert (got["a"].status, got["a"].attempts) == ("success", 2) and (got["b"].status, got["b"].error) == ("failed", "no")


def test_options():
    assert config.options({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(KeyError):
        config.options({"a": {"b": 1}}, {"a": {"x": 1}})


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('report_id,examination,report_text\n A ,CT,"two\nlines ""q"""\nA,CT,again\n,X,no id\nB,NA,b\n')
    rows = {r.report_id: r for r in readers.reports(spark, str(tmp_path / "r.csv")).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].report_text == 'two\nlines "q"' and rows["B"].examination is None
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "A_structured.json").write_text('{"data": {}}')
    (docs / "B_x.json").write_text("{bad")
    ids = spark.createDataFrame([("A",), ("B",), ("C",)], "report_id string")
    assert {r.report_id: r.has_json for r in readers.json_documents(spark, str(docs), ids).collect()} == {"A": True, "B": False, "C": False}
    (tmp_path / "pool.json").write_text('{"a": ["x", " ", "y"], "b": []}')
    assert {r.name: r.pool for r in readers.pools(spark, str(tmp_path / "pool.json")).collect()} == {"a": ["x", "y"]}
    shard = tmp_path / "npy"
    shard.mkdir()
    np.save(shard / "embeddings_00000.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    np.save(shard / "embeddings_00002.npy", np.ones((1, 2), np.float32))
    got = {(r.shard, r.row): list(r.vector) for r in readers.shards(spark, str(shard)).collect()}
    assert got == {(0, 0): [0, 1], (0, 1): [2, 3], (0, 2): [4, 5], (2, 0): [1, 1]}
    sinks.sharded(spark.range(10), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert one(spark, sinks.encoded_pixels(F.lit(0.5))) == 32768


def test_stream_resumes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    for n in (5, 8):
        stream = resume.files(spark, src, "id long")
        resume.run_available(stream, resume.idempotent_append(out, "id"), str(tmp_path / "ck"))
        assert spark.read.parquet(out).count() == n
        if n == 5:
            spark.range(5, 8).write.mode("append").parquet(src)
    assert resume.pending(spark.range(10), spark.read.parquet(out), "id").count() == 2


def test_info_nce_against_numpy(spark):
    r = random.Random(0)
    data = [(0, "c", i, [r.gauss(0, 1) for _ in range(4)], [r.gauss(0, 1) for _ in range(4)]) for i in range(6)] + [(0, "lone", 9, [1.0] * 4, [1.0] * 4)]
    got = M.info_nce(spark.createDataFrame(data, "batch int, name string, sample int, v array<double>, u array<double>"), tau=0.5).first()
    v, u = (np.array([x[i] for x in data[:6]]) for i in (3, 4))
    v, u = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-6) for x in (v, u))
    z = v @ u.T / 0.5
    want = (np.mean(np.log(np.exp(z).sum(1)) - np.diag(z)) + np.mean(np.log(np.exp(z).sum(0)) - np.diag(z))) / 2
    assert abs(got.macro - want) < 1e-9


def test_contrast_reads_every_embedding(spark, tmp_path):
    from loomwork.plans import catalog

    x = np.random.default_rng(3).normal(size=(600, 3)).astype(np.float32)
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    losses = []
    for at in (np.arange(b * 50 + y, b * 50 + 50, 2) for b in range(12) for y in range(2)):
        v = x[at].astype(np.float64)
        v /= np.sqrt((v * v).sum(1))[:, None] + 1e-6
        z = v @ np.roll(v, -1, 1).T / 0.1
        losses.append(np.mean([np.log(np.exp(m).sum(1)) - np.diag(m) for m in (z, z.T)]))
    assert catalog.infonce_macro(spark, str(tmp_path)).first()["macro"] == pytest.approx(np.mean(losses), abs=1e-5)
    assert catalog.infonce_pair(spark, str(tmp_path)).first()["weighted"] == pytest.approx(np.mean(losses), abs=1e-5)


def test_pixels_of_every_supplier(spark, tmp_path):
    from loomwork.plans import catalog

    rows = [(k, i, (k + i) % 9, 1.0 + (i * k) % 50, k) for k in range(1, 61) for i in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.l_suppkey for r in catalog.overlap_dice_iou(spark, str(tmp_path)).collect()} == set(range(1, 61))
    assert {r.l_suppkey for r in catalog.case_metrics(spark, str(tmp_path)).collect()} == set(range(1, 61))
    assert catalog.attention_normalised(spark, str(tmp_path)).count() == len(rows)
    assert catalog._pixels(spark, str(tmp_path)).count() == len(rows)
    assert catalog.threshold_sweep(spark, str(tmp_path)).count() == 1


def test_documents_of_any_depth(spark):
    def doc(levels):
        return '{"a":' * (levels - 1) + json.dumps({"a": {"text": "x", "label": 1.50, "more": [None, True, {"b": 2.0}]}}) + "}" * (levels - 1)

    for levels in (1, 2, 9, 40, 400):
        rows = spark.createDataFrame([(1, doc(levels)), (2, "{broken"), (3, None), (4, "[]")], "id int, doc string")
        assert [(r.id, r.path, r.text) for r in D.text_leaves(rows, "doc").collect() if r.path.endswith("a")] == [(1, ".".join("a" * levels), "x")]
        assert [(r.id, r.path, r.label) for r in D.labelled_leaves(rows, "doc").collect()] == [(1, ".".join("a" * levels), "1.5")]
    names = {r.path.removeprefix("a.a.a"): (r.ord[3:], r.value) for r in D.nodes(spark.createDataFrame([(1, doc(3))], "id int, doc string")).collect()}
    assert names[".label"] == ([1], "1.5") and names[".more.[0]"] == ([2, 0], None) and names[".more.[1]"] == ([2, 1], "true") and names[".more.[2].b"] == ([2, 2, 0], "2.0")
    clash = spark.createDataFrame([(1, '{"k y": {"text": "t"}}')], "`a.b` int, doc string")
    assert [(r["a.b"], r.path, r.text) for r in D.text_leaves(clash.withColumnRenamed("a.b", "id")).select(F.col("id").alias("a.b"), "path", "text").collect()] == [(1, "k y", "t")]
    assert one(spark, D.at_path(F.lit('{"data": {"k y": {"label": "2"}}}'), "k y")) == "2"
