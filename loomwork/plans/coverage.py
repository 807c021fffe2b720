"""More named queries: readers and sinks in round trips, drivers, checks of answers, stores, scalar functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import documents as D
from loomwork.functions import numeric as N
from loomwork.functions import text as T
from loomwork.operators import grounding as G
from loomwork.operators import imaging as I
from loomwork.operators import labels as L
from loomwork.operators import metrics as M
from loomwork.operators import retrieval as R
from loomwork.operators import services as V
from loomwork.operators import splits as P
from loomwork.operators import stats as S
from loomwork.operators import stores as O
from loomwork.plans import fixtures as X
from loomwork.plans.catalog import _labelled, _r, query
from loomwork.session import place
from loomwork.sources import pictures as Y
from loomwork.sources import readers as E
from loomwork.sources import sinks as K
from loomwork.streaming import resume as U


# ------------------------------------------------------------ strings, numbers, dates

_PATH = "CASE doc_id % 3 WHEN 0 THEN 'root\\patient' || doc_id || '\\study1\\view1_Frontal.jpg' WHEN 1 THEN 'a/Patient' || doc_id || '/study2/view2_lateral.PNG' ELSE 'patient' || doc_id || '/study3/view3_x.jpeg' END"
_CELL = "CASE doc_id % 5 WHEN 0 THEN 'Frontal' WHEN 1 THEN ' lateral view' WHEN 2 THEN 'neither' WHEN 3 THEN '' END"


def _views(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").select("doc_id")
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("root\\patient"), i, F.lit("\\study1\\view1_Frontal.jpg"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a/Patient"), i, F.lit("/study2/view2_lateral.PNG"))).otherwise(F.concat(F.lit("patient"), i, F.lit("/study3/view3_x.jpeg")))
    five = F.col("doc_id") % 5
    return rows.withColumn("path", path).withColumn("cell", F.when(five == 0, "Frontal").when(five == 1, " lateral view").when(five == 2, "neither").when(five == 3, ""))


@query(f"SELECT doc_id, CASE WHEN contains(cell, 'Frontal') THEN 'frontal' WHEN contains(cell, 'lateral') OR contains(lower(path), 'lateral') THEN 'lateral' ELSE 'frontal' END AS view FROM (SELECT doc_id, {_PATH} AS path, coalesce({_CELL}, '') AS cell FROM documents)")
def view_infer(spark, d) -> DataFrame:
    return _views(spark, d).select("doc_id", T.view(F.col("path"), F.col("cell")).alias("view"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_PATH} AS path, coalesce({_CELL}, '') AS cell FROM documents) WHERE NOT contains(cell, 'Frontal') AND (contains(cell, 'lateral') OR contains(path, 'lateral'))")
def view_filter(spark, d) -> DataFrame:
    return _views(spark, d).where(T.view(F.col("path"), F.col("cell")) == "lateral").select("doc_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'patient' || doc_id || '_study1_view1_Frontal' WHEN 1 THEN 'Patient' || doc_id || '_study2_view2_lateral' ELSE 'patient' || doc_id || '_study3_view3_x' END AS image FROM documents")
def image_ids(spark, d) -> DataFrame:
    return _views(spark, d).select("doc_id", T.image_id(F.col("path")).alias("image"))


@query("SELECT doc_id, name, CASE WHEN idx % 2 = 0 THEN name || ': ' || text ELSE text END AS said, coalesce(label, '') AS label, doc_id || '_' || idx AS report FROM leaves", "leaves")
def text_forms(spark, d) -> DataFrame:
    rows = X.leaves(spark, d)
    said = F.when(F.col("idx") % 2 == 0, T.prefixed(F.col("name"), F.col("text"))).otherwise(T.prefixed(F.col("name"), F.col("text"), False))
    file = F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit("_"), F.col("idx").cast("string"), F.lit("_structured.json"))
    return rows.select("doc_id", "name", said.alias("said"), T.label_text("label").alias("label"), T.report_id(file).alias("report"))


@query("SELECT doc_id, array_to_string(list_concat([lang, source], CASE WHEN source IN ('b', lang) THEN [] ELSE list_filter(['b', 'c'], lambda x: x <> lang AND x <> source) END), '|') AS merged, lang || chr(10) || source AS message FROM documents WHERE lang <> source AND source IS NOT NULL AND lang IS NOT NULL")
def merged_lists(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").where("lang <> source")
    parts = F.array(F.struct(F.col("lang").alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.col("source").alias("text")))
    return rows.select("doc_id", F.array_join(T.merged(F.array("lang", "source"), F.array(F.lit("b"), F.lit("c"), F.col("lang"))), "|").alias("merged"), T.message_text(parts).alias("message"))


_ODD = "CASE doc_id % 7 WHEN 0 THEN ' 12.7 ' WHEN 1 THEN '-3.9' WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN 'word' WHEN 5 THEN '1e3' END"


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 12.7 WHEN 1 THEN -3.9 WHEN 5 THEN 1000 END::DOUBLE AS number, CASE doc_id % 7 WHEN 0 THEN 12 WHEN 1 THEN -3 WHEN 5 THEN 1000 END::BIGINT AS whole FROM documents")
def lenient_numbers(spark, d) -> DataFrame:
    seven = F.col("doc_id") % 7
    odd = F.when(seven == 0, " 12.7 ").when(seven == 1, "-3.9").when(seven == 2, "nan").when(seven == 3, "").when(seven == 4, "word").when(seven == 5, "1e3")
    return X.read(spark, d, "documents").select("doc_id", N.lenient_float(odd).alias("number"), N.lenient_int(odd).alias("whole"))


@query("SELECT doc_id, round(greatest(ln(0.01), least(ln(1.0), ln((n_chars + 1) / 1000.0))), 6) AS log_tau, round(exp(greatest(ln(0.01), least(ln(1.0), ln((n_chars + 1) / 1000.0)))), 6) AS tau FROM documents")
def temperature_bounds(spark, d) -> DataFrame:
    held = N.log_temperature((F.col("n_chars") + 1) / 1000.0, 0.01, 1.0)
    return X.read(spark, d, "documents").select("doc_id", _r(held, "log_tau"), _r(N.temperature(held), "tau"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS run FROM events")
def run_stamps(spark, d) -> DataFrame:
    return X.read(spark, d, "events").select("event_id", T.run_stamp("ts").alias("run"))


@query("SELECT sample_id, name, (SELECT count(*) FROM range(0, 501) t(i) WHERE i / 500.0::DOUBLE <= score) AS at_grid, (SELECT count(*) FROM range(0, 20) t(i) WHERE round(0.1 + i * 0.04, 6) <= score) AS at_step FROM scores", "scores")
def threshold_grids(spark, d) -> DataFrame:
    """How many points of a grid, and of a grid by steps, each score reaches."""
    below = lambda points: F.size(F.filter(points, lambda x: x <= F.col("score"))).cast("long")
    return X.scores(spark, d).select("sample_id", "name", below(N.grid(500)).alias("at_grid"), below(N.steps(0.1, 0.9, 0.04)).alias("at_step"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_dot_product(v, list_reverse(v)) / list_dot_product(v, v), 6) AS likeness FROM e")
def cosine_reversed(spark, d) -> DataFrame:
    return X.read(spark, d, "embeddings").select("vec_id", _r(N.cosine("embedding", F.reverse("embedding")), "likeness"))


@query("SELECT sample_id, name, score FROM scores WHERE sample_id % 4 > 1", "scores")
def finite_scores(spark, d) -> DataFrame:
    four = F.col("sample_id") % 4
    rows = X.scores(spark, d).withColumn("score", F.when(four == 0, float("nan")).when(four == 1, float("inf")).otherwise(F.col("score")))
    return M.finite(rows).select("sample_id", "name", "score")


# ------------------------------------------------------------ documents and answers


@query("SELECT doc_id, name AS path, label FROM path UNION ALL SELECT doc_id, 'pathologies.lung.bare', CAST(doc_id % 4 AS VARCHAR) FROM documents", "path")
def pathology_map(spark, d) -> DataFrame:
    """Leaves with a label, and a bare number, below the pathology groups."""
    cell = lambda i: F.struct(F.max(F.when(F.col("idx") == i, F.col("text"))).alias("text"), F.max(F.when(F.col("idx") == i, F.col("label"))).alias("label"))
    rows = X.leaves(spark, d).groupBy("doc_id").agg(*(cell(i).alias(f"c{i}") for i in range(len(X.CONCEPTS))))
    doc = D.nested({**{f"data.{c}": F.col(f"c{i}") for i, c in enumerate(X.CONCEPTS)}, "data.pathologies.lung.bare": F.col("doc_id") % 4})
    return D.label_map(rows.select("doc_id", doc.alias("doc")), "doc", L.PATHOLOGY).select("doc_id", "path", "label")


_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["a", "n", "sub"],
    "properties": {"a": {"type": "string", "enum": ["en", "de"]}, "n": {"type": "integer"}, "sub": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["number", "null"]}}, "additionalProperties": False}, "list": {"type": "array", "items": {"type": "string"}}},
}


@query("""WITH r AS (SELECT doc_id, doc_id % 8 AS k, lang FROM documents)
  SELECT doc_id, '' AS path, 'malformed' AS problem FROM r WHERE k = 0 UNION ALL SELECT doc_id, '', 'type' FROM r WHERE k = 1 UNION ALL SELECT doc_id, 'a', 'not allowed' FROM r WHERE k IN (2, 3, 4, 5, 6, 7) AND lang NOT IN ('en', 'de')
  UNION ALL SELECT doc_id, 'n', 'type' FROM r WHERE k = 2 UNION ALL SELECT doc_id, 'n', 'missing' FROM r WHERE k = 3 UNION ALL SELECT doc_id, 'sub.x', 'missing' FROM r WHERE k = 4 UNION ALL SELECT doc_id, 'sub.y', 'extra' FROM r WHERE k = 5
  UNION ALL SELECT doc_id, 'more', 'extra' FROM r WHERE k = 6 UNION ALL SELECT doc_id, 'list.[1]', 'type' FROM r WHERE k = 7""")
def schema_types(spark, d) -> DataFrame:
    k, lang = F.col("doc_id") % 8, F.col("lang")
    made = lambda rest: F.concat(F.lit('{"a": "'), lang, F.lit('", '), F.lit(rest))
    doc = (
        F.when(k == 0, "{not json").when(k == 1, '["a"]').when(k == 2, made('"n": "3", "sub": {"x": 1.5}}')).when(k == 3, made('"sub": {"x": null}}')).when(k == 4, made('"n": 3, "sub": {}}'))
        .when(k == 5, made('"n": 3, "sub": {"x": 2, "y": 1}}')).when(k == 6, made('"n": 3, "sub": {"x": 1}, "more": true}')).otherwise(made('"n": 3, "sub": {"x": 1}, "list": ["p", 2]}'))
    )
    return D.typed_violations(X.read(spark, d, "documents").select("doc_id", doc.alias("doc")), "doc", _SCHEMA).select("doc_id", "path", "problem")


@query("""WITH c AS (SELECT doc_id AS case_id, doc_id % 7 AS k FROM documents)
  SELECT case_id, '' AS path, CASE k WHEN 0 THEN 'no object' ELSE 'missing concepts' END AS problem FROM c WHERE k IN (0, 1)
  UNION ALL SELECT case_id, 'lung.mass', CASE k WHEN 2 THEN 'missing leaf' WHEN 3 THEN 'missing final_text' WHEN 4 THEN 'not allowed' WHEN 5 THEN 'label changed' END FROM c WHERE k IN (2, 3, 4, 5)
  UNION ALL SELECT case_id, 'heart', 'text changed' FROM c WHERE k = 6""")
def echo_check(spark, d) -> DataFrame:
    k = F.col("case_id") % 7
    cases = X.read(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))
    leaf = lambda label, text, word: F.struct(label.alias("binary_cls_label"), text.alias("initial_retrieved_text"), word.alias("cls_text_consistency"), F.lit("f").alias("final_text"), F.lit("").alias("consistency_feedback"))
    fine = leaf(F.lit("present"), F.concat(F.lit(" "), "text"), F.lit("consistent"))
    other = F.when(k == 4, leaf(F.lit("present"), F.col("text"), F.lit("maybe"))).when(k == 5, leaf(F.lit("absent"), F.col("text"), F.lit("unclear"))).otherwise(fine)
    heart = F.when(k == 6, leaf(F.lit("present"), F.lit("other"), F.lit("consistent"))).otherwise(fine)
    whole = F.to_json(F.struct(F.lit("ok").alias("overall_consistency_feedback"), F.struct(heart.alias("heart"), F.struct(other.alias("mass")).alias("lung")).alias("concepts")))
    answer = F.when(k == 0, "[1]").when(k == 1, '{"overall_consistency_feedback": ""}').when(k == 2, F.replace(whole, F.lit('"mass"'), F.lit('"mess"'))).when(k == 3, F.regexp_replace(whole, r'("mass":\{[^}]*),"final_text":"f"', "$1")).otherwise(whole)
    expected = cases.select("case_id", F.explode(F.array(F.lit("heart"), F.lit("lung.mass"))).alias("path"), F.lit("present").alias("label"), "text")
    return D.echo_violations(cases.select("case_id", answer.alias("answer")), expected).select("case_id", "path", "problem")


@query("SELECT lower(r_name) || '.' || n_name AS path, 3::BIGINT AS n_top, 'binary_cls_label|initial_retrieved_text|cls_text_consistency|final_text|consistency_feedback' AS fields, 'consistent|inconsistent|unclear' AS words FROM nation JOIN region ON n_regionkey = r_regionkey")
def consistency_fields(spark, d) -> DataFrame:
    """The answer's schema for the nations below their regions, read back at each path through its own JSON."""
    rows = X.read(spark, d, "nation").join(X.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("above"), F.col("n_name").alias("below"))
    rows = rows.withColumn("path", F.concat_ws(".", "above", "below"))
    schema = json.dumps(D.consistency_schema(sorted(r.path for r in rows.collect())))  # a schema is a fixed list of paths
    whole = F.lit(schema)
    listed = lambda c: F.array_join(F.from_json(c, "array<string>"), "|")
    inner = F.element_at(F.from_json(F.get_json_object(whole, "$.properties.concepts.properties"), "map<string,string>"), F.col("above"))
    leaf = F.element_at(F.from_json(F.get_json_object(inner, "$.properties"), "map<string,string>"), F.col("below"))
    n_top = (F.size(F.from_json(F.get_json_object(whole, "$.required"), "array<string>")) + (F.get_json_object(whole, "$.additionalProperties") == "false").cast("int")).cast("long")
    return rows.select("path", n_top.alias("n_top"), listed(F.get_json_object(leaf, "$.required")).alias("fields"), listed(F.get_json_object(leaf, "$.properties.cls_text_consistency.enum")).alias("words"))


@query("""SELECT l.doc_id, l.name, l.label AS raw, l.y AS label, valid AS base_valid, e.doc_id IS NOT NULL AND NOT valid AS imputed, valid OR e.doc_id IS NOT NULL AS mask, p.sev AS target_label, p.n_other, round(p.ratio, 6) AS ratio
  FROM labelled l LEFT JOIN eligible e ON l.doc_id = e.doc_id AND l.name = e.name
  LEFT JOIN (SELECT doc_id, name, sev, count(*) OVER w - 1 AS n_other, (sum(CASE WHEN sev <> 0 THEN 1 ELSE 0 END) OVER w - CASE WHEN sev <> 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / (count(*) OVER w - 1) AS ratio FROM path WINDOW w AS (PARTITION BY doc_id)) p ON p.doc_id = l.doc_id AND p.name = l.name""", "labelled", "eligible")
def label_inspection(spark, d) -> DataFrame:
    out = L.inspection(X.leaves(spark, d))
    return out.select("doc_id", "name", "raw", "label", "base_valid", "imputed", "mask", "target_label", F.col("n_other").cast("long").alias("n_other"), _r(F.col("ratio"), "ratio"))


# ------------------------------------------------------------ drivers


def _predictions(spark, d) -> DataFrame:
    """(class, split, sample_id, gt, pred)"""
    rows = X.scores(spark, d)
    return rows.select(F.col("name").alias("class"), F.when(F.col("sample_id") % 3 == 0, "val").otherwise("test").alias("split"), "sample_id", F.when(F.col("sample_id") % 11 == 0, F.lit(None)).otherwise(F.col("y")).cast("int").alias("gt"), (F.col("score") >= 0.4).cast("int").alias("pred"))


_PRED = "pred AS (SELECT name AS class, CASE WHEN sample_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, sample_id, CASE WHEN sample_id % 11 = 0 THEN NULL ELSE y END AS gt, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS pred FROM scores)"


@query(f"WITH {_PRED} SELECT class, split, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class, split ORDER BY sha1('42|' || CAST(sample_id AS VARCHAR)), sample_id) AS turn FROM pred WHERE gt = 1 AND pred = 1) WHERE turn <= 25 UNION ALL SELECT class || '+', split, sample_id FROM pred WHERE gt = 1", "scores")
def target_filter(spark, d) -> DataFrame:
    rows = _predictions(spark, d)
    few = M.targets(rows, predicted=True, most=25).select("class", "split", "sample_id")
    return few.unionAll(M.targets(rows).select(F.concat("class", F.lit("+")), "split", "sample_id"))


_CLASSES = """WITH m AS (SELECT CASE WHEN sample_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, sample_id, 'any' AS class, max(CASE WHEN score >= CASE WHEN name = 'toxic' THEN 0.3 ELSE 0.5 END THEN 1 ELSE 0 END) AS pred, max(score) AS prob FROM s2 GROUP BY ALL),
  t AS (SELECT m.*, CASE WHEN sample_id % 11 = 0 THEN NULL ELSE sample_id % 2 END AS y FROM m), v AS (SELECT * FROM t WHERE y IS NOT NULL),
  k AS (SELECT split, prob, count(CASE WHEN y = 1 THEN 1 END) AS hits, count(CASE WHEN y = 0 THEN 1 END) AS misses FROM v GROUP BY ALL),
  w AS (SELECT *, sum(hits) OVER o AS tp, sum(misses) OVER o AS fp, sum(hits) OVER (PARTITION BY split) AS pos, sum(misses) OVER (PARTITION BY split) AS neg FROM k WINDOW o AS (PARTITION BY split ORDER BY prob DESC)),
  a AS (SELECT split, sum(misses * (tp - hits / 2)) / (max(pos) * max(neg)) AS auroc, sum(hits * tp / (tp + fp)) / max(pos) AS auprc FROM w GROUP BY split),
  c AS (SELECT split, count(*) AS n, count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn FROM v GROUP BY split)"""
_S2 = "WITH s2 AS (SELECT * FROM scores), "


def _classified(spark, d) -> DataFrame:
    split = F.when(F.col("sample_id") % 3 == 0, "val").otherwise("test").alias("split")
    scores = X.scores(spark, d).select(split, "sample_id", "name", F.col("score").alias("prob"))
    truth = scores.select("split", "sample_id").distinct().select("split", "sample_id", F.lit("any").alias("class"), F.when(F.col("sample_id") % 11 == 0, F.lit(None)).otherwise(F.col("sample_id") % 2).cast("int").alias("gt"))
    mapping = spark.createDataFrame([("quality", "any"), ("toxic", "any"), ("none", "empty")], "name string, class string")
    return M.classification(scores, truth, mapping, spark.createDataFrame([("toxic", 0.3)], "name string, thr double"))


@query(_CLASSES.replace("WITH m AS", _S2 + "m AS", 1) + " SELECT c.split, 'any' AS class, n, tp, tn, round((tp + tn) / n, 6) AS accuracy, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM c JOIN a USING (split) UNION ALL SELECT DISTINCT split, 'empty', 0, NULL, NULL, NULL, NULL, NULL FROM t", "scores")
def classification_driver(spark, d) -> DataFrame:
    return _classified(spark, d).select("split", "class", "n", "tp", "tn", *(_r(F.col(c), c) for c in ("accuracy", "auroc", "auprc")))


@query(_CLASSES.replace("WITH m AS", _S2 + "m AS", 1) + " SELECT split, round(auroc, 6) AS macro_auroc, round(auprc, 6) AS macro_auprc FROM a", "scores")
def classification_macro(spark, d) -> DataFrame:
    return M.macro(_classified(spark, d)).select("split", _r(F.col("macro_auroc"), "macro_auroc"), _r(F.col("macro_auprc"), "macro_auprc"))


def _maps(spark, d) -> DataFrame:
    """(class, split, sample_id, pos, a, gt, inside): one picture for each supplier."""
    rows = X.read(spark, d, "lineitem")
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select(
        F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd").alias("class"), F.when(F.col("l_suppkey") % 3 == 0, "val").otherwise("test").alias("split"), F.col("l_suppkey").alias("sample_id"),
        pos.alias("pos"), ((F.col("l_quantity") * 2) / F.lit(101.0)).alias("a"), (F.col("l_partkey") % 3 == 0).alias("gt"), (F.col("l_linenumber") < 6).alias("inside"),
    )


_LOC = """WITH px AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS class, CASE WHEN l_suppkey % 3 = 0 THEN 'val' ELSE 'test' END AS split, l_suppkey AS sample_id, l_orderkey * 8 + l_linenumber AS pos, (l_quantity * 2) / 101.0::DOUBLE AS raw, l_partkey % 3 = 0 AS gt, l_linenumber < 6 AS inside FROM lineitem WHERE l_suppkey % 5 <> 0),
  nz AS (SELECT *, CASE WHEN inside AND hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END AS a FROM (SELECT *, min(CASE WHEN inside THEN raw END) OVER w AS lo, max(CASE WHEN inside THEN raw END) OVER w AS hi, sum(gt::INT) OVER w AS g FROM px WINDOW w AS (PARTITION BY sample_id)) WHERE g > 0)"""


@query(_LOC + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY a DESC, pos) AS t FROM nz WHERE inside),
  m AS (SELECT class, split, sample_id, sum(CASE WHEN gt THEN a ELSE 0 END) / (sum(a) + 1e-8) AS energy, max(CASE WHEN t = 1 THEN gt::INT END) AS pointing, 2 * count(CASE WHEN t <= g AND gt THEN 1 END) / (count(CASE WHEN t <= g THEN 1 END) + max(g) + 1e-8) AS topk_dice, 2 * count(CASE WHEN a >= 0.5 AND gt THEN 1 END) / (count(CASE WHEN a >= 0.5 THEN 1 END) + max(g) + 1e-8) AS dice FROM r GROUP BY ALL)
  SELECT class, split, count(*) AS n_cases, round(avg(energy), 6) AS energy, round(avg(pointing), 6) AS pointing, round(avg(topk_dice), 6) AS topk_dice, round(avg(dice), 6) AS dice FROM m GROUP BY ALL""")
def localisation_driver(spark, d) -> DataFrame:
    maps = _maps(spark, d)
    chosen = maps.select("class", "split", "sample_id").distinct().where("sample_id % 5 <> 0")
    out = G.localisation(maps, chosen)
    return out.select("class", "split", "n_cases", *(_r(F.col(f"mean_{c}"), c) for c in ("energy", "pointing", "topk_dice", "dice")))


@query(_LOC + """, t AS (SELECT i, i / 100.0::DOUBLE AS t FROM range(0, 101) x(i)), c AS (SELECT class, sample_id, i, count(CASE WHEN a >= t THEN 1 END) AS p, count(CASE WHEN a >= t AND gt THEN 1 END) AS x, count(CASE WHEN gt THEN 1 END) AS g FROM nz, t WHERE inside AND split = 'val' GROUP BY ALL),
  s AS (SELECT class, i, round(sum(x / (p + g - x + 1e-8)), 9) AS iou FROM c WHERE g > 0 GROUP BY ALL), best AS (SELECT class, i / 100.0::DOUBLE AS thr FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY iou DESC, i) = 1),
  m AS (SELECT class, split, sample_id, count(CASE WHEN a >= thr AND gt THEN 1 END) / (count(CASE WHEN a >= thr THEN 1 END) + max(g) - count(CASE WHEN a >= thr AND gt THEN 1 END) + 1e-8) AS iou FROM nz JOIN best USING (class) WHERE inside AND split = 'test' GROUP BY ALL)
  SELECT class, split, count(*) AS n_cases, round(avg(iou), 6) AS iou FROM m GROUP BY ALL""")
def localisation_optimised(spark, d) -> DataFrame:
    maps = _maps(spark, d)
    chosen = maps.select("class", "split", "sample_id").distinct().where("sample_id % 5 <> 0")
    return G.localisation(maps, chosen, optimise="val").select("class", "split", "n_cases", _r(F.col("mean_iou"), "iou"))


# ------------------------------------------------------------ metrics and pools


@query("SELECT label AS concept, pos::BIGINT AS pos, round(max(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def prompt_pool_max(spark, d) -> DataFrame:
    out = R.pooled(X.bank(spark, d), ["concept"], "raw", "max", normalise=False)
    return out.select("concept", F.posexplode("pooled").alias("pos", "x")).select("concept", (F.col("pos") + 1).cast("long").alias("pos"), _r(F.col("x"), "x"))


@query("SELECT round(avg(m), 6) AS mean FROM (SELECT avg(score) AS m FROM scores GROUP BY sample_id % 13)", "scores")
def batch_means(spark, d) -> DataFrame:
    return M.mean_of_means(X.scores(spark, d).withColumn("batch", F.col("sample_id") % 13), "batch", "score").select(_r(F.col("mean"), "mean"))


@query("SELECT sample_id, name, round(0.5 * score + CASE WHEN y = 1 THEN 2 * 0.25 ELSE 0 END, 6) AS loss FROM scores", "scores")
def combined_loss(spark, d) -> DataFrame:
    return X.scores(spark, d).select("sample_id", "name", _r(M.total_loss(F.col("score"), F.when(F.col("y") == 1, 0.25), 0.5, 2.0), "loss"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: (i % 3 - 1)::DOUBLE)) + 0.5, 6) AS a, round(list_sum(embedding::DOUBLE[]) - 1, 6) AS b FROM embeddings")
def projected_vectors(spark, d) -> DataFrame:
    rows = R.projected(X.read(spark, d, "embeddings"), "embedding", [[float(i % 3 - 1) for i in range(64)], [1.0] * 64], [0.5, -1.0])
    return rows.select("vec_id", _r(F.col("embedding")[0], "a"), _r(F.col("embedding")[1], "b"))


@query("SELECT vec_id, embedding[3] AS a, embedding[1] AS b, embedding[64] AS c FROM embeddings")
def picked_columns(spark, d) -> DataFrame:
    rows = X.read(spark, d, "embeddings").select(E.first_of(X.read(spark, d, "embeddings"), ["no_such_id", "vec_id", "label"]).alias("vec_id"), L.picked("embedding", R.head_map([str(i) for i in range(64)], ["2", "0", "63"])).alias("v"))
    return rows.select("vec_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"))


@query("SELECT split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 9 END, split) AS turn FROM (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'val' WHEN 'view' THEN 'train' ELSE event_type END AS split FROM events)")
def ordered_splits(spark, d) -> DataFrame:
    split = F.when(F.col("event_type") == "click", "val").when(F.col("event_type") == "view", "train").otherwise(F.col("event_type"))
    rows = X.read(spark, d, "events").select(split.alias("split")).distinct().agg(F.array_sort(F.collect_list(S.split_order(F.col("split")))).alias("s"))
    return rows.select(F.posexplode("s").alias("turn", "s")).select(F.col("s.name").alias("split"), (F.col("turn") + 1).cast("long").alias("turn"))


@query("SELECT vec_id, 64::BIGINT AS width, 1.0::DOUBLE AS length, 1::BIGINT AS n_equal FROM embeddings")
def stand_in_vectors(spark, d) -> DataFrame:
    """Stand-in vectors: of length 1, and the same for the same text whatever the row's place."""
    texts = X.read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("t"), (F.col("vec_id") % 10).cast("string")).alias("text"))
    one, two = R.hash_vectors(texts), R.hash_vectors(texts.repartition(3)).select("text", F.col("vector").alias("other")).distinct()
    both = one.join(two, "text").groupBy("vec_id").agg(F.first("vector").alias("vector"), F.count_if(F.col("vector") == F.col("other")).alias("n_equal"))
    return both.select("vec_id", F.size("vector").cast("long").alias("width"), _r(N.norm("vector"), "length", 4), "n_equal")


# ------------------------------------------------------------ pictures: vectors as 8 x 8 pictures


def _pictures(spark, d) -> DataFrame:
    return X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def _pixels_of(rows: DataFrame, pixels, *more: str) -> DataFrame:
    each = rows.select("vec_id", *more, F.posexplode(pixels).alias("pos", "x"))
    return each.withColumn("x", F.round("x", 6) + 0.0)


_PIC = "WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS i FROM embeddings)"
_STRETCH = _PIC + ", q AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY vec_id) SELECT vec_id, i AS pos, round(greatest(0, least(1, (v - lo) / (hi - lo))), 6) + 0.0 AS x FROM p JOIN q USING (vec_id)"


@query("SELECT vec_id, i::INT AS pos, round((x - m) / s, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i, list_avg(embedding::DOUBLE[]) AS m, list_stddev_samp(embedding::DOUBLE[]) AS s FROM embeddings)")
def picture_normalised(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.normalised("pixels", "cxr_per_image"))


def _channel_sql(table, value: str) -> str:
    cells = ", ".join(f"({c}, {m}::DOUBLE, {s}::DOUBLE)" for c, (m, s) in enumerate(zip(*table, strict=True)))
    return _PIC + f", big AS (SELECT vec_id, max(v) > 1.5 AS big FROM p GROUP BY vec_id) SELECT vec_id, (64 * c + i)::INT AS pos, round(({value} - m) / s, 6) + 0.0 AS x FROM p JOIN big USING (vec_id), (VALUES {cells}) t(c, m, s)"


@query(_channel_sql(I.IMAGENET, "v"))
def picture_imagenet(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.normalised("pixels", "imagenet"))


@query(_channel_sql(I.RAD_DINO, "(CASE WHEN big THEN v / 255 ELSE v END)").replace("AS v, unnest", "* (vec_id % 2 * 40 + 1) AS v, unnest"))
def picture_rad_dino(spark, d) -> DataFrame:
    """Every second picture goes far beyond 1.5, as one of bytes does."""
    rows = _pictures(spark, d).withColumn("pixels", F.transform("pixels", lambda v: v * (F.col("vec_id") % 2 * 40 + 1)))
    return _pixels_of(rows, I.normalised("pixels", "rad_dino_maira_2"))


@query(_PIC + " SELECT vec_id, i AS pos, round((v - 0.25) / 0.5, 6) + 0.0 AS x FROM p")
def picture_global(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.normalised("pixels", "cxr_global", mean=0.25, std=0.5))


@query(_STRETCH)
def picture_percentile(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.normalised("pixels", "cxr_percentile"))


@query(_PIC + " SELECT vec_id, i AS pos, round(v, 6) + 0.0 AS x FROM p")
def picture_none(spark, d) -> DataFrame:
    """Mode none, and a global one without a deviation: pixels stay as they are."""
    return _pixels_of(_pictures(spark, d), I.normalised(I.normalised("pixels", "none"), "cxr_global", mean=0.1))


@query(_STRETCH)
def picture_stretched(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.stretched("pixels"))


@query(_PIC.replace("AS v, unnest", "/ 2 + 0.5 AS v, unnest") + """, h AS (SELECT vec_id, i, greatest(0, least(1, v)) AS v FROM p), l AS (SELECT vec_id, least(floor(v / (1.0::DOUBLE / 32)), 31)::INT AS b FROM h),
  g AS (SELECT k.vec_id, g.b, count(CASE WHEN l.b <= g.b THEN 1 END) / 64.0::DOUBLE AS c FROM (SELECT DISTINCT vec_id FROM l) k, range(0, 32) g(b) JOIN l ON l.vec_id = k.vec_id GROUP BY ALL)
  SELECT h.vec_id, h.i AS pos, round(greatest(0, least(1, (a.c + (coalesce(z.c, a.c) - a.c) * (v * 32 - a.b) - o.c) / greatest(1 - o.c, 1e-12))), 6) + 0.0 AS x
  FROM h JOIN g a ON a.vec_id = h.vec_id AND a.b = least(floor(v * 32), 31) LEFT JOIN g z ON z.vec_id = h.vec_id AND z.b = a.b + 1 JOIN g o ON o.vec_id = h.vec_id AND o.b = 0""")
def picture_equalised(spark, d) -> DataFrame:
    """Equalised on 32 levels."""
    rows = _pictures(spark, d).withColumn("pixels", F.transform("pixels", lambda v: v / 2 + 0.5))
    return _pixels_of(I.equalised(rows, ["vec_id"], levels=32), F.col("pixels"))


@query("SELECT vec_id, 16 AS height, 24 AS width, i::INT AS pos, round(embedding[((i // 24) // 2) * 8 + (i % 24) // 3 + 1]::DOUBLE, 6) AS x FROM embeddings, range(0, 384) t(i)")
def picture_enlarged(spark, d) -> DataFrame:
    rows = _pictures(spark, d).withColumn("pixels", I.resized("pixels", "height", "width", 16, 24, "nearest")).withColumn("height", F.lit(16)).withColumn("width", F.lit(24))
    return _pixels_of(rows, F.col("pixels"), "height", "width").select("vec_id", "height", "width", "pos", "x")


def _box_sql(h: int, w: int, size: int, pad: str) -> str:
    """A picture's first h x w pixels, letterboxed: weights of a triangle on both axes."""
    return f"""WITH p AS (SELECT vec_id, unnest(embedding[1:{h * w}])::DOUBLE AS v, unnest(range(0, {h * w})) AS i FROM embeddings),
  s AS (SELECT {size}.0::DOUBLE / greatest({h}, {w}) AS scale), b AS (SELECT greatest(1, round_even({h} * scale, 0))::INT AS nh, greatest(1, round_even({w} * scale, 0))::INT AS nw FROM s),
  wy AS (SELECT o, k, greatest(0, 1 - abs(k + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {h} / nh) / greatest({h} / nh::DOUBLE, 1)) AS w FROM b, range(0, {size}) t(o), range(0, {h}) u(k) WHERE o < nh),
  wx AS (SELECT o, k, greatest(0, 1 - abs(k + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {w} / nw) / greatest({w} / nw::DOUBLE, 1)) AS w FROM b, range(0, {size}) t(o), range(0, {w}) u(k) WHERE o < nw),
  r AS (SELECT vec_id, wy.o AS y, wx.o AS x, sum(v * wy.w * wx.w) / sum(wy.w * wx.w) AS v FROM p JOIN wy ON wy.k = i // {w} JOIN wx ON wx.k = i % {w} GROUP BY ALL),
  c AS (SELECT vec_id, y, x FROM (SELECT DISTINCT vec_id FROM p), range(0, {size}) t(y), range(0, {size}) u(x))
  SELECT c.vec_id, (c.y * {size} + c.x)::INT AS pos, round(coalesce(v, {pad}), 6) + 0.0 AS x FROM c, b LEFT JOIN r ON r.vec_id = c.vec_id AND r.y = c.y - ({size} - nh) // 2 AND r.x = c.x - ({size} - nw) // 2"""


@query(_box_sql(7, 9, 6, "-1"))
def picture_letterboxed(spark, d) -> DataFrame:
    """7 x 9 pixels made smaller, averaged, and padded above and below."""
    rows = _pictures(spark, d).select("vec_id", F.slice("pixels", 1, 63).alias("pixels"), F.lit(7).alias("height"), F.lit(9).alias("width"))
    return _pixels_of(rows, I.squared("pixels", "height", "width", 6, pad=-1.0))


@query(_box_sql(8, 8, 5, "0"))
def picture_scaled(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.squared("pixels", "height", "width", 5, keep=False))


@query("SELECT p_partkey, count(CASE WHEN y BETWEEN y0 AND y0 + nh - 1 AND x BETWEEN x0 AND x0 + nw - 1 THEN 1 END) AS n_inside, min(CASE WHEN y BETWEEN y0 AND y0 + nh - 1 AND x BETWEEN x0 AND x0 + nw - 1 THEN y * 12 + x END)::BIGINT AS first FROM (SELECT *, (12 - nh) // 2 AS y0, (12 - nw) // 2 AS x0 FROM (SELECT p_partkey, greatest(1, round_even(h * (12.0::DOUBLE / greatest(h, w)), 0))::INT AS nh, greatest(1, round_even(w * (12.0::DOUBLE / greatest(h, w)), 0))::INT AS nw FROM (SELECT p_partkey, p_size * 37 + 5 AS h, (p_partkey % 900 + 60)::INT AS w FROM part))), range(0, 12) t(y), range(0, 12) u(x) GROUP BY p_partkey")
def evaluated_region(spark, d) -> DataFrame:
    rows = X.read(spark, d, "part").select("p_partkey", I.evaluated(F.col("p_size") * 37 + 5, F.col("p_partkey") % 900 + 60, 12).alias("inside"))
    return rows.select("p_partkey", F.size(F.filter("inside", lambda v: v)).cast("long").alias("n_inside"), (F.array_position("inside", True) - 1).alias("first"))


@query("""SELECT vec_id, i::INT AS pos, round(e[y0 * 8 + x0 + 1] * (1 - fy) * (1 - fx) + e[y0 * 8 + x1 + 1] * (1 - fy) * fx + e[y1 * 8 + x0 + 1] * fy * (1 - fx) + e[y1 * 8 + x1 + 1] * fy * fx, 6) + 0.0 AS x FROM (
  SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, least(floor(sy)::INT + 1, 7) AS y1, least(floor(sx)::INT + 1, 7) AS x1, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM (
    SELECT vec_id, embedding::DOUBLE[] AS e, i, greatest((i // 20 + 0.5) * 0.4 - 0.5, 0) AS sy, greatest((i % 20 + 0.5) * 0.4 - 0.5, 0) AS sx FROM embeddings, range(0, 400) t(i)))""")
def attention_raised(spark, d) -> DataFrame:
    return _pixels_of(_pictures(spark, d), I.raised("pixels", "height", "width", 20))


@query("SELECT vec_id, i AS pos, CAST(floor(greatest(0, least(1, v / 2 + 0.5)) * 65535 + 0.5) AS BIGINT) AS x, CASE WHEN vec_id % 7 = 0 THEN 'bad' END AS error FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64))::INT AS i FROM embeddings) WHERE vec_id % 7 <> 0 OR i = 0".replace("CAST(floor", "CASE WHEN vec_id % 7 <> 0 THEN CAST(floor").replace("AS BIGINT) AS x", "AS BIGINT) END AS x"))
def picture_files(spark, d) -> DataFrame:
    """Pictures as PNG files' bytes, read again to the pixel; every seventh is cut off, and is a row with an error."""
    rows = _pictures(spark, d).withColumn("pixels", F.transform("pixels", lambda v: v / 2 + 0.5))
    files = Y.encoded(rows, bits=16).select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.expr("substring(content, 1, 60)")).otherwise(F.col("content")).alias("content"))
    out = Y.decoded(files)
    each = out.select("vec_id", F.explode(F.when(F.col("error").isNull(), F.transform("pixels", lambda x, i: F.struct(i.alias("pos"), F.floor(x.cast("double") * 65535 + 0.5).alias("x")))).otherwise(F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("long").alias("x"))))).alias("c"), "error")
    return each.select("vec_id", "c.pos", "c.x", F.when(F.col("error").isNotNull(), "bad").alias("error"))


@query("SELECT vec_id, embedding[17]::DOUBLE AS first, embedding[32]::DOUBLE AS last FROM embeddings")
def attention_lookup(spark, d) -> DataFrame:
    maps = X.read(spark, d, "embeddings").select(F.lit("test").alias("split"), F.col("vec_id").alias("sample_id"), F.array(*map(F.lit, "abcd")).alias("names"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.col("embedding").alias("values"))
    out = O.attention_of(maps, "b")
    return out.select(F.col("sample_id").alias("vec_id"), F.col("grid")[0].cast("double").alias("first"), F.col("grid")[15].cast("double").alias("last"))


# ------------------------------------------------------------ stores


@query("SELECT doc_id AS accession, string_agg(CAST(y AS VARCHAR), '' ORDER BY idx) AS labels, string_agg(CASE WHEN valid THEN '1' ELSE '0' END, '' ORDER BY idx) AS masks FROM labelled GROUP BY doc_id", "labelled")
def label_store(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    wide = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("y").cast("float").alias("y"), "valid"))).alias("c"))
    wide = wide.select(F.col("doc_id").alias("accession"), F.transform("c", lambda x: x["y"]).alias("labels"), F.transform("c", lambda x: x["valid"]).alias("masks"))
    both = wide.select("accession", F.lit(0).alias("shard"), F.lit(1).alias("row"), "labels", "masks").unionAll(wide.select("accession", F.lit(1), F.lit(0), F.transform("labels", lambda x: x * 0 + F.lit(9).cast("float")), "masks"))
    print_ = X.concepts(spark).agg(N.fingerprint(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"])).alias("f")).first()["f"]
    out = O.label_store(both, X.CONCEPTS, fingerprint=print_)
    bits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    return out.select("accession", bits("labels").alias("labels"), bits("masks").alias("masks"))


@query("SELECT vec_id AS sop_uid, label FROM embeddings WHERE vec_id % 3 = 0")
def image_store(spark, d) -> DataFrame:
    images = X.read(spark, d, "embeddings").withColumnRenamed("vec_id", "sop_uid")
    return O.image_store(images, images.where("sop_uid % 3 = 0").select("sop_uid")).select("sop_uid", "label")


@query("""SELECT v.vec_id AS sop_uid, v.vec_id % 40 AS accession, 2::BIGINT AS n_fields, CASE WHEN (v.vec_id % 40) % 4 = 0 THEN 9 ELSE v.vec_id % 40 END::BIGINT AS label FROM embeddings v""")
def sample_rows(spark, d) -> DataFrame:
    vec = X.read(spark, d, "embeddings")
    index = vec.select(F.col("vec_id").alias("sop_uid"), (F.col("vec_id") % 40).alias("accession"))
    images = vec.select(F.col("vec_id").alias("sop_uid"), F.col("embedding").alias("pixels"))
    texts = O.field_map(spark.range(40).select(F.col("id").alias("accession"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"), F.array(F.lit(1.0)).alias("vector")))
    labels = spark.range(40).select(F.col("id").alias("accession"), F.array(F.col("id")).alias("labels"), F.array(F.lit(True)).alias("masks"))
    other = labels.where("accession % 4 = 0").select("accession", F.array(F.lit(9).cast("long")).alias("labels"), "masks")
    out = O.samples(index, images, texts, labels, other, strict=True)
    return out.select("sop_uid", "accession", F.size("vectors").cast("long").alias("n_fields"), F.col("labels")[0].alias("label"))


@query("SELECT vec_id, 'root/' || vec_id || '.npy' AS path, vec_id % 2 = 0 AS has_file, CASE WHEN vec_id % 2 = 0 THEN 'root/' || vec_id || '.npy' ELSE 'val/' || vec_id || '.npy' END AS found FROM embeddings WHERE vec_id % 10 <> 5")
def file_paths(spark, d) -> DataFrame:
    rows = X.read(spark, d, "embeddings").select("vec_id")
    name = lambda root: F.concat(F.lit(root), F.col("vec_id").cast("string"), F.lit(".npy"))
    listing = rows.where("vec_id % 2 = 0").select(name("root/").alias("path")).unionAll(rows.where("vec_id % 10 <> 5").select(name("val/")))
    found = O.resolved(rows, [name("root/"), name("test/"), name("val/")], listing, "vec_id").withColumnRenamed("path", "found")
    return O.paths(rows, "root", listing, name="vec_id").join(found, "vec_id").select("vec_id", "path", "has_file", "found")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND n_chars > 100")
def required_flags(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("has_image"), (F.col("n_chars") > 100).alias("has_text"))
    return O.required(rows, ["has_image", "has_text"]).select("doc_id")


@query("SELECT shard FROM (SELECT DISTINCT CAST(vec_id // 50 AS INT) AS shard FROM embeddings) WHERE shard % 3 <> 1 AND shard % 4 <> 2")
def whole_shards(spark, d) -> DataFrame:
    shard = X.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("int").alias("shard")).distinct()
    return O.complete_shards([shard, shard.where("shard % 3 <> 1"), shard.where("shard % 4 <> 2")])


@query("SELECT 'sharded' AS images, 'pt' AS labels, 'sharded' AS asked, 'pt' AS old, (SELECT count(*) FROM customer) AS n_files")
def storage_layout(spark, d) -> DataFrame:
    """Listings of a file for each customer: of shards in one directory, of single files in another."""
    keys = X.read(spark, d, "customer")
    kind = F.element_at(F.array(*map(F.lit, ("meta", "images", "labels"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    files = keys.select(F.concat(F.lit("x/"), kind, F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.when(kind == "meta", ".parquet").otherwise(".npy")).alias("path"))
    old = keys.select(F.concat(F.lit("x/"), F.col("c_custkey").cast("string"), F.lit(".pt")).alias("path"))
    made = [O.layout(files, "images"), O.layout(old, "labels"), O.layout(old, "images", "sharded"), O.layout(old, "images")]
    return files.agg(*(F.lit(m).alias(n) for m, n in zip(made, ("images", "labels", "asked", "old"), strict=True)), F.count("*").alias("n_files"))


@query("SELECT shard, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last, sum(row)::BIGINT AS rows FROM (SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 40)::INT + 3 AS shard, (row_number() OVER (ORDER BY c_custkey) - 1) % 40 AS row FROM customer) GROUP BY shard")
def stamped_shards(spark, d) -> DataFrame:
    """Written in whole shards from number 3, read again."""
    at = place(spark, "shards")
    K.shards(X.read(spark, d, "customer").select("c_custkey"), at, ["c_custkey"], shard_rows=40, start=3)
    return spark.read.parquet(at).groupBy("shard").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"), F.sum("row").alias("rows"))


@query("SELECT vec_id, true AS near, 128::BIGINT AS n_bytes FROM embeddings")
def half_floats(spark, d) -> DataFrame:
    rows = X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    kept = K.halves(rows, "v")
    back = K.floats(kept, "v").select("vec_id", F.col("v").alias("w"))
    near = F.forall(F.zip_with("v", "w", lambda a, b: F.abs(a - b) <= F.abs(a) * 0.001 + 1e-6), lambda x: x)
    return rows.join(back, "vec_id").join(kept.select("vec_id", F.length("v").alias("n")), "vec_id").select("vec_id", near.alias("near"), F.col("n").cast("long").alias("n_bytes"))


@query("SELECT c_custkey, 2 AS next FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r >= 80")
def resumed_shards(spark, d) -> DataFrame:
    """Two whole shards of 40 and a half one are written: the half one and the rest are still to do."""
    rows = P.positions(X.read(spark, d, "customer").select("c_custkey"), ["c_custkey"], "at")
    written = rows.where("at < 100").select((F.floor(F.col("at") / 40)).cast("int").alias("shard"), "c_custkey")
    todo, number = O.resumed_after(rows.select("c_custkey"), written, 40, "c_custkey", ["c_custkey"])
    return todo.select("c_custkey", F.lit(number).alias("next"))


# ------------------------------------------------------------ readers and sinks in round trips


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, lang AS examination, sha1(regexp_replace(text, '\\r', '', 'g')) AS digest FROM documents WHERE doc_id % 4 > 0 AND text IS NOT NULL AND trim(regexp_replace(text, '\\r', '', 'g')) NOT IN ('', 'NA', 'null')".replace("\\\\", "\\"))
def csv_reports(spark, d) -> DataFrame:
    """Reports written as CSV with quoted cells of several lines, ids with blanks or missing, and read again."""
    at = place(spark, "reports")
    rows = X.read(spark, d, "documents").where("text is not null").withColumn("text", F.regexp_replace("text", "\r", ""))
    rows = rows.where(~F.trim("text").isin("", "NA", "null"))
    made = rows.select(F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.concat(F.lit(" "), F.col("doc_id").cast("string"))).alias("report_id"), F.col("lang").alias("examination"), F.col("text").alias("report_text"))
    made.write.option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at, header=True)
    return E.reports(spark, at).select("report_id", "examination", F.sha1(F.col("report_text").cast("binary")).alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, doc_id % 3 = 1 AS has_json, CASE WHEN doc_id % 3 = 1 THEN CAST(n_chars AS VARCHAR) END AS n FROM documents")
def json_directory(spark, d) -> DataFrame:
    """Structured documents of a directory by id, a file each; a third is missing, a third malformed."""
    at = place(spark, "documents")
    rows = X.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("report_id"), "doc_id", F.to_json(F.struct("n_chars")).alias("doc"))
    some = rows.where("doc_id % 3 > 0").select(F.concat("report_id", F.lit("_structured.json")).alias("file"), F.when(F.col("doc_id") % 3 == 2, "{broken").otherwise(F.col("doc")).alias("doc"))
    K.named_files(some, at, "file", "doc")
    out = E.json_documents(spark, at, rows.select("report_id"))
    return out.select("report_id", "has_json", F.get_json_object("doc", "$.n_chars").alias("n"))


def _json_files(rows: DataFrame, name: str) -> str:
    """Rows (value) as files of one JSON text each."""
    at = place(rows.sparkSession, name)
    rows.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return at


def _wrapped(key: str, map_: Column) -> Column:
    return F.concat(F.lit(f'{{"{key}":'), F.to_json(map_), F.lit("}")).alias("value")


@query("SELECT p_type AS name, arg_min('no ' || p_name || ' seen', p_partkey) AS first, count(*) AS n FROM part WHERE p_partkey % 3 > 0 GROUP BY p_type")
def sentence_pools(spark, d) -> DataFrame:
    """A wrapped sentence file of the parts by type; empty sentences are left out, blanks made one."""
    said = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" no "), "p_name", F.lit("  seen")))
    rows = X.read(spark, d, "part").groupBy("p_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", said.alias("s")))), lambda x: x["s"]).alias("pool"))
    at = _json_files(rows.agg(_wrapped("concept_texts", F.map_from_entries(F.collect_list(F.struct("p_type", "pool"))))), "pools")
    return E.pools(spark, at, "concept_texts").select("name", F.col("pool")[0].alias("first"), F.size("pool").cast("long").alias("n"))


@query("SELECT p_brand AS name, p_size >= 25 AS positive, (row_number() OVER (PARTITION BY p_brand, p_size >= 25 ORDER BY p_partkey) - 1)::INT AS idx, p_name AS text FROM part")
def prompt_file(spark, d) -> DataFrame:
    """Prompts of both sides for each brand."""
    side = F.when(F.col("p_size") >= 25, "positive").otherwise("negative")
    rows = X.read(spark, d, "part").groupBy("p_brand", side.alias("side")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("texts"))
    rows = rows.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("side", "texts"))).alias("sides"))
    at = _json_files(rows.agg(_wrapped("concept_prompts", F.map_from_entries(F.collect_list(F.struct("p_brand", "sides"))))), "prompts")
    return E.prompts(spark, at)


@query("WITH n AS (SELECT 0 AS pos, 'NATION_3' AS name UNION ALL SELECT 1, 'b' UNION ALL SELECT 2 + n_nationkey, n_name FROM nation) SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, name FROM (SELECT name, min(pos) AS pos FROM n GROUP BY name)")
def concept_file(spark, d) -> DataFrame:
    """Inline names first, then the file's; first occurrences, comments and blanks out."""
    names = X.read(spark, d, "nation").agg(F.concat(F.lit("# note\n\n "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " \n")).alias("value"))
    return E.concepts(spark, _json_files(names, "concepts"), " NATION_3, b ,NATION_3").select(F.col("idx").cast("long").alias("idx"), "name")


@query("SELECT s_name AS concept, s_suppkey % 100 / 100.0::DOUBLE AS thr_f1, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS thr_j FROM supplier")
def threshold_file(spark, d) -> DataFrame:
    """Thresholds of the suppliers in a file for each nation, some without the second."""
    row = F.struct((F.col("s_suppkey") % 100 / 100).alias("thr_f1"), F.when(F.col("s_suppkey") % 2 == 0, 0.5).alias("thr_j"))
    rows = X.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_name"), row.alias("t"))))).alias("value"))
    return E.thresholds(spark, _json_files(rows, "thresholds"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS image_id, 'class' || l_orderkey % 3 AS class, count(*)::BIGINT AS height, 50::BIGINT AS width, sum(CASE WHEN r % 2 = 0 THEN q ELSE 0 END)::BIGINT AS area FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_quantity AS q FROM lineitem) GROUP BY l_orderkey")
def mask_file(spark, d) -> DataFrame:
    """Run-length masks of the orders, in files of a thousand, and their areas."""
    rows = X.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("runs"))
    rows = G.with_encoded(rows.select("l_orderkey", F.transform("runs", lambda r: r["l_quantity"].cast("long")).alias("runs")))
    mask = F.create_map(F.concat(F.lit("class"), (F.col("l_orderkey") % 3).cast("string")), F.struct(F.array(F.size("runs"), F.lit(50)).alias("size"), F.col("counts")))
    files = rows.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("l_orderkey").cast("string"), mask.alias("m"))))).alias("value"))
    out = G.with_runs(E.masks(spark, _json_files(files, "masks")))
    return out.select("image_id", "class", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), G.area(F.col("runs")).alias("area"))


@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, split FROM splits", "splits")
def split_file(spark, d) -> DataFrame:
    """A split table by another key name, with blanks, each id twice: the first row counts."""
    rows = X.splits(spark, d).select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("accession"), F.concat("split", F.lit(" ")).alias("split"))
    both = rows.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("split", F.when(F.col("turn") == 2, "other").otherwise(F.col("split")))
    return E.split_map(both.orderBy("accession", "turn"))


@query("SELECT user_id AS report_id, event_type AS reason, count(*) AS n FROM events WHERE event_id % 9 = 0 GROUP BY ALL")
def failure_log(spark, d) -> DataFrame:
    """Appended in two runs, read again."""
    at = place(spark, "log")
    rows = X.read(spark, d, "events").where("event_id % 9 = 0").select(F.col("user_id").alias("report_id"), F.col("event_type").alias("reason"), F.lit("-").alias("detail"), "event_id")
    K.log(rows.where("event_id % 2 = 0"), at)
    K.log(rows.where("event_id % 2 = 1"), at)
    return spark.read.schema("report_id long, reason string, detail string").json(at).groupBy("report_id", "reason").agg(F.count("*").alias("n"))


@query("SELECT 'val' AS split, arg_max(epoch, (v, -epoch))::BIGINT AS epoch, round(max(v), 6) AS value FROM (SELECT event_id % 20 AS epoch, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL)")
def metric_logs(spark, d) -> DataFrame:
    """A metric log written by split; the best epoch read from it."""
    at = place(spark, "metrics")
    rows = X.read(spark, d, "events").groupBy((F.col("event_id") % 20).alias("epoch"), F.when(F.col("event_id") % 2 == 0, "val").otherwise("train").alias("split")).agg(F.avg("value").alias("value"))
    K.metric_log(rows.select(F.col("epoch").alias("step"), "epoch", F.lit("auroc").alias("metric"), "value", F.lit(0.0).alias("walltime"), "split"), at)
    best = M.best_epoch(spark.read.parquet(at), "auroc")
    return best.select("split", F.col("epoch").cast("long").alias("epoch"), _r(F.col("value"), "value"))


@query("SELECT name AS concept, split, count(*) AS n, round(avg(score), 6) AS value FROM scores JOIN splits ON doc_id = sample_id GROUP BY ALL", "scores", "splits")
def concept_logs(spark, d) -> DataFrame:
    at = place(spark, "concepts")
    rows = X.scores(spark, d).join(X.splits(spark, d, "sample_id"), "sample_id")
    K.concept_log(rows.select(F.lit(1).alias("step"), F.lit(1).alias("epoch"), F.col("name").alias("concept"), F.lit("score").alias("metric"), F.col("score").alias("value"), F.lit(0.0).alias("walltime"), "split"), at)
    return spark.read.parquet(at).groupBy("concept", "split").agg(F.count("*").alias("n"), _r(F.avg("value"), "value"))


@query("SELECT n_nationkey AS report_id, n_name AS name FROM nation")
def document_per_id(spark, d) -> DataFrame:
    """A document file for each id, the second writing of some ids in place of the first."""
    at = place(spark, "perid")
    rows = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("report_id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("doc"))
    K.document_files(rows.withColumn("doc", F.lit('{"name":"old"}')), at)
    K.document_files(rows, at)
    return spark.read.text(at).select(F.col("report_id").cast("long").alias("report_id"), F.get_json_object("value", "$.name").alias("name"))


@query("SELECT c_custkey, c_custkey * 2 AS twice FROM customer")
def built_once(spark, d) -> DataFrame:
    """An index made where it is missing, and only read the second time."""
    at = place(spark, "index")
    rows = X.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 2).alias("twice"))
    K.built(spark, at, lambda: rows)
    return K.built(spark, at, lambda: rows.limit(0))


@query("SELECT doc_id, count(*) AS n, max(batch)::BIGINT AS batch FROM (SELECT doc_id, 0 AS batch FROM documents) GROUP BY doc_id")
def resumed_stream(spark, d) -> DataFrame:
    """Documents as a stream that stops and goes on: each is written once, only what is pending is asked for."""
    at = place(spark, "stream")
    docs = X.read(spark, d, "documents").select("doc_id")
    docs.where("doc_id % 2 = 0").write.parquet(f"{at}/in")
    for _ in range(2):
        stream = U.files(spark, f"{at}/in", "doc_id long")
        U.run_available(stream, U.idempotent_append(f"{at}/out", "doc_id"), f"{at}/check")
        have = spark.read.parquet(f"{at}/out").select("doc_id")
        U.pending(docs, have, "doc_id").write.mode("append").parquet(f"{at}/in") if have.count() < docs.count() else None
    return spark.read.parquet(f"{at}/out").groupBy("doc_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("batch"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d) -> DataFrame:
    return U.windowed(X.read(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r(F.col("total"), "total", 4))


# ------------------------------------------------------------ services


@query("SELECT doc_id AS report_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'plain ' || lang END AS answer, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM documents")
def asked_with_degradation(spark, d) -> DataFrame:
    """A service that refuses an option (400) is asked again without it; answers that stay invalid are kept."""
    rows = X.read(spark, d, "documents").select(F.col("doc_id").alias("report_id"), "lang", "doc_id")
    asked = V.requests(rows.withColumn("id", F.col("doc_id").cast("string")), "system", "{id} {lang}", id="id", lang="lang")

    def provider():
        class Refused(Exception):
            status = 400

        async def chat(messages, guided=False):
            if guided:
                raise Refused("unknown option")
            number, lang = messages[1]["content"].split(" ", 1)
            return "bad" if int(number) % 5 == 0 else f"plain {lang}"

        return chat

    out = V.asked(asked, provider, lambda t: "say it plainly" if t == "bad" else None, tries=2, pause=0.0, features={"guided": True})
    return out.select("report_id", "status", "answer", "attempts")


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 2, 5) AS score FROM embeddings")
def scored_by_model(spark, d) -> DataFrame:
    """The scoring hook with a batch model of its own."""
    def model():
        return lambda vectors: [[v[0] * 2] for v in vectors.to_pylist()]

    out = V.scored(X.read(spark, d, "embeddings").select("vec_id", "embedding"), model, ["embedding"])
    return out.select("vec_id", _r(F.col("scores")[0].cast("double"), "score", 5))
