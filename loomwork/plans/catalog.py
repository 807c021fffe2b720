"""The named queries, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import documents as D
from loomwork.functions import numeric as N
from loomwork.functions import text as T
from loomwork.operators import grounding as G
from loomwork.operators import labels as L
from loomwork.operators import metrics as M
from loomwork.operators import retrieval as R
from loomwork.operators import splits as P
from loomwork.operators import stats as S
from loomwork.operators import stores as O
from loomwork.plans import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = X.sql(sql, *views)
        return f

    return add


def _r(c, name: str, places: int = 6):
    return F.round(c, places).alias(name)


# ------------------------------------------------------------ strings, numbers


@query(r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS cleaned, CAST(length(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS BIGINT) AS n FROM pages")
def text_clean(spark, d) -> DataFrame:
    c = T.clean("html")
    return X.read(spark, d, "pages").select("page_id", c.alias("cleaned"), F.length(c).cast("long").alias("n"))


@query("SELECT source, lang, sha1(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def text_sha1_dedup(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").select("source", "lang", F.sha1(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return S.first_per_key(rows, ["source", "lang", "digest"], ["doc_id"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'structured.' ELSE '' END || lower(p_type) || '.' || p_name AS field, replace(replace(lower(p_type) || '.' || p_name, '.', '_'), ' ', '_') AS safe FROM part")
def norm_field(spark, d) -> DataFrame:
    """Names with a prefix, with two of them, or without."""
    name = F.concat(F.lower("p_type"), F.lit("."), "p_name")
    n = F.col("p_partkey") % 4
    raw = F.when(n == 0, F.concat(F.lit("structured."), name)).when(n == 1, F.concat(F.lit("structured.structured."), name)).otherwise(name)
    return X.read(spark, d, "part").select("p_partkey", T.field(raw).alias("field"), T.safe_name(name).alias("safe"))


@query("SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x, i: x <> '' AND list_position(list_transform(string_split(raw, ','), lambda y: trim(y)), x) = i) AS list_distinct_ordered FROM (SELECT doc_id, lang || ', ' || source || ',,' || lang || ' ,x' AS raw FROM documents))")
def csv_list_parse(spark, d) -> DataFrame:
    raw = F.concat("lang", F.lit(", "), "source", F.lit(",,"), "lang", F.lit(" ,x"))
    return X.read(spark, d, "documents").select("doc_id", F.array_join(T.listed(raw), "|").alias("items"))


@query("SELECT doc_id, name, pool[1 + CAST('0x' || substr(sha1('42|' || CAST(doc_id AS VARCHAR) || '|' || name), 1, 8) AS BIGINT) % 3] AS sentence FROM documents, pools", "pools")
def deterministic_pick(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").select("doc_id").crossJoin(F.broadcast(X.pools(spark)))
    return rows.select("doc_id", "name", N.pick(F.col("pool"), 42, F.col("doc_id").cast("string"), F.col("name")).alias("sentence"))


@query("SELECT s_nationkey, sha1(string_agg(s_name, '|' ORDER BY s_suppkey)) AS digest, count(*) AS k FROM supplier GROUP BY s_nationkey")
def concept_fingerprint(spark, d) -> DataFrame:
    """The suppliers of a nation as an ordered list of names."""
    rows = X.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("c"), F.count("*").alias("k"))
    return rows.select("s_nationkey", N.fingerprint(F.transform("c", lambda x: x["s_name"])).alias("digest"), "k")


@query("SELECT doc_id, name, CASE WHEN label IN ('0', '1', '2', '3') THEN CAST(label AS BIGINT) END AS number, label = 'not present' AS absent, label IN ('0', '1') AS binary_label FROM leaves", "leaves")
def label_parse(spark, d) -> DataFrame:
    return X.leaves(spark, d).select("doc_id", "name", N.numeric_label("label").cast("long").alias("number"), T.is_absent("label").alias("absent"), N.is_binary("label").alias("binary_label"))


@query("SELECT event_id, step, round(CASE WHEN step < 100 THEN 0.001 * step / 100 ELSE 0.0005 * (1 + cos(pi() * least(1, (step - 100) / 900.0::DOUBLE))) END, 12) AS rate FROM (SELECT event_id, event_id % 1001 AS step FROM events)")
def learning_rates(spark, d) -> DataFrame:
    """The rate of each event as a step of a run."""
    rows = X.read(spark, d, "events").select("event_id", (F.col("event_id") % 1001).alias("step"))
    return rows.select("event_id", "step", _r(N.learning_rate("step", 0.001, 100, 1000), "rate", 12))


@query("SELECT page_id, replace(split_part(url, '/', 3), '.', '_') AS host, CASE WHEN contains(lower(url), '/en/') THEN 'en' WHEN contains(lower(url), '/fr/') THEN 'fr' END AS lang, 'see ' || url || ' now' AS said FROM pages")
def url_fields(spark, d) -> DataFrame:
    low = F.lower("url")
    return X.read(spark, d, "pages").select("page_id", T.safe_name(F.get(F.split("url", "/"), F.lit(2))).alias("host"), F.when(low.contains("/en/"), "en").when(low.contains("/fr/"), "fr").alias("lang"), T.filled("see {u} now", u=F.col("url")).alias("said"))


# ------------------------------------------------------------ documents


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaves(spark, d) -> DataFrame:
    rows = X.read(spark, d, "events").select("event_id", F.col("props").alias("doc"))
    return D.text_leaves(rows, "doc").select("event_id", "path", "text")


def _document(spark, d) -> DataFrame:
    """(doc_id, doc): leaves as nested JSON."""
    cell = lambda i: F.struct(F.max(F.when(F.col("idx") == i, F.col("text"))).alias("text"), F.max(F.when(F.col("idx") == i, F.col("label"))).alias("label"))
    rows = X.leaves(spark, d).groupBy("doc_id").agg(*(cell(i).alias(f"c{i}") for i in range(len(X.CONCEPTS))))
    return rows.select("doc_id", D.nested({f"data.{c}": F.col(f"c{i}") for i, c in enumerate(X.CONCEPTS)}).alias("doc"))


@query("SELECT doc_id, 'data.' || name AS path, text, label FROM leaves", "leaves")
def struct_leaves(spark, d) -> DataFrame:
    return D.labelled_leaves(_document(spark, d), "doc").select("doc_id", "path", "text", "label")


@query("SELECT doc_id, max(CASE WHEN name = 'thoracic_organs.heart' THEN label END) AS heart, max(CASE WHEN name = 'support_devices.airway' THEN label END) AS airway, CAST(NULL AS VARCHAR) AS nothing FROM leaves GROUP BY doc_id", "leaves")
def path_lookup(spark, d) -> DataFrame:
    rows = _document(spark, d)
    return rows.select("doc_id", D.at_path("doc", "thoracic_organs.heart").alias("heart"), D.at_path("doc", "support_devices.airway").alias("airway"), D.at_path("doc", "thoracic_organs.none").alias("nothing"))


@query("SELECT doc_id, 'data.' || name AS path, 'not allowed' AS problem FROM leaves WHERE label = '3' UNION ALL SELECT doc_id, 'data.extra.leaf', 'missing' FROM documents", "leaves")
def schema_violations(spark, d) -> DataFrame:
    kinds = {f"data.{c}": (("present", "not present") if c.startswith("support") else (0, 1, 2)) for c in X.CONCEPTS}
    return D.violations(_document(spark, d), "doc", kinds | {"data.extra.leaf": (0,)}).select("doc_id", "path", "problem")


# ------------------------------------------------------------ labels and imputation


_KINDS = ['{"label":2.0}', '{"label":"2.0"}', "true", '"true"', '"Present "', '{"label":"not present","text":"x"}', '"3"', "1", "0", "{}", "[1]", "null", "broken", '{"label":false}']


@query("SELECT event_id, (k IN (0, 4, 6))::BIGINT AS label, k IN (0, 2, 4, 5, 6, 7) AS valid FROM (SELECT event_id, event_id % 14 AS k FROM events)")
def label_kinds(spark, d) -> DataFrame:
    """Labels by their JSON type: strings of numbers other than digits, lists, empty objects and broken text are masked."""
    doc = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    y, valid = L.json_label(doc)
    return X.read(spark, d, "events").select("event_id", y.cast("long").alias("label"), valid.alias("valid"))


@query("SELECT doc_id, name, y::BIGINT AS label, valid FROM labelled", "labelled")
def label_map(spark, d) -> DataFrame:
    return _labelled(spark, d).select("doc_id", "name", F.col("y").cast("long").alias("label"), "valid")


def _labelled(spark, d) -> DataFrame:
    y, valid = L.label_and_mask(F.col("label"))
    return X.leaves(spark, d).withColumn("y", y).withColumn("valid", valid)


@query("SELECT doc_id, name, count(*) OVER w - 1 AS n_other, round((sum(CASE WHEN sev <> 0 THEN 1 ELSE 0 END) OVER w - CASE WHEN sev <> 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / (count(*) OVER w - 1), 6) AS ratio FROM path WINDOW w AS (PARTITION BY doc_id)", "path")
def label_context(spark, d) -> DataFrame:
    return L.with_context(X.pathology(X.leaves(spark, d)), F.col("sev") != 0).select("doc_id", "name", "n_other", _r(F.col("ratio"), "ratio"))


def _quota(spark, d) -> DataFrame:
    rows = X.concepts(spark)
    return rows.select("name", (F.lit(20) + F.col("idx")).alias("quota"))


@query("""SELECT name, count(*) AS n_eligible, count(CASE WHEN turn <= 20 + idx THEN 1 END) AS n_imputed, min(CASE WHEN turn <= 20 + idx THEN doc_id END) AS first_doc FROM
  (SELECT e.doc_id, e.name, c.idx, row_number() OVER (PARTITION BY e.name ORDER BY sha1('42|' || CAST(e.doc_id AS VARCHAR) || '|' || e.name), e.doc_id) AS turn FROM eligible e JOIN concepts c USING (name)) GROUP BY name""", "eligible")
def label_extraction_balanced(spark, d) -> DataFrame:
    rows = L.eligible_labels(X.pathology(X.leaves(spark, d))).select("doc_id", "name")
    both = L.quota_flags(rows, _quota(spark, d))
    return both.groupBy("name").agg(F.count("*").alias("n_eligible"), F.count_if("chosen").alias("n_imputed"), F.min(F.when(F.col("chosen"), F.col("doc_id"))).alias("first_doc"))


@query("""SELECT l.doc_id, string_agg(CASE WHEN e.doc_id IS NULL AND valid THEN CAST(y AS VARCHAR) ELSE '0' END, '' ORDER BY idx) AS labels, string_agg(CASE WHEN valid OR e.doc_id IS NOT NULL THEN '1' ELSE '0' END, '' ORDER BY idx) AS masks,
  sum(CASE WHEN valid OR e.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_valid, sum(CASE WHEN e.doc_id IS NOT NULL AND NOT valid THEN 1 ELSE 0 END)::BIGINT AS n_imputed, coalesce(string_agg(CASE WHEN e.doc_id IS NOT NULL AND NOT valid THEN l.name END, '|' ORDER BY idx), '') AS imputed_targets
  FROM labelled l LEFT JOIN eligible e ON l.doc_id = e.doc_id AND l.name = e.name GROUP BY l.doc_id""", "labelled", "eligible")
def label_vectors(spark, d) -> DataFrame:
    rows = _labelled(spark, d).select("doc_id", "idx", "name", F.col("y").alias("label"), "valid")
    out = L.vectors(rows, L.eligible_labels(X.pathology(X.leaves(spark, d))))
    bits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    return out.select("doc_id", bits("labels").alias("labels"), bits("masks").alias("masks"), F.col("n_valid").cast("long").alias("n_valid"), F.col("n_imputed").cast("long").alias("n_imputed"), "imputed_targets")


@query("SELECT doc_id, 'structured.' || name AS field, pool[1 + CAST('0x' || substr(sha1('42|' || CAST(doc_id AS VARCHAR) || '|' || name), 1, 8) AS BIGINT) % 3] AS text, 'rule1' AS imputation_rule FROM leaves JOIN pools USING (name) WHERE starts_with(name, 'support_devices.') AND text = '' AND label = 'not present'", "leaves", "pools")
def text_impute_rule1(spark, d) -> DataFrame:
    return L.imputed_units(L.eligible_devices(X.leaves(spark, d), X.pools(spark))).select("doc_id", "field", "text", "imputation_rule")


_RULE2 = """WITH ctx AS (SELECT *, (sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w - CASE WHEN text <> '' THEN 1 ELSE 0 END) * 100.0::DOUBLE / (count(*) OVER w - 1) AS ratio FROM path WINDOW w AS (PARTITION BY doc_id))
  SELECT doc_id, name, pool[1 + CAST('0x' || substr(sha1('42|' || CAST(doc_id AS VARCHAR) || '|' || name), 1, 8) AS BIGINT) % 3] AS text FROM ctx JOIN pools USING (name) WHERE text = '' AND label IN ('0', '1') AND ratio >= 50"""


@query(_RULE2, "path", "pools")
def text_impute_rule2(spark, d) -> DataFrame:
    rows = L.eligible_texts(X.pathology(X.leaves(spark, d)), X.pools(spark), threshold=50.0)
    return L.imputed_units(rows, rule="rule2").select("doc_id", T.field(F.col("field")).alias("name"), "text")


def _units(spark, d, **options) -> DataFrame:
    leaves = X.leaves(spark, d)
    made = L.eligible_devices(leaves, X.pools(spark)).select("doc_id", F.col("idx").alias("at"), "name", N.pick(F.col("pool"), 42, F.col("doc_id").cast("string"), F.col("name")).alias("text"))
    reports = X.read(spark, d, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("full"))
    return L.units(reports, leaves.select("doc_id", F.col("idx").alias("at"), "name", "text"), made, report="doc_id", **options)


@query("""WITH made AS (SELECT doc_id, idx, name, pool[1 + CAST('0x' || substr(sha1('42|' || CAST(doc_id AS VARCHAR) || '|' || name), 1, 8) AS BIGINT) % 3] AS text FROM leaves JOIN pools USING (name) WHERE starts_with(name, 'support_devices.') AND text = '' AND label = 'not present'),
  own AS (SELECT doc_id, 2 AS rank, idx, name, text FROM leaves WHERE text <> '' UNION ALL SELECT doc_id, 3, idx, name, text FROM made),
  whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY rank, idx) AS text FROM own GROUP BY doc_id)
  SELECT doc_id, 'structured.' || name AS field, text, rank = 3 AS is_imputed FROM own
  UNION ALL SELECT doc_id, 'unstructured.full', lang || ' ' || source, false FROM documents
  UNION ALL SELECT doc_id, 'structured.full', text, false FROM whole
  UNION ALL SELECT d.doc_id, 'report.full', d.lang || ' ' || d.source || coalesce(' ' || w.text, ''), false FROM documents d LEFT JOIN whole w USING (doc_id)
  UNION ALL SELECT doc_id, 'structured.grouped.pathologies.lung', string_agg(text, ' ; ' ORDER BY rank, idx), false FROM own WHERE starts_with(name, 'pathologies.lung.') GROUP BY doc_id""", "leaves", "pools")
def units_union(spark, d) -> DataFrame:
    return _units(spark, d, groups=("pathologies.lung",)).select("doc_id", "field", "text", "is_imputed")


@query("SELECT doc_id, string_agg(text, ' ; ' ORDER BY idx) AS text FROM leaves WHERE text <> '' AND starts_with(name, 'pathologies.pleura.') GROUP BY doc_id", "leaves")
def grouped_texts(spark, d) -> DataFrame:
    leaves = X.leaves(spark, d).select("doc_id", F.col("idx").alias("at"), "name", "text")
    reports = X.read(spark, d, "documents").select("doc_id", F.lit("").alias("full"))
    return L.units(reports, leaves, level="leaf", groups=("pathologies.pleura",), report="doc_id").where("source = 'grouped'").select("doc_id", "text")


# ------------------------------------------------------------ statistics


_STATS = """WITH total AS (SELECT split, count(DISTINCT report_id) AS n_total FROM units JOIN splits ON report_id = doc_id GROUP BY split),
  have AS (SELECT split, name, count(DISTINCT report_id) AS n_with FROM units JOIN splits ON report_id = doc_id WHERE NOT is_imputed GROUP BY ALL)
  SELECT t.split, c.name, coalesce(n_with, 0) AS n_with, n_total - coalesce(n_with, 0) AS n_without, n_total FROM total t CROSS JOIN concepts c LEFT JOIN have h ON h.split = t.split AND h.name = c.name"""


@query(_STATS, "units", "splits")
def text_stats(spark, d) -> DataFrame:
    return _text_stats(spark, d)


def _text_stats(spark, d) -> DataFrame:
    return S.text_counts(X.units(spark, d), X.concepts(spark), X.splits(spark, d, "report_id"))


@query("""SELECT split, name, count(CASE WHEN valid THEN 1 END) AS n_valid, count(CASE WHEN valid AND y = 1 THEN 1 END) AS n_pos, count(CASE WHEN valid AND y = 0 THEN 1 END) AS n_neg, count(CASE WHEN NOT valid THEN 1 END) AS n_masked, count(CASE WHEN sev = 3 THEN 1 END) AS n_imputed, count(*) AS n_total,
  round(coalesce(100.0::DOUBLE * count(CASE WHEN valid AND y = 1 THEN 1 END) / nullif(count(CASE WHEN valid THEN 1 END), 0), 0), 6) AS pos_rate_pct, round(100.0::DOUBLE * count(CASE WHEN NOT valid THEN 1 END) / count(*), 6) AS masked_rate_pct FROM labelled JOIN splits USING (doc_id) GROUP BY split, name""", "labelled", "splits")
def label_stats(spark, d) -> DataFrame:
    rows = _labelled(spark, d).select("doc_id", "name", F.col("y").cast("double").alias("label"), "valid", (F.col("sev") == 3).alias("imputed"))
    out = S.label_counts(rows, X.splits(spark, d))
    return out.withColumn("pos_rate_pct", F.round("pos_rate_pct", 6)).withColumn("masked_rate_pct", F.round("masked_rate_pct", 6))


@query("WITH u AS (SELECT DISTINCT report_id, name FROM units JOIN splits ON report_id = doc_id WHERE NOT is_imputed) SELECT c.name, CAST(count(u.name) AS BIGINT) AS quota FROM concepts c LEFT JOIN u USING (name) GROUP BY c.name", "units", "splits")
def concept_quotas(spark, d) -> DataFrame:
    return S.quotas(_text_stats(spark, d))


@query("WITH u AS (SELECT name, count(DISTINCT CASE WHEN NOT is_imputed THEN report_id END) AS n, count(CASE WHEN is_imputed THEN 1 END) AS done FROM units JOIN splits ON report_id = doc_id GROUP BY name) SELECT c.name, CAST(greatest(coalesce(n, 0) - coalesce(done, 0), 0) AS BIGINT) AS quota FROM concepts c LEFT JOIN u USING (name)", "units", "splits")
def remaining_quotas(spark, d) -> DataFrame:
    written = X.units(spark, d).where("is_imputed").join(X.splits(spark, d, "report_id"), "report_id", "left_semi")
    return S.remaining(S.quotas(_text_stats(spark, d)), written)


@query("SELECT name, count(*) AS n FROM units WHERE is_imputed GROUP BY name", "units")
def imputed_value_counts(spark, d) -> DataFrame:
    return X.units(spark, d).where("is_imputed").groupBy("name").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT doc_id, string_agg(name, ' | ' ORDER BY idx) AS targets FROM eligible JOIN concepts USING (name) GROUP BY doc_id) SELECT trim(x) AS name, count(*) AS n FROM (SELECT unnest(string_split(targets, '|')) AS x FROM t) GROUP BY ALL", "eligible")
def provenance_counts(spark, d) -> DataFrame:
    rows = L.eligible_labels(X.pathology(X.leaves(spark, d))).groupBy("doc_id").agg(F.array_join(F.collect_list("name"), " | ").alias("targets"))
    return S.token_counts(rows, "targets", X.concepts(spark))


@query("SELECT report_id, string_agg(DISTINCT name, ',' ORDER BY name) AS concepts FROM units GROUP BY report_id", "units")
def coverage(spark, d) -> DataFrame:
    return S.covered(X.units(spark, d)).select("report_id", F.array_join("concepts", ",").alias("concepts"))


@query("SELECT name, count(CASE WHEN valid AND y = 1 THEN 1 END) AS n_pos, count(CASE WHEN valid AND y = 0 THEN 1 END) AS n_neg FROM labelled WHERE valid GROUP BY name", "labelled")
def class_counts(spark, d) -> DataFrame:
    return S.class_counts(_labelled(spark, d).select("name", F.col("y").alias("label"), "valid"))


@query("SELECT event_type, CAST(bin AS BIGINT) AS bin, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type), 6) AS cdf FROM (SELECT event_type, least(floor((value - 0) / (100.0::DOUBLE / 20)), 19) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL)")
def hist_cdf(spark, d) -> DataFrame:
    out = S.histogram(X.read(spark, d, "events"), "value", 20, 0.0, 100.0, ["event_type"])
    return out.select("event_type", F.col("bin").cast("long").alias("bin"), "n", _r(F.col("cdf"), "cdf"))


@query("SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS largest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.01), 6) AS q1, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY event_type")
def value_spread(spark, d) -> DataFrame:
    out = S.spread(X.read(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", *(_r(F.col(c), c) for c in ("least", "largest", "mean", "deviation", "q1", "q99")))


@query("SELECT count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_O, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_F, count(*) AS n_total FROM orders")
def status_counts(spark, d) -> DataFrame:
    return S.statuses(X.read(spark, d, "orders"), "o_orderstatus", ("O", "F"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type)")
def event_rollup(spark, d) -> DataFrame:
    """An extension: totals by rollup."""
    return X.read(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), _r(F.avg("value"), "mean"))


# ------------------------------------------------------------ joins, splits, samples


@query("SELECT l_orderkey AS accession, l_linenumber::BIGINT AS image, o_custkey AS patient, c_mktsegment AS view FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def master_index(spark, d) -> DataFrame:
    images = X.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").cast("long").alias("image"))
    reports = X.read(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("patient"))
    patients = X.read(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("view"))
    return images.join(reports.where("patient is not null"), "accession").join(patients.where(F.col("view").isin("BUILDING", "MACHINERY")), "patient").select("accession", "image", "patient", "view")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_report FROM customer")
def availability_semi(spark, d) -> DataFrame:
    keys = X.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return X.read(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_report"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_processed_anti(spark, d) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id").join(X.read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_occurrence_index(spark, d) -> DataFrame:
    return S.first_per_key(X.read(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def key_index(spark, d) -> DataFrame:
    return P.positions(X.read(spark, d, "customer").select("c_custkey"), ["c_custkey"], "position")


_SPLIT = "WITH g AS (SELECT c_custkey, row_number() OVER (ORDER BY sha1('42|' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer), s AS (SELECT c_custkey, CASE WHEN r < round_even(n * 0.1, 0) THEN 'test' WHEN r < round_even(n * 0.1, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM g)"


@query(_SPLIT + " SELECT c_custkey, split FROM s")
def group_split(spark, d) -> DataFrame:
    return P.group_split(X.read(spark, d, "customer"), "c_custkey", val=0.2, test=0.1)


@query(_SPLIT + " SELECT o_orderkey FROM orders JOIN s ON o_custkey = c_custkey WHERE split = 'val'")
def apply_split(spark, d) -> DataFrame:
    made = P.group_split(X.read(spark, d, "customer"), "c_custkey", val=0.2, test=0.1).withColumnRenamed("c_custkey", "o_custkey")
    return P.apply_split(X.read(spark, d, "orders"), made, "o_custkey", "val").select("o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT name, count(DISTINCT report_id) / (SELECT n FROM n)::DOUBLE AS cov FROM units GROUP BY name),
  m AS (SELECT name, CASE WHEN cov < 0.45 THEN greatest(0, 0.6 / cov - 1) ELSE 0 END AS more FROM c)
  SELECT d.doc_id AS report_id, round(1 + coalesce(sum(more), 0), 6) AS weight FROM documents d LEFT JOIN (SELECT DISTINCT report_id, name FROM units) u ON u.report_id = d.doc_id LEFT JOIN m USING (name) GROUP BY d.doc_id""", "units")
def sample_weights(spark, d) -> DataFrame:
    reports = X.read(spark, d, "documents").select(F.col("doc_id").alias("report_id"))
    return P.coverage_weights(reports, X.units(spark, d), target=0.6, rare=0.45).select("report_id", _r(F.col("weight"), "weight"))


@query("SELECT doc_id FROM documents ORDER BY sha1('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def exact_sample(spark, d) -> DataFrame:
    return P.exact_sample(X.read(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha1('7|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.25")
def share_sample(spark, d) -> DataFrame:
    return P.share_sample(X.read(spark, d, "documents").select("doc_id"), "doc_id", 0.25, 7)


@query("""WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY substr(sha1(CAST(doc_id AS VARCHAR)), 1, 2), doc_id ROWS UNBOUNDED PRECEDING) AS hi, sum(n_chars) OVER () AS total FROM documents),
  u AS (SELECT i AS draw, CAST('0x' || substr(sha1('42|' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(0, 1000) t(i)) SELECT draw, doc_id FROM u JOIN o ON u * total >= hi - n_chars AND u * total < hi""")
def weighted_draw(spark, d) -> DataFrame:
    rows = X.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("w"))
    return P.weighted_draw(rows, "doc_id", "w", 1000)


# ------------------------------------------------------------ metrics


@query("""SELECT name, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT name, count(CASE WHEN y = 1 AND score >= 0.5 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND score >= 0.5 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND score < 0.5 THEN 1 END) AS fn, count(CASE WHEN y = 0 AND score < 0.5 THEN 1 END) AS tn FROM scores GROUP BY name)""", "scores")
def confusion(spark, d) -> DataFrame:
    out = M.confusion(X.scores(spark, d).withColumn("pred", (F.col("score") >= 0.5).cast("int")), ["name"])
    return out.select("name", "tp", "fp", "fn", "tn", *(_r(F.nanvl(c, F.lit(None).cast("double")), c) for c in ("precision", "recall", "f1")))


_STEPS = "WITH e AS (SELECT name, score, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y <> 1 THEN 1 END) AS n FROM scores GROUP BY ALL), s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY name) AS pp, sum(n) OVER (PARTITION BY name) AS nn FROM e WINDOW w AS (PARTITION BY name ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("WITH r AS (SELECT name, y, rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1) / 2.0::DOUBLE AS r FROM scores) SELECT name, round((sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0::DOUBLE) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y <> 1 THEN 1 END)), 6) AS auroc FROM r GROUP BY name", "scores")
def auroc(spark, d) -> DataFrame:
    return M.ranking(X.scores(spark, d), ["name"]).select("name", _r(F.col("auroc"), "auroc"))


@query(_STEPS + " SELECT name, round(sum(p * tp::DOUBLE / (tp + fp)) / max(pp), 6) AS auprc FROM s GROUP BY name", "scores")
def average_precision(spark, d) -> DataFrame:
    return M.ranking(X.scores(spark, d), ["name"]).select("name", _r(F.col("auprc"), "auprc"))


@query(_STEPS + ", f AS (SELECT name, score, 2 * tp::DOUBLE / (tp + fp + pp) AS f1 FROM s) SELECT name, round(f1, 6) AS best_f1, round(score, 6) AS best_thr FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY f1 DESC, score) = 1", "scores")
def best_f1_pr(spark, d) -> DataFrame:
    return M.ranking(X.scores(spark, d), ["name"]).select("name", _r(F.col("best_f1"), "best_f1"), _r(F.col("best_thr"), "best_thr"))


@query("""WITH g AS (SELECT i, i / 500.0::DOUBLE AS t FROM range(0, 501) r(i)), c AS (SELECT name, i, count(CASE WHEN y = 1 AND score >= t THEN 1 END) AS tp, count(CASE WHEN y <> 1 AND score >= t THEN 1 END) AS fp, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y <> 1 THEN 1 END) AS n FROM scores, g GROUP BY ALL),
  f AS (SELECT name, i, coalesce(2 * tp / nullif(tp + fp + p, 0)::DOUBLE, 0) AS f1, tp / p::DOUBLE + (n - fp) / n::DOUBLE - 1 AS j FROM c)
  SELECT a.name, a.i / 500.0::DOUBLE AS thr_f1, round(a.f1, 6) AS f1, b.i / 500.0::DOUBLE AS thr_j, round(b.j, 6) AS j FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY f1 DESC, i) = 1) a JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY j DESC, i) = 1) b ON a.name = b.name""", "scores")
def best_threshold_grid(spark, d) -> DataFrame:
    out = M.grid_thresholds(X.scores(spark, d), ["name"])
    return out.select("name", "thr_f1", _r(F.col("f1"), "f1"), "thr_j", _r(F.col("j"), "j"))


@query("SELECT sample_id, 'any' AS class, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS pred, round(max(score), 6) AS prob FROM scores GROUP BY sample_id", "scores")
def class_mapping_max(spark, d) -> DataFrame:
    mapping = spark.createDataFrame([("quality", "any"), ("toxic", "any")], "name string, class string")
    rows = X.scores(spark, d).select("sample_id", "name", (F.col("score") >= 0.5).cast("long").alias("pred"), F.col("score").alias("prob"))
    return M.class_scores(rows, mapping).select("sample_id", "class", "pred", _r(F.col("prob"), "prob"))


@query("SELECT round(avg(CASE WHEN y = 1 THEN score END), 6) AS mean FROM scores", "scores")
def macro_nanmean(spark, d) -> DataFrame:
    rows = X.scores(spark, d).withColumn("v", F.when(F.col("y") == 1, F.col("score")).otherwise(float("nan")))
    return rows.agg(_r(S.nan_mean("v"), "mean"))


@query("SELECT name, round(pow((1 - p) / p, 0.5), 6) AS tempered, round((neg + 1) / (pos + 1)::DOUBLE, 6) AS plain FROM (SELECT name, count(CASE WHEN valid AND y = 1 THEN 1 END) AS pos, count(CASE WHEN valid AND y = 0 THEN 1 END) AS neg, (count(CASE WHEN valid AND y = 1 THEN 1 END) + 1) / (count(CASE WHEN valid THEN 1 END) + 2)::DOUBLE AS p FROM labelled GROUP BY name)", "labelled")
def pos_weight_tempered(spark, d) -> DataFrame:
    counts = S.class_counts(_labelled(spark, d).select("name", F.col("y").alias("label"), "valid"))
    return counts.select("name", _r(N.tempered_weight("n_pos", "n_neg", 0.5), "tempered"), _r(N.plain_weight("n_pos", "n_neg"), "plain"))


@query("WITH l AS (SELECT name, 2.0::DOUBLE * (y * 0.9 + 0.05) * ln(1 + exp(-(4 * score - 2))) + (1 - (y * 0.9 + 0.05)) * ln(1 + exp(4 * score - 2)) AS loss FROM scores WHERE sample_id % 5 <> 0) SELECT round(avg(loss), 6) AS plain, round((SELECT avg(m) FROM (SELECT avg(loss) AS m FROM l GROUP BY name)), 6) AS balanced FROM l", "scores")
def masked_bce(spark, d) -> DataFrame:
    rows = X.scores(spark, d).select("name", (4 * F.col("score") - 2).alias("z"), "y", (F.col("sample_id") % 5 != 0).alias("valid"), F.lit(2.0).alias("weight"))
    return M.masked_bce(rows, smoothing=0.1).select(_r(F.col("plain"), "plain"), _r(F.col("balanced"), "balanced"))


_PAIRS = """WITH e AS (SELECT vec_id, vec_id // 50 AS batch, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-6)) AS a FROM e),
  z AS (SELECT x.batch, x.label, x.vec_id AS i, y.vec_id AS k, list_dot_product(x.a, list_concat(y.a[2:], y.a[1:1])) / 0.1 AS z FROM u x JOIN u y ON x.batch = y.batch AND x.label = y.label),
  r AS (SELECT batch, label, i, ln(sum(exp(z))) - max(CASE WHEN i = k THEN z END) AS loss FROM z GROUP BY ALL), c AS (SELECT batch, label, k, ln(sum(exp(z))) - max(CASE WHEN i = k THEN z END) AS loss FROM z GROUP BY ALL),
  b AS (SELECT batch, label, n, (a + back) / 2 AS loss FROM (SELECT batch, label, avg(loss) AS a, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT batch, label, avg(loss) AS back FROM c GROUP BY ALL) USING (batch, label) WHERE n > 1)"""


def _contrast(spark, d) -> DataFrame:
    e = X.read(spark, d, "embeddings")
    turned = F.concat(F.slice("embedding", 2, 64), F.slice("embedding", 1, 1))
    rows = e.select(F.floor(F.col("vec_id") / 50).alias("batch"), F.col("label").alias("name"), F.col("vec_id").alias("sample"), F.col("embedding").alias("v"), turned.alias("u"))
    return M.info_nce(rows, tau=0.1)


@query(_PAIRS + " SELECT round(avg(loss), 6) AS macro FROM b")
def infonce_macro(spark, d) -> DataFrame:
    return _contrast(spark, d).select(_r(F.col("macro"), "macro"))


@query(_PAIRS + " SELECT round(sum(loss * n) / sum(n), 6) AS weighted FROM b")
def infonce_pair(spark, d) -> DataFrame:
    return _contrast(spark, d).select(_r(F.col("weighted"), "weighted"))


@query(_PAIRS.replace("/ 0.1 AS z", "/ (CASE WHEN x.label % 2 = 0 THEN 0.05 + 0.05 * x.label ELSE 0.1 END) AS z") + " SELECT round(avg(loss), 6) AS macro, round(sum(loss * n) / sum(n), 6) AS weighted FROM b")
def infonce_taus(spark, d) -> DataFrame:
    """Every second concept with a temperature of its own."""
    e = X.read(spark, d, "embeddings")
    turned = F.concat(F.slice("embedding", 2, 64), F.slice("embedding", 1, 1))
    rows = e.select(F.floor(F.col("vec_id") / 50).alias("batch"), F.col("label").alias("name"), F.col("vec_id").alias("sample"), F.col("embedding").alias("v"), turned.alias("u"))
    taus = e.where("label % 2 = 0").select(F.col("label").alias("name"), (0.05 + 0.05 * F.col("label")).alias("tau")).distinct()
    return M.info_nce(rows, tau=0.1, taus=taus).select(_r(F.col("macro"), "macro"), _r(F.col("weighted"), "weighted"))


# ------------------------------------------------------------ vectors, evidence


_SIMS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS a FROM e),
  s AS (SELECT q.vec_id AS query_id, q.label AS concept, b.vec_id AS text_idx, 'text ' || CAST(b.vec_id % 150 AS VARCHAR) AS text, list_dot_product(q.a, b.a) AS sim FROM u q JOIN u b ON q.label = b.label AND q.vec_id % 20 = 0),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, concept, text ORDER BY sim DESC, text_idx) = 1)"""


@query(_SIMS + " SELECT query_id, concept, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, text_idx) AS rank, round(sim, 6) AS sim, text FROM t QUALIFY rank <= 3")
def retrieval_topk(spark, d) -> DataFrame:
    return R.top_texts(X.queries(spark, d), X.bank(spark, d), 3).select("query_id", "concept", F.col("rank").cast("long").alias("rank"), _r(F.col("sim"), "sim"), "text")


_POOL = """WITH p AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)"""


@query(_POOL + " SELECT label AS concept, pos::BIGINT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p")
def prompt_pool_mean(spark, d) -> DataFrame:
    out = R.pooled(X.bank(spark, d), ["concept"], "raw")
    return out.select("concept", F.posexplode("pooled").alias("pos", "x")).select("concept", (F.col("pos") + 1).cast("long").alias("pos"), _r(F.col("x"), "x"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS a FROM e),
  m AS (SELECT label, vec_id % 2 = 0 AS side, pos, avg(x) AS x FROM (SELECT label, vec_id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM u) GROUP BY ALL),
  n AS (SELECT label, side, list(x / len ORDER BY pos) AS b FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label, side)) AS len FROM m) GROUP BY ALL)
  SELECT q.vec_id AS query_id, q.label AS concept, round(1 / (1 + exp(-(list_dot_product(q.a, p.b) - list_dot_product(q.a, g.b)) / 0.07)), 6) AS prob FROM u q JOIN n p ON p.label = q.label AND p.side JOIN n g ON g.label = q.label AND NOT g.side WHERE q.vec_id % 20 = 0""")
def zero_shot_prob(spark, d) -> DataFrame:
    prompts = X.bank(spark, d).select("concept", (F.col("text_idx") % 2 == 0).alias("positive"), "raw")
    return R.zero_shot(X.queries(spark, d), prompts).select("query_id", "concept", _r(F.col("prob"), "prob"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy, len(embedding[1:16])::BIGINT AS width FROM embeddings")
def mrl_truncate(spark, d) -> DataFrame:
    short = N.cut("embedding", 16)
    return X.read(spark, d, "embeddings").select("vec_id", _r(N.dot(short, short), "energy"), F.size(short).cast("long").alias("width"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS total FROM embeddings")
def l2_normalise(spark, d) -> DataFrame:
    return X.read(spark, d, "embeddings").withColumn("u", N.unit("embedding", 1e-12)).select("vec_id", _r(F.col("u")[0], "first"), _r(F.col("u")[63], "last"), _r(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), "total"))


@query("""SELECT doc_id AS report_id, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_present, string_agg(CASE WHEN text <> '' THEN '1' ELSE '0' END, '' ORDER BY idx) AS present, string_agg(CASE WHEN text <> '' THEN CAST(length(text) AS VARCHAR) ELSE '0' END, ',' ORDER BY idx) AS second
  FROM leaves GROUP BY doc_id HAVING n_present > 0""", "leaves")
def dense_matrix(spark, d) -> DataFrame:
    rows = X.units(spark, d).select("report_id", "name", F.array(F.lit(1.0), F.length("text").cast("double")).alias("vector"))
    out = R.dense(rows, X.concepts(spark), 2)
    return out.select("report_id", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_present"), F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("present"), F.array_join(F.transform("matrix", lambda v: v[1].cast("int").cast("string")), ",").alias("second"))


def _evidence(spark, d) -> DataFrame:
    rows = X.scores(spark, d).select(F.col("sample_id").alias("case_id"), F.when(F.col("name") == "toxic", "pathologies.toxic").otherwise("support_devices.quality").alias("concept"), F.col("score").alias("probability"))
    thr = spark.createDataFrame([("pathologies.toxic", 0.3, 0.4)], "concept string, thr_f1 double, thr_j double")
    found = rows.select("case_id", "concept", (F.col("case_id") % 3).cast("int").alias("rank"), (F.col("probability") / 2).alias("sim"), F.lit(0).alias("ord"), F.concat(F.lit("seen "), F.col("case_id").cast("string")).alias("text")).where("rank > 0")
    return R.evidence(rows, thr, found)


@query("""SELECT sample_id AS case_id, CASE WHEN name = 'toxic' THEN 'pathologies.toxic' ELSE 'support_devices.quality' END AS concept, round(score, 6) AS probability, CASE WHEN name = 'toxic' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS threshold, CASE WHEN name = 'toxic' THEN 'thr_f1' ELSE 'default' END AS threshold_source,
  CASE WHEN score >= CASE WHEN name = 'toxic' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END THEN 1 ELSE 0 END::BIGINT AS predicted, CASE WHEN name = 'toxic' THEN (CASE WHEN score >= 0.3::DOUBLE THEN 'pathological' ELSE 'not pathological' END) ELSE (CASE WHEN score >= 0.5::DOUBLE THEN 'present' ELSE 'not present' END) END AS label,
  CASE WHEN sample_id % 3 > 0 THEN 'seen ' || CAST(sample_id AS VARCHAR) ELSE '' END AS text FROM scores""", "scores")
def evidence_join(spark, d) -> DataFrame:
    out = _evidence(spark, d)
    return out.select("case_id", "concept", _r(F.col("probability"), "probability"), "threshold", "threshold_source", F.col("predicted").cast("long").alias("predicted"), "label", "text")


@query("SELECT user_id AS case_id, event_type AS concept, event_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 4 = 2 THEN 0 ELSE 1 END, event_id % 4, value DESC, event_id) AS t FROM events) WHERE t = 1")
def rank_select(spark, d) -> DataFrame:
    rows = X.read(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("concept"), (F.col("event_id") % 4).cast("int").alias("rank"), F.col("value").alias("sim"), F.col("event_id").alias("ord"))
    return R.best_match(rows, 2).select("case_id", "concept", "ord")


@query("""SELECT case_id, CASE WHEN t.sample_id IS NULL THEN '' ELSE CASE WHEN t.score >= 0.3::DOUBLE THEN 'pathological' ELSE 'not pathological' END END AS label FROM (SELECT DISTINCT sample_id AS case_id FROM scores) c LEFT JOIN (SELECT * FROM scores WHERE name = 'toxic') t ON t.sample_id = case_id""", "scores")
def payload_json(spark, d) -> DataFrame:
    out = R.payload(_evidence(spark, d), ["pathologies.toxic", "support_devices.quality"])
    return out.select("case_id", F.get_json_object("payload", "$.pathologies.toxic.label").alias("label"))


@query("""SELECT conv_id AS case_id, CASE WHEN max(s) = 2 THEN 'inconsistent' WHEN max(s) = 1 THEN 'unclear' ELSE 'consistent' END AS status, coalesce(string_agg(CASE WHEN s > 0 THEN 'p' || CAST(turn AS VARCHAR) || ': ' || role END, chr(10) ORDER BY 'p' || CAST(turn AS VARCHAR)), '') AS text FROM (SELECT *, CASE WHEN length(text) % 7 = 0 THEN 2 WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS s FROM conversations) GROUP BY conv_id""")
def overall_feedback(spark, d) -> DataFrame:
    n = F.length("text")
    status = F.when(n % 7 == 0, "inconsistent").when(n % 5 == 0, "unclear").otherwise("consistent")
    rows = X.read(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), status.alias("status"), F.col("role").alias("comment"))
    return R.feedback(rows)


@query("SELECT conv_id, 1 + count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles, sha1(string_agg(text, '|' ORDER BY turn)) AS said FROM conversations GROUP BY conv_id")
def chat_messages(spark, d) -> DataFrame:
    out = R.conversation(X.read(spark, d, "conversations"), "You are careful.")
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform(F.slice("messages", 2, 1_000_000), lambda m: m["role"]), ">").alias("roles"), F.sha1(F.array_join(F.transform(F.slice("messages", 2, 1_000_000), lambda m: m["content"]), "|").cast("binary")).alias("said"))


# ------------------------------------------------------------ grounding


@query("SELECT p_partkey, round(518.0::DOUBLE / greatest(h, w), 9) AS scale, greatest(1, round_even(h * (518.0::DOUBLE / greatest(h, w)), 0))::BIGINT AS nh, greatest(1, round_even(w * (518.0::DOUBLE / greatest(h, w)), 0))::BIGINT AS nw FROM (SELECT p_partkey, p_size * 37 + 5 AS h, (p_partkey % 900 + 60)::INT AS w FROM part)")
def letterbox_geometry(spark, d) -> DataFrame:
    rows = X.read(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 5).alias("h"), (F.col("p_partkey") % 900 + 60).cast("int").alias("w"))
    return rows.select("p_partkey", G.letterbox(F.col("h"), F.col("w"), 518).alias("b")).select("p_partkey", _r(F.col("b.scale"), "scale", 9), F.col("b.nh").cast("long").alias("nh"), F.col("b.nw").cast("long").alias("nw"))


def _pixels(spark, d) -> DataFrame:
    rows = X.read(spark, d, "lineitem")
    return rows.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), ((F.col("l_quantity") * 2) / F.lit(101.0)).alias("a"), (F.col("l_partkey") % 3 == 0).alias("gt"))


_PIX = "WITH px AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, (l_quantity * 2) / 101.0::DOUBLE AS a, l_partkey % 3 = 0 AS gt FROM lineitem)"


@query(_PIX + ", c AS (SELECT l_suppkey, count(CASE WHEN a >= 0.5 THEN 1 END) AS p, count(CASE WHEN gt THEN 1 END) AS g, count(CASE WHEN a >= 0.5 AND gt THEN 1 END) AS i FROM px GROUP BY l_suppkey) SELECT l_suppkey, i AS inter, round(2 * i / (p + g + 1e-8), 6) AS dice, round(i / (p + g - i + 1e-8), 6) AS iou FROM c")
def overlap_dice_iou(spark, d) -> DataFrame:
    out = G.overlap(_pixels(spark, d).withColumn("pred", F.col("a") >= 0.5), ["l_suppkey"])
    return out.select("l_suppkey", "inter", _r(F.col("dice"), "dice"), _r(F.col("iou"), "iou"))


@query(_PIX + """, t AS (SELECT i, i / 100.0::DOUBLE AS t FROM range(0, 101) r(i)), c AS (SELECT i, l_suppkey, count(CASE WHEN a >= t THEN 1 END) AS p, count(CASE WHEN gt THEN 1 END) AS g, count(CASE WHEN a >= t AND gt THEN 1 END) AS x FROM px, t GROUP BY ALL),
  s AS (SELECT i, sum(2 * x / (p + g + 1e-8)) AS dice, sum(x / (p + g - x + 1e-8)) AS iou FROM c WHERE g > 0 GROUP BY i) SELECT (SELECT i / 100.0::DOUBLE FROM s ORDER BY round(dice, 9) DESC, i LIMIT 1) AS thr_dice, round((SELECT max(dice) FROM s), 6) AS dice, (SELECT i / 100.0::DOUBLE FROM s ORDER BY round(iou, 9) DESC, i LIMIT 1) AS thr_iou, round((SELECT max(iou) FROM s), 6) AS iou""")
def threshold_sweep(spark, d) -> DataFrame:
    return G.sweep(_pixels(spark, d), ["l_suppkey"]).select("thr_dice", _r(F.col("dice"), "dice"), "thr_iou", _r(F.col("iou"), "iou"))


@query(ORACLE["overlap_dice_iou"])
def masks_overlap(spark, d) -> DataFrame:
    """The same on masks as compressed run lengths, a row a picture."""
    rows = G.pictures(_pixels(spark, d), ["l_suppkey"])
    rows = rows.select("l_suppkey", "gt", G.edges_of(F.transform("a", lambda x: x >= 0.5)).alias("pred"))
    coded = G.with_counts(G.with_counts(rows, "pred", "pred_counts"), "gt", "gt_counts").select("l_suppkey", "pred_counts", "gt_counts")
    out = G.mask_overlap(G.with_edges(G.with_edges(coded, "pred_counts", "pred"), "gt_counts", "gt"), ["l_suppkey"])
    return out.select("l_suppkey", "inter", _r(F.col("dice"), "dice"), _r(F.col("iou"), "iou"))


@query(ORACLE["threshold_sweep"])
def masks_sweep(spark, d) -> DataFrame:
    out = G.picture_sweep(G.pictures(_pixels(spark, d), ["l_suppkey"]), [])
    return out.select("thr_dice", _r(F.col("dice"), "dice"), "thr_iou", _r(F.col("iou"), "iou"))


_CASE = _PIX + """, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY a DESC, pos) AS t, sum(CASE WHEN gt THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS g, quantile_cont(a, 0.9) OVER (PARTITION BY l_suppkey) AS q FROM px),
  m AS (SELECT *, t <= greatest(1, g) AS top FROM r), k AS (SELECT l_suppkey, a, count(CASE WHEN gt THEN 1 END) AS hits, count(CASE WHEN NOT gt THEN 1 END) AS misses FROM px GROUP BY ALL),
  s AS (SELECT *, sum(hits) OVER w AS tp, sum(misses) OVER w AS fp, sum(hits) OVER (PARTITION BY l_suppkey) AS pos, sum(misses) OVER (PARTITION BY l_suppkey) AS neg FROM k WINDOW w AS (PARTITION BY l_suppkey ORDER BY a DESC)),
  rank AS (SELECT l_suppkey, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(misses * (tp - hits / 2)) / (max(pos) * max(neg)), 6) ELSE 'NaN'::DOUBLE END AS auroc, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(hits * tp / (tp + fp)) / max(pos), 6) ELSE 'NaN'::DOUBLE END AS auprc FROM s GROUP BY l_suppkey)"""


def _measures(mask: str, cut: str) -> str:
    return f""" SELECT l_suppkey, round(sum(CASE WHEN gt THEN a ELSE 0 END) / (sum(a) + 1e-8), 6) AS energy, max(CASE WHEN t = 1 THEN gt::INT END)::BIGINT AS pointing, round(2 * count(CASE WHEN top AND gt THEN 1 END) / (count(CASE WHEN top THEN 1 END) + max(g) + 1e-8), 6) AS topk_dice,
  round(count(CASE WHEN top AND gt THEN 1 END) / (count(CASE WHEN top THEN 1 END) + max(g) - count(CASE WHEN top AND gt THEN 1 END) + 1e-8), 6) AS topk_iou,
  round(2 * count(CASE WHEN {mask} AND gt THEN 1 END) / (count(CASE WHEN {mask} THEN 1 END) + max(g) + 1e-8), 6) AS dice, round(count(CASE WHEN {mask} AND gt THEN 1 END) / (count(CASE WHEN {mask} THEN 1 END) + max(g) - count(CASE WHEN {mask} AND gt THEN 1 END) + 1e-8), 6) AS iou,
  round(max({cut}), 6) AS threshold, any_value(auroc) AS auroc, any_value(auprc) AS auprc FROM m JOIN rank USING (l_suppkey) GROUP BY l_suppkey"""


def _measured(out: DataFrame) -> DataFrame:
    return out.select("l_suppkey", F.col("pointing").cast("long").alias("pointing"), *(_r(F.col(c), c) for c in ("energy", "topk_dice", "topk_iou", "dice", "iou", "threshold", "auroc", "auprc")))


@query(_CASE + _measures("a >= 0.5", "0.5::DOUBLE"))
def case_metrics(spark, d) -> DataFrame:
    return _measured(G.case_metrics(_pixels(spark, d), ["l_suppkey"]))


@query(ORACLE["case_metrics"])
def masks_case_metrics(spark, d) -> DataFrame:
    return _measured(G.picture_metrics(G.pictures(_pixels(spark, d), ["l_suppkey"]), ["l_suppkey"]))


@query(_CASE + _measures("a >= q", "q"))
def masks_case_percentile(spark, d) -> DataFrame:
    return _measured(G.picture_metrics(G.pictures(_pixels(spark, d), ["l_suppkey"]), ["l_suppkey"], method="percentile", percentile=90.0))


@query(_CASE + _measures("a >= q", "q"))
def case_metrics_percentile(spark, d) -> DataFrame:
    return _measured(G.case_metrics(_pixels(spark, d), ["l_suppkey"], method="percentile", percentile=90.0))


@query(_CASE + _measures("top", "'NaN'::DOUBLE"))
def case_metrics_topk(spark, d) -> DataFrame:
    return _measured(G.case_metrics(_pixels(spark, d), ["l_suppkey"], method="topk"))


@query(_PIX + " SELECT l_suppkey, pos, round(CASE WHEN hi > lo THEN (a - lo) / (hi - lo) ELSE 0 END, 6) AS a FROM (SELECT *, min(a) OVER w AS lo, max(a) OVER w AS hi FROM px WINDOW w AS (PARTITION BY l_suppkey))")
def attention_normalised(spark, d) -> DataFrame:
    return G.normalised(_pixels(spark, d).withColumn("inside", F.lit(True)), ["l_suppkey"]).select("l_suppkey", "pos", _r(F.col("a"), "a"))


@query("SELECT l_orderkey, sum(CASE WHEN r % 2 = 0 THEN q ELSE 0 END)::BIGINT AS area FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_quantity AS q FROM lineitem) GROUP BY l_orderkey")
def rle_area(spark, d) -> DataFrame:
    rows = X.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("runs"))
    rows = rows.select("l_orderkey", F.transform("runs", lambda r: r["l_quantity"].cast("long")).alias("runs"))

    coded = G.with_encoded(rows).select("l_orderkey", "counts")
    return G.with_runs(coded).select("l_orderkey", G.area(F.col("runs")).alias("area"))


# ------------------------------------------------------------ stores, runs, the whole job


@query("SELECT o_orderstatus AS shard, CAST(max(o_orderkey) AS BIGINT) AS last_key, count(*) AS n_rows FROM orders GROUP BY ALL")
def last_in_shard(spark, d) -> DataFrame:
    return O.last_in_shard(X.read(spark, d, "orders").withColumnRenamed("o_orderstatus", "shard"), "shard", "o_orderkey", "o_orderkey")


@query("SELECT l_orderkey AS accession, l_linenumber::BIGINT AS field, max_by(q, -r) AS first FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem WHERE l_linenumber <= 3) GROUP BY ALL")
def embedding_store(spark, d) -> DataFrame:
    rows = X.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").cast("long").alias("field"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.array("l_quantity").alias("vector"))
    return O.embedding_store(rows, [1, 2, 3], order=("l_partkey", "l_suppkey", "q")).select("accession", "field", F.col("vector")[0].alias("first"))


@query("SELECT doc_id FROM splits WHERE split = 'val' UNION ALL SELECT doc_id + 1000000 FROM splits", "splits")
def split_or_all(spark, d) -> DataFrame:
    rows = X.splits(spark, d)
    return O.split_or_all(rows, "val").select("doc_id").unionAll(O.split_or_all(rows, "nothing").select(F.col("doc_id") + 1000000))


@query("""WITH v AS (SELECT l.doc_id, sum(CASE WHEN valid OR e.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS n_valid, sum(CASE WHEN e.doc_id IS NOT NULL AND NOT valid THEN 1 ELSE 0 END) AS n_imputed FROM labelled l LEFT JOIN eligible e ON l.doc_id = e.doc_id AND l.name = e.name GROUP BY l.doc_id)
  SELECT count(*) AS n_reports, count(*) AS n_with_json, 0::BIGINT AS n_errors, CAST(sum(n_valid) AS BIGINT) AS n_valid, count(CASE WHEN n_imputed > 0 THEN 1 END) AS n_reports_imputed, CAST(sum(n_imputed) AS BIGINT) AS n_imputed FROM v""", "labelled", "eligible")
def run_summary(spark, d) -> DataFrame:
    rows = _labelled(spark, d).select("doc_id", "idx", "name", F.col("y").alias("label"), "valid")
    out = L.vectors(rows, L.eligible_labels(X.pathology(X.leaves(spark, d))))
    return O.run_summary(out.withColumn("has_json", F.lit(True)).withColumn("error", F.lit(None).cast("string")))


@query("SELECT c_custkey, s AS seed FROM customer, (VALUES (1), (2), (3)) t(s)")
def seed_sweep(spark, d) -> DataFrame:
    return O.seeds(X.read(spark, d, "customer").select("c_custkey"), [1, 2, 3])


@query("""WITH base AS (SELECT split, name, count(*) AS n FROM path JOIN splits USING (doc_id) WHERE text <> '' GROUP BY ALL), quota AS (SELECT name, sum(n) AS quota FROM base GROUP BY name),
  chosen AS (SELECT doc_id, name FROM (SELECT e.doc_id, e.name, quota, row_number() OVER (PARTITION BY e.name ORDER BY sha1('42|' || CAST(e.doc_id AS VARCHAR) || '|' || e.name), e.doc_id) AS turn FROM eligible e JOIN quota USING (name)) WHERE turn <= quota)
  SELECT split, p.name, count(CASE WHEN y.valid OR c.doc_id IS NOT NULL THEN 1 END) AS n_valid, count(CASE WHEN c.doc_id IS NOT NULL AND NOT y.valid THEN 1 END) AS n_imputed, count(*) AS n_total
  FROM path p JOIN splits USING (doc_id) JOIN labelled y ON y.doc_id = p.doc_id AND y.name = p.name LEFT JOIN chosen c ON c.doc_id = p.doc_id AND c.name = p.name GROUP BY ALL""", "path", "splits", "labelled", "eligible")
def full_pipeline(spark, d) -> DataFrame:
    """Base labels and text statistics, quotas from them, quota-capped imputation, final statistics: one lazy plan."""
    leaves = X.pathology(X.leaves(spark, d))
    split = X.splits(spark, d)
    units = leaves.where("text <> ''").select(F.col("doc_id").alias("report_id"), "name")
    quota = S.quotas(S.text_counts(units, X.concepts(spark), split.withColumnRenamed("doc_id", "report_id")))
    chosen = L.within_quota(L.eligible_labels(leaves).select("doc_id", "name"), quota).withColumn("chosen", F.lit(True))
    y, valid = L.label_and_mask(F.col("label"))
    rows = leaves.select("doc_id", "name", y.alias("y"), valid.alias("was")).join(chosen, ["doc_id", "name"], "left")
    made = F.coalesce("chosen", F.lit(False)) & ~F.col("was")
    rows = rows.select("doc_id", "name", F.col("y").cast("double").alias("label"), (F.col("was") | made).alias("valid"), made.alias("imputed"))
    return S.label_counts(rows, split).select("split", "name", "n_valid", "n_imputed", "n_total")
