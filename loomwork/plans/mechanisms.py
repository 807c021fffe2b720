"""Queries of paired shards, windows of long texts, epochs, buffered streams and deep documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import documents as D
from loomwork.operators import labels as L
from loomwork.operators import retrieval as R
from loomwork.operators import runs as O
from loomwork.operators import splits as P
from loomwork.operators import stats as S
from loomwork.plans import fixtures as X
from loomwork.plans.catalog import _r, query
from loomwork.session import place
from loomwork.sources import paired, readers, sinks
from loomwork.streaming import buffers
from loomwork.streaming import resume as U

# ------------------------------------------------------------ paired shards


def _pairs(spark, d, name: str, dtype: str = "float32") -> str:
    """Vectors and their metadata in shards of 70, in two writings."""
    at = place(spark, name)
    rows = X.read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    stamped = sinks.stamped(rows, ["vec_id"], 70)
    paired.write(stamped.where("shard % 2 = 0"), at, dtype=dtype)
    paired.write(stamped.where("shard % 2 = 1"), at, dtype=dtype)
    return at


_NUMBERED = "WITH n AS (SELECT vec_id, label::BIGINT AS label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings)"


@query(_NUMBERED + " SELECT (r // 70)::BIGINT AS shard, (r % 70)::BIGINT AS row, vec_id, label, 'v' || vec_id AS name, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(embedding[64]::DOUBLE, 6) AS last FROM n")
def paired_shards(spark, d) -> DataFrame:
    """Array files and tables of metadata, written as pairs and read as rows."""
    out = paired.read(spark, _pairs(spark, d, "pairs"), rows=32)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return out.select(F.col("shard").cast("long").alias("shard"), "row", "vec_id", "label", "name", _r(total, "total", 5), _r(F.col("vector")[63].cast("double"), "last"))


@query(_NUMBERED + " SELECT label, count(*) AS n, min(vec_id) AS first FROM n WHERE r // 70 IN (1, 4) OR r // 70 > 5 GROUP BY label")
def paired_some_shards(spark, d) -> DataFrame:
    """Only the shards that a filter names are opened."""
    at = _pairs(spark, d, "pairs")
    some = paired.read(spark, at).where(F.col("shard").isin(1, 4)).unionByName(paired.read(spark, at).where("shard > 5"))
    return some.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query("SELECT vec_id, true AS near FROM embeddings")
def paired_halves(spark, d) -> DataFrame:
    """Pairs of 16-bit floats."""
    out = paired.read(spark, _pairs(spark, d, "halves", "float16")).select("vec_id", F.col("vector").alias("w"))
    rows = X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    near = F.forall(F.zip_with("v", "w", lambda a, b: F.abs(a - b) <= F.abs(a) * 0.001 + 1e-6), lambda x: x)
    return rows.join(out, "vec_id").select("vec_id", near.alias("near"))


# ------------------------------------------------------------ directories and indexes


@query("SELECT 'case' || c_custkey AS name FROM customer WHERE c_custkey % 6 = 0 ORDER BY 1 LIMIT 12")
def case_directories(spark, d) -> DataFrame:
    """The first dozen directories that hold both files; others hold one of them."""
    at = place(spark, "cases")
    rows = X.read(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("image.json"), F.lit("report.json"))).alias("file"), F.col("c_name").alias("doc"))
    rows = rows.where(F.when(F.col("file") == "image.json", F.col("c_custkey") % 2 == 0).otherwise(F.col("c_custkey") % 3 == 0))
    sinks.named_files(rows.select(F.concat(F.lit("case"), F.col("c_custkey").cast("string"), F.lit("/"), F.col("file")).alias("file"), "doc"), at)
    return readers.cases(spark, at, "image.json", "report.json", 12).select(F.regexp_extract("case", r"([^/]+)$", 1).alias("name"))


@query("SELECT 'csv' AS kind, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier UNION ALL SELECT 'parquet', CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def index_tables(spark, d) -> DataFrame:
    """An index as one CSV result and as Parquet, told apart by its ending."""
    at = place(spark, "index")
    rows = X.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
    sinks.result_csv(rows, f"{at}.csv")
    rows.write.parquet(f"{at}.parquet")
    read = lambda end: readers.table(spark, f"{at}.{end}").select(F.lit(end).alias("kind"), "key", "name")
    return read("csv").unionByName(read("parquet"))


# ------------------------------------------------------------ windows of long texts


def _stand_in(rows: DataFrame) -> DataFrame:
    """An encoder of three components that SQL knows too: parts of the sha1 of the text."""
    part = lambda i: F.conv(F.substring(F.sha1(F.col("window_text").cast("binary")), 1 + 6 * i, 6), 16, 10).cast("double") / F.lit(float(1 << 23)) - 1
    return rows.withColumn("vector", F.array(*(part(i) for i in range(3))))


_WINDOWS = r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
  c AS (SELECT doc_id, t, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 64 THEN 1 ELSE 1 + ceil((len(t) - 64) / 48.0::DOUBLE)::INT END AS k FROM t),
  w AS (SELECT doc_id, k, i, t[i * 48 + 1:i * 48 + 64] AS w FROM (SELECT doc_id, t, k, unnest(range(0, k)) AS i FROM c)),
  e AS (SELECT doc_id, k, i, len(w) AS m, sha1(array_to_string(w, ' ')) AS h FROM w),
  v AS (SELECT *, CAST('0x' || substr(h, 1, 6) AS BIGINT) / 8388608.0::DOUBLE - 1 AS a, CAST('0x' || substr(h, 7, 6) AS BIGINT) / 8388608.0::DOUBLE - 1 AS b, CAST('0x' || substr(h, 13, 6) AS BIGINT) / 8388608.0::DOUBLE - 1 AS c FROM e),
  u AS (SELECT *, sqrt(a * a + b * b + c * c) + 1e-8 AS l FROM v)"""


def _mean_sql(weight: str) -> str:
    s = {x: f"sum({weight} * {x} / l) / sum({weight})" for x in "abc"}
    return _WINDOWS + f""", s AS (SELECT doc_id, any_value(k) AS k, sum(m) AS m, {s['a']} AS a, {s['b']} AS b, {s['c']} AS c FROM u GROUP BY doc_id)
  SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_windows, coalesce(m, 0)::BIGINT AS n_tokens, round(coalesce(a / greatest(sqrt(a * a + b * b + c * c), 1e-12), 0), 6) + 0.0 AS a, round(coalesce(b / greatest(sqrt(a * a + b * b + c * c), 1e-12), 0), 6) + 0.0 AS b, round(coalesce(c / greatest(sqrt(a * a + b * b + c * c), 1e-12), 0), 6) + 0.0 AS c
  FROM documents d LEFT JOIN s USING (doc_id)"""


def _means(spark, d, weighted: bool) -> DataFrame:
    out = R.window_means(X.read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], _stand_in, 3, weighted=weighted, size=64, overlap=16)
    return out.select("doc_id", F.col("n_windows").cast("long").alias("n_windows"), "n_tokens", *((F.round(F.col("vector")[i], 6) + 0.0).alias(c) for i, c in enumerate("abc")))


@query(_mean_sql("1.0::DOUBLE"))
def window_means(spark, d) -> DataFrame:
    """Whole documents in windows of 64 tokens that share 16, encoded apart; all windows count alike."""
    return _means(spark, d, False)


@query(_mean_sql("m"))
def window_means_by_tokens(spark, d) -> DataFrame:
    return _means(spark, d, True)


@query(_WINDOWS + " SELECT doc_id, i::BIGINT AS w, m::BIGINT AS n_tokens, h AS digest FROM e")
def text_windows(spark, d) -> DataFrame:
    out = R.windows(X.read(spark, d, "documents").select("doc_id", "text"), size=64, overlap=16)
    return out.select("doc_id", F.col("window").cast("long").alias("w"), F.col("n_tokens").cast("long").alias("n_tokens"), F.sha1(F.col("window_text").cast("binary")).alias("digest"))


# ------------------------------------------------------------ epochs


def _epoch_sql(key: str, rest: str) -> str:
    """The network of `splits.permuted`, sent round again while it leaves the range."""
    cells = "SELECT doc_id, step, x // b AS l, x % b AS r, a, b, n FROM walk WHERE step = 0 OR x >= n"
    for i in range(P.ROUNDS):
        one, other, mod = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        cells = f"SELECT * REPLACE (({one} + CAST('0x' || substr(sha1('{key}|{i}|' || {other}), 1, 8) AS BIGINT)) % {mod} AS {one}) FROM ({cells})"
    return f"""WITH RECURSIVE n AS (SELECT count(*) AS n, (SELECT min(i) FROM range(1, 100000) t(i) WHERE i * i >= greatest((SELECT count(*) FROM documents), 1)) AS a FROM documents),
  walk(doc_id, step, x, a, b, n) AS (SELECT doc_id, 0::BIGINT, row_number() OVER (ORDER BY doc_id) - 1, a, CAST(ceil(n / a::DOUBLE) AS BIGINT), n FROM documents, n UNION ALL SELECT doc_id, step + 1, (l * b + r)::BIGINT, a, b, n FROM ({cells})),
  placed AS (SELECT doc_id, x AS place, n FROM walk WHERE step > 0 AND x < n) {rest}"""


@query(_epoch_sql("42|3", "SELECT doc_id, place::BIGINT AS place, (place // 32)::BIGINT AS batch, (place % 32)::BIGINT AS slot FROM placed"))
def shuffled_epoch(spark, d) -> DataFrame:
    """The third epoch's order of all documents, in batches of 32."""
    return P.epoch(X.read(spark, d, "documents").select("doc_id"), ["doc_id"], 32, number=3).select("doc_id", "place", "batch", "slot")


@query(_epoch_sql("7|0", "SELECT (place // 30)::BIGINT AS batch, count(*) AS n, min(doc_id) AS first, sum(doc_id)::BIGINT AS total FROM placed WHERE place < n - n % 30 GROUP BY ALL"))
def epoch_drop_last(spark, d) -> DataFrame:
    """Whole batches only."""
    out = P.epoch(X.read(spark, d, "documents").select("doc_id"), ["doc_id"], 30, seed=7, drop_last=True)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("total"))


# ------------------------------------------------------------ buffered streams


@query("SELECT doc_id % 3 AS bucket, count(*) // 16 AS n_flushes, count(*) // 16 * 16 AS n_flushed, count(*) % 16 AS n_left, 0::BIGINT AS n_twice FROM documents GROUP BY ALL")
def buffered_stream(spark, d) -> DataFrame:
    """Documents as a stream that stops and goes on: buffers of 16 are flushed whole, each unit once; the rest waits in the state."""
    at = place(spark, "buffer")
    docs = X.read(spark, d, "documents").select((F.col("doc_id") % 3).alias("bucket"), F.col("doc_id").cast("string").alias("unit"))
    for part in (0, 1):
        docs.where(F.pmod(F.xxhash64("unit"), F.lit(2)) == part).write.mode("append").parquet(f"{at}/in")
        flushed = buffers.buffered(U.files(spark, f"{at}/in", "bucket long, unit string"), "bucket", "unit", 16)
        U.run_available(flushed, U.each_batch(f"{at}/out"), f"{at}/check")
    out = spark.read.schema("bucket long, flush long, whole boolean, units array<string>").parquet(f"{at}/out")
    units = out.select("bucket", F.explode("units").alias("unit")).groupBy("bucket", "unit").agg(F.count("*").alias("times"))
    sent = units.groupBy("bucket").agg(F.count("*").alias("n_flushed"), F.count_if(F.col("times") > 1).alias("n_twice"))
    whole = out.groupBy("bucket").agg(F.count_if(F.col("whole") & (F.size("units") == 16)).alias("n_flushes"))
    all_ = docs.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = all_.join(sent, "bucket", "left").join(whole, "bucket", "left").na.fill(0)
    return rows.select("bucket", "n_flushes", "n_flushed", (F.col("n") - F.col("n_flushed")).alias("n_left"), "n_twice")


# ------------------------------------------------------------ a run of steps


def _steps(spark, d, threshold: float) -> list[O.Step]:
    """Reports as structured documents, their leaves, labels, quotas, imputation, vectors of the texts, and the final counts."""
    split = X.splits(spark, d)

    def structured(_):
        cells = X.pathology(X.leaves(spark, d)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("text", "label").alias("leaf")))).alias("m"))
        return cells.select("doc_id", F.to_json("m").alias("doc"))

    def leaves(t):
        rows = D.nodes(t["structured"]).where(F.startswith("value", F.lit("{")))
        return rows.select("doc_id", F.col("path").alias("name"), F.get_json_object("value", "$.text").alias("text"), F.get_json_object("value", "$.label").alias("label"))

    def labels(t):
        y, valid = L.label_and_mask(F.col("label"))
        return t["leaves"].select("doc_id", "name", y.cast("double").alias("label"), valid.alias("valid"))

    def quotas(t):
        units = t["leaves"].where("text <> ''").select(F.col("doc_id").alias("report_id"), "name")
        return S.quotas(S.text_counts(units, X.concepts(spark), split.withColumnRenamed("doc_id", "report_id")))

    def imputed(t):
        rows = L.eligible_labels(t["leaves"].withColumn("sev", F.col("label").cast("long")), threshold=threshold).select("doc_id", "name")
        return L.within_quota(rows, t["quotas"])

    def vectors(t):
        texts = t["leaves"].where("text <> ''").select("doc_id", "name", "text")
        return R.window_means(texts, ["doc_id", "name"], _stand_in, 3, size=4, overlap=1)

    def counts(t):
        rows = t["labels"].join(t["imputed"].withColumn("chosen", F.lit(True)), ["doc_id", "name"], "left")
        made = F.coalesce("chosen", F.lit(False)) & ~F.col("valid")
        rows = rows.select("doc_id", "name", "label", (F.col("valid") | made).alias("valid"), made.alias("imputed"))
        with_vectors = t["vectors"].join(split, "doc_id").groupBy("split", "name").agg(F.count("*").alias("n_vectors"))
        return S.label_counts(rows, split).select("split", "name", "n_valid", "n_imputed", "n_total").join(with_vectors, ["split", "name"], "left").na.fill(0, ["n_vectors"])

    return [
        O.Step("structured", structured), O.Step("leaves", leaves, ("structured",)), O.Step("labels", labels, ("leaves",)), O.Step("quotas", quotas, ("leaves",)),
        O.Step("imputed", imputed, ("leaves", "quotas"), {"threshold": threshold}), O.Step("vectors", vectors, ("leaves",), {"size": 4, "overlap": 1}), O.Step("counts", counts, ("labels", "imputed", "vectors")),
    ]


@query("""WITH base AS (SELECT split, name, count(*) AS n FROM path JOIN splits USING (doc_id) WHERE text <> '' GROUP BY ALL), quota AS (SELECT name, sum(n) AS quota FROM base GROUP BY name),
  chosen AS (SELECT doc_id, name FROM (SELECT e.doc_id, e.name, quota, row_number() OVER (PARTITION BY e.name ORDER BY sha1('42|' || CAST(e.doc_id AS VARCHAR) || '|' || e.name), e.doc_id) AS turn FROM eligible e JOIN quota USING (name)) WHERE turn <= quota)
  SELECT split, p.name, count(CASE WHEN y.valid OR c.doc_id IS NOT NULL THEN 1 END) AS n_valid, count(CASE WHEN c.doc_id IS NOT NULL AND NOT y.valid THEN 1 END) AS n_imputed, count(*) AS n_total, count(CASE WHEN p.text <> '' THEN 1 END) AS n_vectors, 2 + 7 AS n_made, 5 AS n_skipped
  FROM path p JOIN splits USING (doc_id) JOIN labelled y ON y.doc_id = p.doc_id AND y.name = p.name LEFT JOIN chosen c ON c.doc_id = p.doc_id AND c.name = p.name GROUP BY ALL""", "path", "splits", "labelled", "eligible")
def staged_run(spark, d) -> DataFrame:
    """The whole job as steps with a manifest; run again with another threshold, only what depends on it is made anew."""
    run = O.Run(spark, place(spark, "run"))
    run(_steps(spark, d, 80.0))
    tables = run(_steps(spark, d, 70.0))
    return tables["counts"].withColumn("n_made", F.lit(len(run.made))).withColumn("n_skipped", F.lit(len(run.skipped)))


# ------------------------------------------------------------ deep documents


@query("""SELECT event_id, repeat('n.', 40) || 'leaf.[1]' AS path, 'deep ' || event_type AS text FROM events
  UNION ALL SELECT event_id, repeat('n.', i::INT) || 'n', 'at ' || i FROM events, range(0, 40) t(i) WHERE event_id % 50 = 0""")
def deep_documents(spark, d) -> DataFrame:
    """Documents of 42 levels: a leaf in a list at the bottom; every fiftieth has a text at each level."""
    rows = X.read(spark, d, "events").select("event_id", "event_type")
    doc = F.to_json(F.struct(F.array(F.lit(None).cast("string"), F.concat(F.lit("deep "), "event_type")).alias("leaf")))
    for i in reversed(range(40)):
        said = F.when(F.col("event_id") % 50 == 0, F.lit(f'"text":"at {i}",')).otherwise(F.lit(""))
        doc = F.concat(F.lit('{"n":{'), said, F.substring(doc, 2, 1 << 20), F.lit("}"))
    return D.text_leaves(rows.select("event_id", doc.alias("doc")), "doc").select("event_id", "path", "text")
