"""Deterministic views of the test tables that stand for reports, leaves, units, images and scores.

Each exists as a DataFrame and as a DuckDB common table expression of one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import numeric as N

#: The concepts, in their order.
CONCEPTS = [
    "support_devices.airway", "support_devices.gastric_tube", "support_devices.central_line", "support_devices.chest_drain", "support_devices.pacemaker", "support_devices.other",
    "thoracic_organs.heart", "thoracic_organs.mediastinum",
    "pathologies.lung.pneumonia", "pathologies.lung.atelectasis", "pathologies.lung.emphysema", "pathologies.lung.fibrosis", "pathologies.lung.mass",
    "pathologies.pleura.pneumothorax", "pathologies.pleura.pleural_effusion", "pathologies.vessels.congestion", "pathologies.vessels.pulmonary_edema", "pathologies.bones.fracture", "pathologies.bones.other",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CONCEPTS)), "idx int, name string")


def pools(spark: SparkSession) -> DataFrame:
    """(name, pool): three sentences for every concept but the last of each family."""
    rows = concepts(spark).where(~F.col("name").endswith(".other"))
    return rows.select("name", F.array(*(F.concat(F.lit(f"No sign {i} of "), "name") for i in range(3))).alias("pool"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, name, sev, label, text): label is a word for devices, a severity for others."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    rows = docs.crossJoin(F.broadcast(concepts(spark)))
    h = N.hash32(F.col("doc_id").cast("string"), F.col("name"))
    rows = rows.withColumn("h", h % 100).withColumn("h2", F.floor(h / 100) % 100).withColumn("p0", 20 + F.pmod("doc_id", F.lit(7)) * 10)
    sev = F.when(F.col("h") < F.col("p0"), 0).otherwise(1 + F.col("h") % 3)
    device = F.startswith("name", F.lit("support_devices."))
    label = F.when(device, F.when(F.col("h") % 3 == 0, "present").otherwise("not present")).otherwise(sev.cast("string"))
    text = F.when(F.col("h2") < F.col("p0"), "").otherwise(F.concat(F.lit("finding of "), "name", F.lit(" "), F.col("h2").cast("string")))
    return rows.select("doc_id", "idx", "name", sev.cast("long").alias("sev"), label.alias("label"), text.alias("text"))


def pathology(rows: DataFrame) -> DataFrame:
    return rows.where(F.startswith("name", F.lit("pathologies.")))


def splits(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, split): every third document val, each document divisible by 10 without a split."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias(key)).where("doc_id % 10 <> 0")
    return docs.withColumn("split", F.when(F.col(key) % 3 == 0, "val").otherwise("train"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, name, text, is_imputed): leaves with text; some marked imputed."""
    return leaves(spark, sf_dir).where("text <> ''").select(F.col("doc_id").alias("report_id"), "name", "text", ((F.col("doc_id") + F.col("idx")) % 11 == 0).alias("is_imputed"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, name, y, score): two targets from labels, a score from the document's length."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    score = (F.col("n_chars") % 997) / F.lit(996.0)
    each = F.explode(F.array(F.struct(F.lit("quality").alias("name"), "quality"), F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("quality"))))
    return rows.select("doc_id", score.alias("score"), each.alias("t")).select(F.col("doc_id").alias("sample_id"), "t.name", F.col("t.quality").alias("y"), "score")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 20."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("concept"), F.col("embedding").alias("v"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, with a text of its own or shared."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").alias("concept"), F.col("vec_id").alias("text_idx"), F.concat(F.lit("text "), (F.col("vec_id") % 150).cast("string")).alias("text"), F.col("embedding").alias("raw"))


_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CONCEPTS))

#: Common table expressions of the same views.
CTE = {
    "concepts": f"concepts AS (SELECT * FROM (VALUES {_NAMES}) t(idx, name))",
    "hashed": "hashed AS (SELECT doc_id, idx, name, CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR) || '|' || name), 1, 8) AS BIGINT) AS hh, 20 + (doc_id % 7) * 10 AS p0 FROM documents, concepts)",
    "leaves": """leaves AS (SELECT doc_id, idx, name, CASE WHEN hh % 100 < p0 THEN 0 ELSE 1 + (hh % 100) % 3 END AS sev,
      CASE WHEN starts_with(name, 'support_devices.') THEN (CASE WHEN (hh % 100) % 3 = 0 THEN 'present' ELSE 'not present' END)
           ELSE CAST(CASE WHEN hh % 100 < p0 THEN 0 ELSE 1 + (hh % 100) % 3 END AS VARCHAR) END AS label,
      CASE WHEN (hh // 100) % 100 < p0 THEN '' ELSE 'finding of ' || name || ' ' || CAST((hh // 100) % 100 AS VARCHAR) END AS text FROM hashed)""",
    "path": "path AS (SELECT * FROM leaves WHERE starts_with(name, 'pathologies.'))",
    "splits": "splits AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE doc_id % 10 <> 0)",
    "units": "units AS (SELECT doc_id AS report_id, name, text, (doc_id + idx) % 11 = 0 AS is_imputed FROM leaves WHERE text <> '')",
    "labelled": """labelled AS (SELECT *, CASE WHEN label IN ('present', '2', '3') THEN 1 ELSE 0 END AS y, label IN ('present', 'not present', '1', '2', '3') AS valid FROM leaves)""",
    "scores": """scores AS (SELECT doc_id AS sample_id, name, y, (n_chars % 997) / 996.0::DOUBLE AS score FROM
      (SELECT doc_id, 'quality' AS name, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l JOIN documents USING (doc_id))""",
    "pools": "pools AS (SELECT name, ['No sign 0 of ' || name, 'No sign 1 of ' || name, 'No sign 2 of ' || name] AS pool FROM concepts WHERE NOT ends_with(name, '.other'))",
    "eligible": """eligible AS (SELECT doc_id, name, ratio FROM (SELECT doc_id, name, sev, count(*) OVER w - 1 AS n_other,
      (sum(CASE WHEN sev <> 0 THEN 1 ELSE 0 END) OVER w - CASE WHEN sev <> 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / (count(*) OVER w - 1) AS ratio
      FROM path WINDOW w AS (PARTITION BY doc_id)) WHERE sev = 0 AND ratio >= 70)""",
}
NEEDS = {"hashed": ["concepts"], "leaves": ["hashed"], "path": ["leaves"], "units": ["leaves"], "labelled": ["leaves"], "pools": ["concepts"], "eligible": ["path"]}


def sql(body: str, *names: str) -> str:
    """body behind the named expressions and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    more = body.lstrip()
    if order and more.upper().startswith("WITH "):
        return "WITH " + ", ".join(CTE[n] for n in order) + ", " + more[5:]
    return ("WITH " + ", ".join(CTE[n] for n in order) + " " if order else "") + more
