"""Mixing sources to target weights, with built-in functions only.

Tokens are summed per source; a target is a source's share, by weight, of
`budget` times all tokens, held to `most` times the source's own tokens, the
excess reshared by weight among the rest.  That fixed point is min(most *
tokens, level * weight) for the one level at which the targets add up; it is
found by one pass over the sources in the order of most * tokens / weight.  A
source's repetition rate is target / tokens.  Each document is taken
floor(rate) times, and once more if a hash of seed and doc_id, as a number in
[0, 1), lies under the rate's fraction.

Documents are not shuffled while the source table (one row per source) has at
most `BROADCAST_BYTES` of names, which are counted; beyond that the join is left to
Spark, which splits skewed sources.  Sums are partial before their shuffle, so a source with a third of all
rows is no hot spot.  The level is one order over the sources: their table goes
through one task, 100 bytes a source.

Edge cases: null or blank text has size 0 and is taken for 0 words; a very long text
is taken or left whole; a source without words has target 0; null is a source of its
own, last; rows with equal (or null) doc_id share the draw; columns of any name come
through `mixed` as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm import common as C

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = "mix-1"
BROADCAST_BYTES = 8 << 20


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def rates(sources: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (source, tokens, weight), one row each -> with target and rate."""
    cap = F.lit(float(most)) * F.col("tokens")
    by_level = W.orderBy("full_at", F.col("source").asc_nulls_last())
    total = F.sum("tokens").over(W.partitionBy())
    rows = sources.withColumn("full_at", cap / F.col("weight")).withColumn("goal", F.lit(float(budget)) * total)
    rows = rows.withColumn("capped", F.coalesce(F.sum(cap).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(W.partitionBy())
    target = F.least(cap, F.coalesce(level * F.col("weight"), cap))
    return rows.withColumn("target", target).withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("tokens"))).otherwise(F.lit(0.0))).select("source", "tokens", "weight", "target", "rate")


def weighted(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weights by code point order of the source, null last, repeating."""
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), at % len(weights)))


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of a hash."""
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(docs: DataFrame, *, budget: float = BUDGET, most: float = MOST, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document."""
    sized = docs.withColumn("size", n_words("text"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("tokens"))
    table = rates(weighted(sums, weights), budget, most).select(F.col("source").alias("s"), F.col("tokens").alias("source_size"), "target", "rate")
    table = C.stored(table, "rates")
    if (table.agg(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    joined = sized.join(table, sized["source"].eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw(seed=seed) < F.col("rate") - whole).cast("long")).cast("long")).drop("rate")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return copies(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    out = copies(C.plain(docs, "doc_id", "source", "text"), **options)
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copies > 0")
    return C.named(each, docs)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS tokens FROM sized GROUP BY source
), weighted AS (
  SELECT source, tokens, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight FROM sums
), ordered AS (
  SELECT *, 2.0::DOUBLE * tokens AS cap, 2.0::DOUBLE * tokens / weight AS full_at, 1.5::DOUBLE * (SELECT sum(tokens) FROM sums)::DOUBLE AS goal FROM weighted
), levels AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered
), targets AS (
  SELECT source, tokens, least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= full_at) * weight, cap)) AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN tokens > 0 THEN least(2.0::DOUBLE, target / tokens) ELSE 0.0 END AS rate FROM targets
)
SELECT doc_id, size, tokens AS source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
