"""Counts per split and concept, quotas, class counts, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import ranks

from loomwork.functions import numeric as N


def nan_mean(c) -> Column:
    """The mean without nulls and NaN."""
    return F.avg(F.nanvl(c, F.lit(None).cast("double")))


def nan_max(c) -> Column:
    return F.max(F.nanvl(c, F.lit(None).cast("double")))


def first_per_key(rows: DataFrame, key: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key: one aggregation by struct, no window over whole keys."""
    at = F.struct(*order)
    rest = [c for c in rows.columns if c not in key]
    best = (F.max_by if last else F.min_by)(F.struct(*rest), at)
    return rows.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def text_counts(units: DataFrame, concepts: DataFrame, splits: DataFrame, *, report: str = "report_id", imputed: bool = False) -> DataFrame:
    """(split, name, n_with, n_without, n_total): distinct reports with a text, for every split and concept.

    Totals count all reports with a split, with or without text.  Imputed units
    count only if asked for.
    """
    rows = units if imputed or "is_imputed" not in units.columns else units.where(~F.coalesce("is_imputed", F.lit(False)))
    known = units.select(report).distinct().join(splits, report)
    total = known.groupBy("split").agg(F.count("*").alias("n_total"))
    have = rows.join(F.broadcast(concepts.select("name")), "name", "left_semi").join(splits, report).groupBy("split", "name").agg(F.countDistinct(report).alias("n_with"))
    full = total.crossJoin(F.broadcast(concepts.select("name")))
    out = full.join(have, ["split", "name"], "left").withColumn("n_with", F.coalesce("n_with", F.lit(0)))
    return out.select("split", "name", "n_with", F.greatest(F.col("n_total") - F.col("n_with"), F.lit(0)).alias("n_without"), "n_total")


def label_counts(rows: DataFrame, splits: DataFrame, *, report: str = "doc_id") -> DataFrame:
    """Per split and concept of rows (report, name, label, valid, imputed): counts, and percentages (0 for none)."""
    close = lambda v: F.abs(F.col("label") - v) <= 1e-8 + 1e-5 * abs(v)
    out = rows.join(splits, report).groupBy("split", "name").agg(
        F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & close(1)).alias("n_pos"), F.count_if(F.col("valid") & close(0)).alias("n_neg"),
        F.count_if(~F.col("valid")).alias("n_masked"), F.count_if("imputed").alias("n_imputed"), F.count("*").alias("n_total"),
    )
    share = lambda a, b: N.divided(100.0 * F.col(a), b, 0.0)
    return out.withColumn("pos_rate_pct", share("n_pos", "n_valid")).withColumn("masked_rate_pct", share("n_masked", "n_total"))


def quotas(stats: DataFrame, count: str = "n_with") -> DataFrame:
    """(name, quota): counts over all splits, rounded to the even neighbour, at least 0; words count as 0."""
    return stats.groupBy("name").agg(F.greatest(N.rounded(F.sum(F.coalesce(F.col(count).cast("string").try_cast("double"), F.lit(0.0)))), F.lit(0)).alias("quota"))


def remaining(quota: DataFrame, written: DataFrame) -> DataFrame:
    """Quotas less what rows (name) were written already, at least 0."""
    done = written.groupBy("name").agg(F.count("*").alias("done"))
    return quota.join(done, "name", "left").select("name", F.greatest(F.col("quota") - F.coalesce("done", F.lit(0)), F.lit(0)).alias("quota"))


def token_counts(rows: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """How often each concept is named in a | separated column."""
    each = rows.select(F.explode(F.split(F.coalesce(column, F.lit("")), r"\|")).alias("name")).select(F.trim("name").alias("name"))
    return each.join(F.broadcast(concepts.select("name")), "name").groupBy("name").agg(F.count("*").alias("n"))


def class_counts(rows: DataFrame) -> DataFrame:
    """(name, n_pos, n_neg) of valid rows."""
    return rows.where("valid").groupBy("name").agg(F.count_if(F.col("label") > 0.5).alias("n_pos"), F.count_if(F.col("label") <= 0.5).alias("n_neg"))


def covered(units: DataFrame, report: str = "report_id") -> DataFrame:
    """The set of concepts each report has text for."""
    return units.groupBy(report).agg(F.array_sort(F.collect_set("name")).alias("concepts"))


def histogram(rows: DataFrame, value: str, bins: int, lo: float, hi: float, key: list[str] | None = None) -> DataFrame:
    """(key.., bin, n, cdf): equal bins on [lo, hi], the last one closed; values outside are left out; empty bins are not rows."""
    from pyspark.sql import Window as W

    key = key or []
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).between(lo, hi)).groupBy(*key, at.alias("bin")).agg(F.count("*").alias("n"))
    per = W.partitionBy(*key).orderBy("bin")
    whole = W.partitionBy(*key)
    return counts.withColumn("cdf", F.sum("n").over(per.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(whole))


def spread(rows: DataFrame, key: list[str], value: str, quantiles=(0.01, 0.99)) -> DataFrame:
    """Least, largest, mean, unbiased deviation and interpolated quantiles (of finite values; null without any)."""
    out = rows.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    exact = ranks.quantiles(rows, key, value, tuple(quantiles)).select(*(F.col(c).alias(f"_{c}") for c in key), "share", "quantile")
    exact = exact.groupBy(*(f"_{c}" for c in key)).agg(*(F.max(F.when(F.col("share") == float(q), F.col("quantile"))).alias(f"q{round(100 * q)}") for q in quantiles))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return (out.join(exact, on, "left") if key else out.join(exact)).drop(*(f"_{c}" for c in key))


def statuses(rows: DataFrame, status: str = "status", known=("success", "dry_run", "failed")) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in known), F.count("*").alias("n_total"))


def split_order(c) -> Column:
    """train, val, test, then others by name."""
    return F.struct(F.coalesce(F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), c) + F.when(F.array_contains(F.array(F.lit("train"), F.lit("val"), F.lit("test")), c), 0).otherwise(9), F.lit(9)).alias("rank"), c.alias("name"))
