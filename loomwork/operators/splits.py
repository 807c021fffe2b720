"""Group-safe splits, exact samples, coverage weights, weighted draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.session import shared_dir


def _turn(key: str, seed: int):
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def group_split(rows: DataFrame, group: str, *, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """(group, split): groups by hash order; the first round(n * test) are test, the next round(n * val) val, the rest train.

    Null groups are left out.  Ranks are made by a range sort and counts per
    partition, so no task sees all groups.
    """
    if not 0 <= val or not 0 <= test or val + test >= 1:
        raise ValueError("0 <= val, test and val + test < 1")
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct()
    n = groups.count()
    n_test, n_val = (round(n * x) for x in (test, val))
    ranked = ranked_by(groups, [_turn(group, seed), F.col(group)])
    split = F.when(F.col("rank") < n_test, "test").when(F.col("rank") < n_test + n_val, "val").otherwise("train")
    return ranked.select(group, split.alias("split"))


def ranked_by(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their global rank from 0, by a range partitioned sort.

    The rows are bucketed by the first 2 hex digits of the first order column
    (a hash), each bucket ranked apart, and shifted by the 256 bucket counts.
    """
    keyed = rows.withColumn("_bucket", F.substring(order[0], 1, 2))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_before")
    local = keyed.withColumn("_at", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1)
    return local.join(F.broadcast(shift), "_bucket").withColumn(name, F.col("_at") + F.col("_before")).drop("_bucket", "_at", "_before")


def positions(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their global rank from 0 in any order: range partitions, ranked apart, shifted by the counts before.

    The sorted rows are laid down once as partitions (a checkpoint), so both uses see the
    same; only one count for each partition goes through one task.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).checkpoint()
    counts = laid.groupBy("_part").agg(F.count("*").alias("_size"))
    shift = counts.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return laid.join(F.broadcast(shift), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def apply_split(rows: DataFrame, splits: DataFrame, group: str, split: str) -> DataFrame:
    """Rows whose group is in the split; groups without one go."""
    return rows.join(splits.where(F.col("split") == split).select(group), group, "left_semi")


def exact_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest hashes."""
    return rows.orderBy(_turn(key, seed), key).limit(n)


def share_sample(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Rows whose hash, as a number in [0, 1), is under share: no shuffle, reruns agree."""
    return rows.where(N.hash32(F.lit(str(seed)), F.col(key).cast("string")) / F.lit(float(1 << 32)) < share)


def coverage_weights(reports: DataFrame, units: DataFrame, coverage: DataFrame | None = None, *, target: float = 0.2, rare: float = 0.1, report: str = "report_id") -> DataFrame:
    """(report, weight): 1 + sum over a report's concepts with coverage under `rare` of max(0, target / coverage - 1)."""
    have = units.select(report, "name").distinct().join(reports.select(report).distinct(), report, "left_semi")
    if coverage is None:
        n = F.lit(max(1, reports.select(report).distinct().count()))
        coverage = have.groupBy("name").agg((F.count("*") / n).alias("coverage"))
    more = F.when(F.col("coverage") < rare, F.greatest(F.lit(0.0), F.lit(target) / F.greatest("coverage", F.lit(1e-8)) - 1)).otherwise(F.lit(0.0))
    extra = have.join(F.broadcast(coverage.select("name", more.alias("more"))), "name").groupBy(report).agg(F.sum("more").alias("more"))
    return reports.select(report).join(extra, report, "left").select(report, (1 + F.coalesce("more", F.lit(0.0))).alias("weight"))


def weighted_draw(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): n draws with replacement, each row with probability weight / total.

    Row and draw positions on [0, total) meet in 4096 equal lots, so the range
    join is an equi-join on the lot plus a check of the interval.
    """
    lots = 4096
    total = rows.agg(F.sum(weight)).first()[0] or 0.0
    if total <= 0:
        return rows.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    bucket = F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 2)
    keyed = rows.select(key, F.col(weight).cast("double").alias("_w"), bucket.alias("_b"))
    sums = keyed.groupBy("_b").agg(F.sum("_w").alias("_s")).withColumn("_from", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).select("_b", "_from")
    per = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    spans = keyed.withColumn("_hi", F.sum("_w").over(per)).join(F.broadcast(sums), "_b").withColumn("_hi", F.col("_hi") + F.col("_from")).withColumn("_lo", F.col("_hi") - F.col("_w"))
    lot = lambda c: F.least(F.floor(F.col(c) / F.lit(total) * lots), F.lit(lots - 1)).cast("int")
    spans = spans.withColumn("_lot", F.explode(F.sequence(lot("_lo"), lot("_hi"))))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", N.hash52(F.lit(str(seed)), F.col("draw").cast("string")) / F.lit(float(1 << 52)) * F.lit(total)).withColumn("_lot", lot("_u"))
    return draws.join(spans, "_lot").where("_u >= _lo and _u < _hi").select("draw", key)


#: Rounds of the permutation, and steps by which a number that left the range is brought back.
ROUNDS, STEPS = 6, 64


def permuted(x, n: int, key: str) -> Column:
    """x of 0 .. n - 1 in another order of all n numbers: a keyed bijection, from x alone.

    A Feistel network on pairs (l, r) of Z_a x Z_b, a and b near the root of n: in turn a
    hash of one is added to the other.  a * b exceeds n by less than 2 a; a number beyond
    n is sent through again.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def once(y):
        start = F.struct(F.floor(y / F.lit(b)).cast("long").alias("l"), (y % b).alias("r"))
        hashed = lambda i, v: N.hash32(F.lit(key), i.cast("string"), v.cast("string"))
        turn = lambda s, i: F.when(i % 2 == 0, F.struct(((s["l"] + hashed(i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + hashed(i, s["l"])) % b).alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once(F.col(x) if isinstance(x, str) else x), lambda y, _: F.when(y < n, y).otherwise(once(y)))


def epoch(rows: DataFrame, order: list, batch: int, *, number: int = 0, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """rows with place, batch and slot: each epoch another order of all rows, in batches of exactly `batch` rows.

    Rows are numbered once by `order`; an epoch's order is a function of the number, so it
    needs no sort, and any task can tell which rows a batch has.  The last batch
    is shorter, or left out with drop_last.  Ties of `order` make the numbering arbitrary: give a
    whole key.
    """
    if batch < 1:
        raise ValueError("batch must be positive")
    numbered = positions(rows, order, "_row")
    n = numbered.count()
    out = numbered.withColumn("place", permuted("_row", n, f"{seed}|{number}")).withColumn("batch", F.floor(F.col("place") / batch)).withColumn("slot", F.col("place") % batch).drop("_row")
    return out.where(F.col("place") < n - n % batch) if drop_last else out
