"""Order statistics without a sort of a whole group: counts per prefix, only borders ranked; running sums on two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.session import small, stored

#: Hex digits by which a pass refines, and rows of a border that one task may rank.
DIGITS = 4
BORDER_ROWS = 1 << 20
#: Bins of a pass over numbers.
BINS = 4096


def smallest(rows: DataFrame, key: str, code: str, quotas: DataFrame, *, tie: str, flag: str = "chosen", digits: int = DIGITS, length: int = 40, most: int = BORDER_ROWS) -> DataFrame:
    """rows with `flag`: whether they are among the first quota (quotas: key, quota) of their key by (code, tie).

    code is a hex string of `length` digits, near uniform (a hash).  A pass counts rows
    for each key and prefix; the prefix in which a key's quota ends is its border: rows
    before it are in, rows after it are out, and only those in it are ranked, once no
    border has more than `most` rows.  Passes that refine borders read these only.  No
    task sees all rows of a key, unless they all have one code.
    """
    rows = stored(rows, "ranked")
    quotas = stored(quotas.select(F.col(key).alias("_key"), F.col("quota").cast("long").alias("_left")).where("_left > 0"), "quotas")
    border, at = None, 0
    while True:
        at += digits
        prefix = F.substring(code, 1, at)
        if border is None:
            bins = rows.join(small(quotas), F.col(key) == F.col("_key"), "left_semi").groupBy(F.col(key).alias("_key"), prefix.alias("_at")).agg(F.count("*").alias("_n"))
            bins = bins.join(small(quotas), "_key")
        else:
            bins = rows.join(small(border.drop("_n")), (F.col(key) == F.col("_key")) & F.startswith(code, "_at")).groupBy("_key", "_left", prefix.alias("_to")).agg(F.count("*").alias("_n")).withColumnRenamed("_to", "_at")
        upto = F.sum("_n").over(W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))  # at most 16**digits rows
        found = bins.withColumn("_upto", upto).where("_upto > _left and _upto - _n <= _left")
        border = stored(found.select("_key", "_at", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n"), "border")
        worst = border.agg(F.max(F.when(F.col("_left") > 0, F.col("_n")))).first()[0] or 0
        if worst <= most or at >= length:
            break
    edge = border.select(F.col("_key").alias("_edge"), "_at", "_left")
    given = quotas.select(F.col("_key").alias("_given"))
    marked = rows.join(small(given), F.col(key) == F.col("_given"), "left").join(small(edge), F.col(key) == F.col("_edge"), "left").withColumn("_here", F.substring(code, 1, at))
    inside = F.col("_given").isNotNull() & (F.col("_at").isNull() | (F.col("_here") < F.col("_at")))
    open_ = F.coalesce((F.col("_here") == F.col("_at")) & (F.col("_left") > 0), F.lit(False))
    sure = marked.where(~open_).withColumn(flag, inside)
    turn = F.row_number().over(W.partitionBy(key).orderBy(code, tie))
    ranked = marked.where(open_).withColumn("_turn", turn).withColumn(flag, F.col("_turn") <= F.col("_left")).drop("_turn")
    return sure.unionByName(ranked).drop("_given", "_edge", "_at", "_left", "_here")


def quantiles(rows: DataFrame, key: list[str], value: str, shares: tuple[float, ...], *, bins: int = BINS, most: int = BORDER_ROWS) -> DataFrame:
    """(key.., share, quantile): exact quantiles, interpolated between order statistics; null, NaN and infinite values are left out.

    A pass counts values in equal bins between a key's least and largest; the bins that
    hold the wanted order statistics are then refined between their own least and
    largest values, until each has one value only, or `most` rows, which are ranked.
    Counts of a pass are merged before their shuffle, and no state holds a key's values.
    """
    v = F.col(value).cast("double")
    finite = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    keys = [f"_k{i}" for i in range(len(key))]
    data = stored(finite.withColumn("_id", F.hash(*keys) if keys else F.lit(0)), "values")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] + [F.col(f"{a}._id") == F.col(f"{b}._id")]
    ends = data.groupBy("_id", *keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(i).alias("i")) for i, s in enumerate(shares))))
    p = F.col("_w.share") * (F.col("_n") - 1)
    rank = F.explode(F.array_distinct(F.array(F.floor(p), F.ceil(p))))
    # an open bin: `_rank`, counted from its least value on, of _n values between _lo and _hi
    open_ = stored(ends.withColumn("_w", wanted).withColumn("_rank", rank).groupBy("_id", *keys, "_rank", "_n", "_lo", "_hi").agg(F.lit(1).alias("_one")).drop("_one").withColumn("_of", F.col("_rank")), "bins")
    done = open_.limit(0)
    while True:
        ready = (F.col("_lo") == F.col("_hi")) | (F.col("_n") <= most)
        done = done.unionByName(open_.where(ready))
        rest = open_.where(~ready)
        if rest.isEmpty():
            break
        spans = rest.select("_id", *keys, "_lo", "_hi").distinct()
        way = lambda to, by: (F.col(to) / by - F.col("b._lo") / by) / (F.col("b._hi") / by - F.col("b._lo") / by)
        part = F.when(F.col("b._hi") - F.col("b._lo") < float("inf"), way("a._v", 1.0)).otherwise(way("a._v", 2.0))  # halves, where the whole way is no double
        at = F.least(F.floor(part * bins), F.lit(bins - 1))
        hits = data.alias("a").join(small(spans).alias("b"), [*same("a", "b"), F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))])
        counts = hits.groupBy(*(F.col(f"b.{c}").alias(c) for c in ("_id", *keys, "_lo", "_hi")), at.alias("_bin")).agg(F.count("*").alias("_m"), F.min("a._v").alias("_from"), F.max("a._v").alias("_to"))
        before = F.sum("_m").over(W.partitionBy("_id", *keys, "_lo", "_hi").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")  # `bins` rows
        counts = counts.withColumn("_before", before)
        found = counts.alias("a").join(rest.alias("b"), [*same("a", "b"), F.col("a._lo") == F.col("b._lo"), F.col("a._hi") == F.col("b._hi"), F.col("b._rank") >= F.col("a._before"), F.col("b._rank") < F.col("a._before") + F.col("a._m")])
        open_ = stored(found.select("a._id", *(F.col(f"a.{k}").alias(k) for k in keys), (F.col("b._rank") - F.col("a._before")).alias("_rank"), F.col("a._m").alias("_n"), F.col("a._from").alias("_lo"), F.col("a._to").alias("_hi"), "b._of"), "bins")
    done = stored(done, "bins")
    flat = done.where("_lo = _hi").select("_id", *keys, "_of", F.col("_lo").alias("_x"))
    spans = done.where("_lo < _hi").select("_id", *keys, "_lo", "_hi", "_rank", "_of")
    near = data.alias("a").join(small(spans.select("_id", *keys, "_lo", "_hi").distinct()).alias("b"), [*same("a", "b"), F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))]).select("b.*", "a._v")
    turned = near.withColumn("_turn", F.row_number().over(W.partitionBy("_id", *keys, "_lo", "_hi").orderBy("_v")) - 1)  # at most `most` rows
    picked = turned.alias("a").join(spans.alias("b"), [*same("a", "b"), F.col("a._lo") == F.col("b._lo"), F.col("a._hi") == F.col("b._hi"), F.col("a._turn") == F.col("b._rank")])
    stats = stored(flat.unionByName(picked.select("b._id", *(F.col(f"b.{k}").alias(k) for k in keys), "b._of", F.col("a._v").alias("_x"))), "order")
    goal = ends.withColumn("_w", wanted).select("_id", *keys, "_w.share", p.alias("_p"), F.floor(p).alias("_a"), F.ceil(p).alias("_b"))
    low, high = (stats.select(F.col("_id").alias(f"_i{s}"), *(F.col(k).alias(f"{k}{s}") for k in keys), F.col("_of").alias(f"_o{s}"), F.col("_x").alias(f"_x{s}")) for s in "ab")
    for s, side in (("a", low), ("b", high)):
        goal = goal.join(side, [F.col("_id") == F.col(f"_i{s}"), *(F.col(k).eqNullSafe(F.col(f"{k}{s}")) for k in keys), F.col(f"_{s}") == F.col(f"_o{s}")])
    q = F.col("_xa") + (F.col("_xb") - F.col("_xa")) * (F.col("_p") - F.col("_a"))
    return goal.select(*(F.col(k).alias(c) for k, c in zip(keys, key, strict=True)), "share", F.when(F.col("_xa") == F.col("_xb"), F.col("_xa")).otherwise(q).alias("quantile"))


def running(rows: DataFrame, key: list[str], order: str, sums: list[str]) -> DataFrame:
    """rows (distinct in key and order) with `<c>_upto` and `<c>_all` of each c of sums: the sum of all rows of the key from the largest `order` on, and of the key.

    Two levels: rows lie in range partitions by key and falling order, so a key with
    all rows is dealt over all of them; each partition sums its own rows; and the sums of
    the partitions before it are added, which are a row for each key and partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(rows.repartitionByRange(parts, *key, F.desc(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = laid.groupBy(*key, "_part").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)))
    before, whole = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    for i, c in enumerate(sums):
        totals = totals.withColumn(f"_b{i}", F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0))).withColumn(f"{c}_all", F.sum(f"_t{i}").over(whole))
    totals = totals.drop(*(f"_t{i}" for i in range(len(sums))))
    own = W.partitionBy(*key, "_part").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    for c in sums:
        laid = laid.withColumn(f"{c}_upto", F.sum(c).over(own))
    names = [*key, "_part"]
    left, right = laid.alias("a"), totals.alias("b")
    out = left.join(right, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in names])
    columns = [c for c in laid.columns if c not in ("_part", *(f"{c}_upto" for c in sums))]
    return out.select(*(F.col(f"a.`{c}`").alias(c) for c in columns), *((F.col(f"a.`{c}_upto`") + F.col(f"b._b{i}")).alias(f"{c}_upto") for i, c in enumerate(sums)), *(F.col(f"b.`{c}_all`").alias(f"{c}_all") for c in sums))
