"""Ranking metrics, operating points, confusion, losses: long form, one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.operators import ranks
from loomwork.session import small

NAN = float("nan")


def confusion(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows (key, y, pred): tp, fp, fn, tn, precision, recall, specificity, f1, accuracy; NaN for 0 / 0."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    c = rows.groupBy(*key).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    d = lambda a, b: N.divided(a, b, NAN)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumn("n", tp + fp + fn + tn).withColumn("precision", d(tp, tp + fp)).withColumn("recall", d(tp, tp + fn)).withColumn("specificity", d(tn, tn + fp)).withColumn("f1", d(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", d(tp + tn, tp + fp + fn + tn))


def _steps(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, score, hits, misses, tp, fp, all_pos, all_neg): counts at each distinct score, and of all rows at or above it.

    Rows are summed per score first; the running sums are on two levels, so no task has
    all scores of a key.
    """
    each = rows.groupBy(*key, "score").agg(F.count_if(F.col("y") == 1).alias("hits"), F.count_if(F.col("y") != 1).alias("misses"))
    out = ranks.running(each, key, "score", ["hits", "misses"])
    return out.withColumnsRenamed({"hits_upto": "tp", "misses_upto": "fp", "hits_all": "all_pos", "misses_all": "all_neg"})


def ranking(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_pos, n_neg, auroc, auprc, best_f1, best_thr) of rows (key, y, score); one class: NaN, NaN, 0, 0.5."""
    s = _steps(rows, key)
    area = F.sum(F.col("misses") * (F.col("tp") - F.col("hits") / 2)) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    average = F.sum(F.col("hits") * precision) / F.nullif(F.max("all_pos"), F.lit(0))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))
    s = s.withColumn("f1", f1)
    best = F.min(F.struct((-F.col("f1")).alias("f1"), F.col("score").alias("thr")))
    out = s.groupBy(*key).agg(F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"), area.alias("auroc"), average.alias("auprc"), best.alias("best"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*key, "n_pos", "n_neg", F.when(both, F.col("auroc")).otherwise(NAN).alias("auroc"), F.when(both, F.col("auprc")).otherwise(NAN).alias("auprc"), F.when(both, -F.col("best.f1")).otherwise(0.0).alias("best_f1"), F.when(both, F.col("best.thr")).otherwise(0.5).alias("best_thr"))


def grid_thresholds(rows: DataFrame, key: list[str], n: int = 500) -> DataFrame:
    """(key, thr_f1, f1, thr_j, j) on the grid i / n, the lowest of equal maxima: a histogram of the grid and suffix sums.

    A score counts at grid points i / n <= score; its largest one is found
    against the grid's own values.
    """
    near = F.floor(F.col("score") * n).cast("int")
    at = F.when((near + 1) / F.lit(float(n)) <= F.col("score"), near + 1).when(near / F.lit(float(n)) > F.col("score"), near - 1).otherwise(near)
    bins = rows.withColumn("i", F.least(F.greatest(at, F.lit(-1)), F.lit(n))).groupBy(*key, "i").agg(F.count_if(F.col("y") == 1).alias("hits"), F.count_if(F.col("y") != 1).alias("misses"))
    keys = bins.groupBy(*key).agg(F.sum("hits").alias("all_pos"), F.sum("misses").alias("all_neg"))
    full = keys.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).join(bins, [*key, "i"], "left")
    up = W.partitionBy(*key).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("tp", F.coalesce(F.sum("hits").over(up), F.lit(0))).withColumn("fp", F.coalesce(F.sum("misses").over(up), F.lit(0)))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "all_pos", "all_neg"))
    full = full.withColumn("f1", N.divided(2 * tp, tp + fp + pos, 0.0)).withColumn("j", N.divided(tp, pos, 0.0) + N.divided(neg - fp, neg, 0.0) - 1)
    first = lambda c: F.min(F.struct((-F.col(c)).alias("v"), "i"))
    out = full.groupBy(*key).agg(F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"), first("f1").alias("a"), first("j").alias("b"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pick = lambda c: F.when(both, c).otherwise(NAN)
    return out.select(*key, pick(F.col("a.i") / float(n)).alias("thr_f1"), pick(-F.col("a.v")).alias("f1"), pick(F.col("b.i") / float(n)).alias("thr_j"), pick(-F.col("b.v")).alias("j"), "n_pos", "n_neg")


def class_scores(rows: DataFrame, mapping: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Concepts' (pred, prob) as classes': any 1, and the largest prob that is no NaN (NaN without one)."""
    out = rows.join(F.broadcast(mapping), "name").groupBy(sample, "class").agg(F.max(F.coalesce("pred", F.lit(0))).alias("pred"), F.max(F.nanvl("prob", F.lit(None).cast("double"))).alias("prob"))
    return out.withColumn("prob", F.coalesce("prob", F.lit(NAN)))


def masked_bce(rows: DataFrame, *, smoothing: float = 0.0) -> DataFrame:
    """(plain, balanced) of rows (name, z, y, valid, weight): mean over valid entries, and mean of concepts' means; 0 without any."""
    y = F.col("y") * (1 - smoothing) + smoothing / 2
    loss = F.col("weight") * y * N.softplus(-F.col("z")) + (1 - y) * N.softplus("z")
    per = rows.where("valid").groupBy("name").agg(F.sum(loss).alias("s"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("plain"), F.coalesce(F.avg(F.col("s") / F.col("n")), F.lit(0.0)).alias("balanced"))


def info_nce(rows: DataFrame, *, tau: float = 0.07, taus: DataFrame | None = None, symmetric: bool = True) -> DataFrame:
    """(macro, weighted) contrastive losses of rows (batch, name, sample, v, u): within a batch's concept each v against all u.

    Concepts with fewer than two rows in a batch are skipped.  Pairs are made
    within (batch, concept), whose size is the batch size.  taus (name, tau): the
    temperatures of single concepts; the others have `tau`.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    a = rows.select("batch", "name", F.col("sample").alias("i"), N.unit("v", 1e-6, True).alias("v"))
    b = rows.select("batch", "name", F.col("sample").alias("k"), N.unit("u", 1e-6, True).alias("u"))
    if taus is not None:
        own = taus.select(F.col("name").alias("_name"), F.when(F.col("tau") > 0, F.col("tau").cast("double")).otherwise(F.raise_error(F.lit("tau must be positive")).cast("double")).alias("_tau"))
        a = a.join(small(own), F.col("name") == F.col("_name"), "left").withColumn("tau", F.coalesce("_tau", F.lit(float(tau)))).drop("_name", "_tau")
    else:
        a = a.withColumn("tau", F.lit(float(tau)))
    pairs = a.join(b, ["batch", "name"]).withColumn("z", N.dot("v", "u") / F.col("tau"))

    def one(side: str):
        per = pairs.groupBy("batch", "name", side).agg(F.max("z").alias("m"), F.collect_list("z").alias("zs"), F.max(F.when(F.col("i") == F.col("k"), F.col("z"))).alias("d"))
        total = F.aggregate("zs", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("m")))
        return per.select("batch", "name", (F.col("m") + F.ln(total) - F.col("d")).alias("loss"))

    each = one("i").groupBy("batch", "name").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
    if symmetric:
        other = one("k").groupBy("batch", "name").agg(F.avg("loss").alias("back"))
        each = each.join(other, ["batch", "name"]).withColumn("loss", (F.col("loss") + F.col("back")) / 2)
    each = each.where("n > 1")
    return each.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("macro"), F.coalesce(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("weighted"))


def mean_of_means(rows: DataFrame, batch: str, value: str) -> DataFrame:
    return rows.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def total_loss(cls, align, w_cls: float = 1.0, w_align: float = 1.0):
    return F.lit(w_cls) * F.coalesce(cls, F.lit(0.0)) + F.lit(w_align) * F.coalesce(align, F.lit(0.0))


def best_epoch(log: DataFrame, metric: str, split: str = "val") -> DataFrame:
    """The row of a metric log with the largest value, the earliest epoch on ties."""
    return log.where((F.col("metric") == metric) & (F.col("split") == split)).orderBy(F.desc("value"), "epoch").limit(1)


def finite(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows whose score is a finite number."""
    return rows.where(N.is_finite(score))


def targets(predictions: DataFrame, *, positive: bool = True, predicted: bool = False, most: int | None = None, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Rows (class, key, gt, pred, ..) with a valid ground truth; positive ones, predicted ones; at most so many of each class, by hash."""
    rows = predictions.where(F.col("gt").isin(0, 1))
    if positive:
        rows = rows.where("gt = 1")
    if predicted:
        rows = rows.where("pred = 1")
    if most is None:
        return rows
    turn = F.row_number().over(W.partitionBy("class", "split").orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")


def classification(scores: DataFrame, truth: DataFrame, mapping: DataFrame, thresholds: DataFrame, *, default: float = 0.5) -> DataFrame:
    """Per split and class: confusion counts and shares, AUROC and AUPRC over finite scores, of mapped concept scores.

    scores (split, sample_id, name, prob), truth (split, sample_id, class, gt; null for
    none), mapping (name, class), thresholds (name, thr).  The model's forward pass is
    the table of scores.
    """
    rows = scores.join(F.broadcast(thresholds.select("name", "thr")), "name", "left").withColumn("pred", (F.col("prob") >= F.coalesce("thr", F.lit(default))).cast("int"))
    keyed = rows.withColumn("sample_id", F.struct("split", "sample_id"))
    mapped = class_scores(keyed, mapping).select("sample_id.split", "sample_id.sample_id", "class", "pred", "prob")
    both = mapped.join(truth.where(F.col("gt").isin(0, 1)), ["split", "sample_id", "class"]).withColumn("y", F.col("gt"))
    counts = confusion(both, ["split", "class"])
    ranked = ranking(finite(both.withColumn("score", F.col("prob"))), ["split", "class"]).select("split", "class", "auroc", "auprc")
    all_ = truth.select("split").distinct().crossJoin(F.broadcast(mapping.select("class").distinct()))
    out = all_.join(counts, ["split", "class"], "left").join(ranked, ["split", "class"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def macro(per_class: DataFrame, columns: tuple[str, ...] = ("auroc", "auprc"), key: str = "split") -> DataFrame:
    """Means over classes, without null and NaN."""
    return per_class.groupBy(key).agg(*(F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(f"macro_{c}") for c in columns))
