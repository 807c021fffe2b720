"""Mask overlap and localisation: run-length masks, letterbox geometry, overlap, threshold sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from loomwork.functions import numeric as N


def decode_runs(counts: str) -> list[int]:
    """Run lengths of a compressed string: 5-bit groups, low first, signed; from the fourth on relative to the one two before."""
    runs: list[int] = []
    value = shift = 0
    for ch in counts:
        bits = ord(ch) - 48
        value |= (bits & 31) << shift
        shift += 5
        if bits & 32:
            continue
        if bits & 16:
            value -= 1 << shift
        runs.append(value + (runs[-2] if len(runs) > 2 else 0))
        value = shift = 0
    return runs


def encode_runs(runs: list[int]) -> str:
    """The string that decode_runs reads."""
    out = []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        while True:
            bits, x = x & 31, x >> 5
            more = not (x == 0 and not bits & 16 or x == -1 and bits & 16)
            out.append(chr(bits + 32 * more + 48))
            if not more:
                break
    return "".join(out)


def mask_of(runs: list[int], height: int, width: int) -> np.ndarray:
    """A height x width mask: runs alternate 0 and 1 down the columns."""
    flat = np.repeat(np.arange(len(runs)) % 2, runs).astype(bool)
    return np.pad(flat, (0, max(0, height * width - len(flat))))[: height * width].reshape(width, height).T


def with_runs(rows: DataFrame, counts: str = "counts") -> DataFrame:
    """rows with a column `runs`: null for null."""
    def run(batches):
        for b in batches:
            cells = [None if c is None else decode_runs(c) for c in b.column(counts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], [*b.schema.names, "runs"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("runs", ArrayType(LongType())))


def with_encoded(rows: DataFrame, runs: str = "runs", into: str = "counts") -> DataFrame:
    """rows with the compressed string of their run lengths."""
    def run(batches):
        for b in batches:
            cells = [None if r is None else encode_runs(r) for r in b.column(runs).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, "string"))


def area(runs) -> Column:
    """Pixels of a mask: the sum of every second run."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)


# ------------------------------------------------------------ masks as edges: a picture is one row


def with_edges(rows: DataFrame, counts: str = "counts", into: str = "edges") -> DataFrame:
    """rows with the positions at which a compressed mask flips, off before the first; null for null."""
    def run(batches):
        for b in batches:
            cells = [None if c is None else np.cumsum(decode_runs(c)) for c in b.column(counts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], [*b.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, ArrayType(LongType())))


def with_counts(rows: DataFrame, edges: str = "edges", into: str = "counts") -> DataFrame:
    """rows with the compressed string of a mask given by its edges: the other way round."""
    def run(batches):
        for b in batches:
            cells = [None if c is None else encode_runs(np.diff([0, *c]).tolist()) for c in b.column(edges).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, "string"))


def let(value, body) -> Column:
    """body(value), with the value computed once for a row however often, and in whichever lambda, the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edges_of(mask) -> Column:
    """The edges of an array of booleans."""
    none = F.array().cast("array<int>")

    def found(m):
        n = F.size(m)
        turns = F.zip_with(F.slice(m, 2, F.greatest(n, F.lit(1))), F.slice(m, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x != y)
        flips = F.filter(F.transform(turns, lambda t, i: F.when(t, i + 1)), lambda x: x.isNotNull())
        return F.concat(F.when(F.get(m, F.lit(0)), F.array(F.lit(0))).otherwise(none), flips, F.when(F.get(m, n - 1), F.array(n)).otherwise(none))

    return F.transform(let(mask, found), lambda x: x.cast("long"))


def mask_from(edges, n) -> Column:
    """The array of n booleans with these edges."""
    ends = F.concat(F.filter(edges, lambda x: x < n), F.array(n.cast("long")))
    sizes = let(ends, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0).cast("long")), F.slice(e, 1, F.size(e) - 1)), lambda to, at: (to - at).cast("int")))
    return F.flatten(F.transform(sizes, lambda x, i: F.array_repeat(i % 2 == 1, x)))


def edge_area(edges) -> Column:
    """Pixels between every second pair of edges."""
    return F.aggregate(F.transform(edges, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def edge_overlap(a, b) -> Column:
    """Pixels that two masks share: one sweep over the edges of both."""
    tag = lambda edges, k: F.transform(edges, lambda x: F.struct(x.cast("long").alias("at"), F.lit(k).alias("of")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("a"), F.lit(False).alias("b"), F.lit(0).cast("long").alias("both"))
    step = lambda s, e: F.struct(e["at"].alias("at"), (s["a"] != (e["of"] == 0)).alias("a"), (s["b"] != (e["of"] == 1)).alias("b"), (s["both"] + F.when(s["a"] & s["b"], e["at"] - s["at"]).otherwise(0)).alias("both"))
    return F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), start, step, lambda s: s["both"])


def mask_overlap(masks: DataFrame, key: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """(key, inter, dice, iou) of masks (key, edges of pred and gt): a row a picture, no shuffle."""
    rows = masks.select(*key, edge_area(pred).alias("p"), edge_area(gt).alias("g"), edge_overlap(pred, gt).alias("inter"))
    return rows.select(*key, "inter", (2 * F.col("inter") / (F.col("p") + F.col("g") + 1e-8)).alias("dice"), (F.col("inter") / (F.col("p") + F.col("g") - F.col("inter") + 1e-8)).alias("iou"))


def pictures(pixels: DataFrame, key: list[str]) -> DataFrame:
    """pixels (key, pos, a, gt; maybe inside) as a row each: a (values by position), edges of gt and inside, counted by rank of position."""
    inside = F.col("inside") if "inside" in pixels.columns else F.lit(True)
    cells = pixels.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "gt", inside.alias("inside")))).alias("c"))
    of = lambda f: F.transform("c", lambda x: x[f])
    return cells.select(*key, of("a").alias("a"), edges_of(of("gt")).alias("gt"), edges_of(of("inside")).alias("inside"))


def picture_metrics(rows: DataFrame, key: list[str], threshold: float = 0.5, *, method: str = "fixed", percentile: float = 98.0) -> DataFrame:
    """The case metrics of pictures (key, a, edges of gt; maybe of inside): expressions on one row a picture, no window and no shuffle.

    One array of the pixels inside, by falling a and rising position, serves
    pointing, top-k, percentile and ranking; see `case_metrics` for what they are.
    """
    if method not in ("fixed", "percentile", "topk"):
        raise ValueError(method)
    n = F.size("a")
    inside = mask_from(F.col("inside"), n) if "inside" in rows.columns else F.array_repeat(F.lit(True), n)
    marks = F.zip_with(mask_from(F.col("gt"), n), inside, lambda g, i: F.struct(g.alias("gt"), i.alias("in")))
    cells = F.transform(F.zip_with("a", marks, lambda a, m: F.struct(a.alias("a"), m["gt"].alias("gt"), m["in"].alias("in"))), lambda x, i: F.when(x["in"], F.struct((-x["a"]).alias("far"), i.alias("pos"), x["gt"].alias("gt"))))
    rows = rows.select(*key, edge_area("gt").alias("_g"), F.array_sort(F.filter(cells, lambda x: x.isNotNull())).alias("_c")).where(F.size("_c") > 0)
    count = lambda cells: F.size(cells)
    hits = lambda cells: F.size(F.filter(cells, lambda x: x["gt"]))
    top = F.slice("_c", 1, F.greatest(F.lit(1), F.col("_g")).cast("int"))
    m = F.size("_c")
    p = F.lit(percentile / 100) * (m - 1)
    value = lambda i: -F.get("_c", m - 1 - i.cast("int"))["far"]
    cut = {"fixed": F.lit(float(threshold)), "topk": F.lit(float("nan")), "percentile": value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * (p - F.floor(p))}[method]
    rows = rows.withColumn("threshold", cut)
    hit = top if method == "topk" else F.filter("_c", lambda x: -x["far"] >= F.col("threshold"))
    total = lambda only: F.aggregate("_c", F.lit(0.0), lambda s, x: s + F.when(x["gt"] | F.lit(not only), -x["far"]).otherwise(0.0))
    zero = F.lit(0).cast("long")
    names = ("far", "h", "m", "tp", "fp", "area", "ap")
    start = F.struct(*(v.alias(w) for v, w in zip((F.lit(None).cast("double"), zero, zero, zero, zero, F.lit(0.0), F.lit(0.0)), names, strict=True)))

    def step(s, x):
        """tp and fp count all pixels so far; the last h and m of them are of one value, whose part of the areas is added when it ends."""
        same = s["far"] == x["far"]
        h, miss = x["gt"].cast("long"), 1 - x["gt"].cast("long")
        gain = lambda f, v: s[f] + F.when(same, 0.0).otherwise(v)
        more = (x["far"], F.when(same, s["h"]).otherwise(zero) + h, F.when(same, s["m"]).otherwise(zero) + miss, s["tp"] + h, s["fp"] + miss, gain("area", s["m"] * (s["tp"] - s["h"] / 2)), gain("ap", F.when(s["h"] > 0, s["h"] * s["tp"] / (s["tp"] + s["fp"])).otherwise(0.0)))
        return F.struct(*(v.alias(w) for v, w in zip(more, names, strict=True)))

    last = lambda s: F.struct(s["tp"].alias("tp"), s["fp"].alias("fp"), (s["area"] + s["m"] * (s["tp"] - s["h"] / 2)).alias("area"), (s["ap"] + F.when(s["h"] > 0, s["h"] * s["tp"] / (s["tp"] + s["fp"])).otherwise(0.0)).alias("ap"))
    ranked = F.aggregate(F.transform("_c", lambda x: F.struct(x["far"].cast("double").alias("far"), x["gt"].alias("gt"))), start, step, last)
    out = rows.select(
        *key, "_g", "threshold", (total(True) / (total(False) + 1e-8)).alias("energy"), F.get("_c", F.lit(0))["gt"].cast("int").alias("pointing"), count(top).alias("n_top"), hits(top).alias("i_top"), count(hit).alias("n_hit"), hits(hit).alias("i_hit"), ranked.alias("r"),
    )
    d = lambda c: 2 * F.col(f"i_{c}") / (F.col(f"n_{c}") + F.col("_g") + 1e-8)
    u = lambda c: F.col(f"i_{c}") / (F.col(f"n_{c}") + F.col("_g") - F.col(f"i_{c}") + 1e-8)
    both = (F.col("r.tp") > 0) & (F.col("r.fp") > 0)
    curve = lambda c: F.when(both, c).otherwise(float("nan"))
    return out.select(*key, "energy", "pointing", d("top").alias("topk_dice"), u("top").alias("topk_iou"), d("hit").alias("dice"), u("hit").alias("iou"), "threshold", curve(F.col("r.area") / (F.col("r.tp") * F.col("r.fp"))).alias("auroc"), curve(F.col("r.ap") / F.col("r.tp")).alias("auprc"))


def with_suffix_counts(rows: DataFrame, n: int = 100) -> DataFrame:
    """pictures with p and x: how many pixels inside, and how many of them of the ground truth, have a >= i / n, for i = 0 .. n."""
    schema = StructType([*rows.schema.fields]).add("p", ArrayType(LongType())).add("x", ArrayType(LongType()))
    grid = np.arange(n + 1) / n

    def filled(edges, size: int) -> np.ndarray:
        flips = np.zeros(size + 1, np.int64)
        np.add.at(flips, np.minimum(np.asarray(edges, np.int64), size), 1)
        return np.cumsum(flips[:-1]) % 2 == 1

    def run(batches):
        for b in batches:
            found = []
            inside = b.column("inside").to_pylist() if "inside" in b.schema.names else [None] * b.num_rows
            for a, gt, box in zip(b.column("a").to_pylist(), b.column("gt").to_pylist(), inside, strict=True):
                a = np.asarray(a, float)
                keep = np.ones(len(a), bool) if box is None else filled(box, len(a))
                at = np.searchsorted(grid, a[keep], "right")  # grid points up to a
                found.append([np.cumsum(np.bincount(at[w], minlength=n + 2)[:0:-1])[::-1] for w in (slice(None), filled(gt, len(a))[keep])])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))], schema.names)

    return rows.mapInArrow(run, schema)


def picture_sweep(rows: DataFrame, by: list[str], n: int = 100) -> DataFrame:
    """(by.., thr_dice, dice, thr_iou, iou) of pictures (by.., a, edges of gt; maybe of inside): n + 1 rows a picture, not one a pixel."""
    cells = with_suffix_counts(rows, n)
    whole = mask_from(F.col("gt"), F.size("a"))
    inner = mask_from(F.col("inside"), F.size("a")) if "inside" in rows.columns else F.array_repeat(F.lit(True), F.size("a"))
    cells = cells.withColumn("_g", F.size(F.filter(F.zip_with(whole, inner, lambda g, i: g & i), lambda v: v))).where("_g > 0")
    full = cells.select(*by, "_g", F.posexplode(F.arrays_zip("p", "x")).alias("i", "c")).select(*by, "_g", "i", "c.p", "c.x")
    per = full.groupBy(*by, "i").agg(F.sum(2 * F.col("x") / (F.col("p") + F.col("_g") + 1e-8)).alias("dice"), F.sum(F.col("x") / (F.col("p") + F.col("_g") - F.col("x") + 1e-8)).alias("iou"))
    return _best_of_grid(per, by, n)


def _best_of_grid(per: DataFrame, by: list[str], n: int) -> DataFrame:
    first = lambda c: F.min(F.struct((-F.round(c, 9)).alias("v"), "i"))
    out = (per.groupBy(*by) if by else per).agg(first("dice").alias("d"), first("iou").alias("u"))
    return out.select(*by, F.coalesce(F.col("d.i") / float(n), F.lit(0.5)).alias("thr_dice"), (-F.col("d.v")).alias("dice"), F.coalesce(F.col("u.i") / float(n), F.lit(0.5)).alias("thr_iou"), (-F.col("u.v")).alias("iou"))


# ------------------------------------------------------------ geometry, and measures a row a pixel


def letterbox(h, w, size: int) -> Column:
    """struct(scale, nh, nw, y0, x0): the picture scaled into a square, centred."""
    scale = F.lit(float(size)) / F.greatest(h, w)
    nh, nw = (F.greatest(F.lit(1), F.bround(s * scale, 0).cast("int")) for s in (h, w))
    return F.struct(scale.alias("scale"), nh.alias("nh"), nw.alias("nw"), F.floor((size - nh) / 2).cast("int").alias("y0"), F.floor((size - nw) / 2).cast("int").alias("x0"))


def overlap(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, inter, dice, iou) of pixels (key, pred, gt)."""
    p, g = F.count_if("pred"), F.count_if("gt")
    inter = F.count_if(F.col("pred") & F.col("gt"))
    return pixels.groupBy(*key).agg(p.alias("p"), g.alias("g"), inter.alias("inter")).select(*key, "inter", (2 * F.col("inter") / (F.col("p") + F.col("g") + 1e-8)).alias("dice"), (F.col("inter") / (F.col("p") + F.col("g") - F.col("inter") + 1e-8)).alias("iou"))


def normalised(pixels: DataFrame, key: list[str], how: str = "minmax") -> DataFrame:
    """pixels (key, a, inside) with `a` scaled over the region inside, 0 outside: minmax (flat: 0), sum, none."""
    per = W.partitionBy(*key)
    mine = F.when(F.col("inside"), F.col("a"))
    lo, hi, total = F.min(mine).over(per), F.max(mine).over(per), F.sum(mine).over(per)
    a = {"minmax": F.when(hi > lo, (F.col("a") - lo) / (hi - lo)).otherwise(0.0), "sum": N.divided(F.col("a"), total, 0.0), "none": F.col("a")}[how]
    return pixels.withColumn("a", F.when(F.col("inside"), a).otherwise(F.lit(0.0)))


def case_metrics(pixels: DataFrame, key: list[str], threshold: float = 0.5, *, method: str = "fixed", percentile: float = 98.0, thresholds: DataFrame | None = None) -> DataFrame:
    """(key, energy, pointing, topk_dice, topk_iou, dice, iou, threshold, auroc, auprc) of pixels (key, pos, a, gt; maybe inside).

    Only pixels inside count, but the ground truth's own size is that of all.
    pointing: the ground truth at the largest a, lowest position first; top-k takes
    as many pixels as the ground truth has, at least one.  dice and iou are those of a
    mask: a >= `threshold` (fixed), a >= the case's percentile (percentile), the
    top-k itself (topk), or, with thresholds (key of them, thr_dice, thr_iou), a >=
    the one best for each.  auroc and auprc rank the pixels inside, NaN for one class.
    """
    from loomwork.operators import metrics as M

    if method not in ("fixed", "percentile", "topk"):
        raise ValueError(method)
    per = W.partitionBy(*key)
    if "inside" not in pixels.columns:
        pixels = pixels.withColumn("inside", F.lit(True))
    gt = F.col("gt").cast("int")
    rows = pixels.withColumn("g", F.sum(gt).over(per)).where("inside")
    k = F.greatest(F.lit(1), F.col("g"))
    rows = rows.withColumn("turn", F.row_number().over(per.orderBy(F.desc("a"), "pos"))).withColumn("top", F.col("turn") <= k)
    if thresholds is not None:
        rows = rows.join(F.broadcast(thresholds), [c for c in thresholds.columns if not c.startswith("thr_")])
        cut, cut_dice = F.col("thr_iou"), F.col("thr_dice")
    elif method == "percentile":
        cuts = rows.groupBy(*key).agg(F.percentile("a", percentile / 100).alias("_cut"))
        rows = rows.join(cuts, key)
        cut = cut_dice = F.col("_cut")
    else:
        cut = cut_dice = F.lit(float("nan") if method == "topk" else float(threshold))
    hit = F.col("top") if method == "topk" and thresholds is None else F.col("a") >= cut
    hit_dice = F.col("top") if method == "topk" and thresholds is None else F.col("a") >= cut_dice
    rows = rows.withColumn("hit", hit).withColumn("hit_dice", hit_dice).withColumn("cut", cut)
    n, inter = lambda c: F.count_if(F.col(c)), lambda c: F.count_if(F.col(c) & F.col("gt"))
    out = rows.groupBy(*key).agg(
        (F.sum(F.when(F.col("gt"), F.col("a")).otherwise(0.0)) / (F.sum("a") + 1e-8)).alias("energy"), F.max(F.when(F.col("turn") == 1, gt)).alias("pointing"), F.max("g").alias("g"), F.max("cut").alias("threshold"),
        *(f(c).alias(f"{w}_{c}") for c in ("top", "hit", "hit_dice") for w, f in (("n", n), ("i", inter))),
    )
    d = lambda c: 2 * F.col(f"i_{c}") / (F.col(f"n_{c}") + F.col("g") + 1e-8)
    u = lambda c: F.col(f"i_{c}") / (F.col(f"n_{c}") + F.col("g") - F.col(f"i_{c}") + 1e-8)
    out = out.select(*key, "energy", "pointing", d("top").alias("topk_dice"), u("top").alias("topk_iou"), d("hit_dice").alias("dice"), u("hit").alias("iou"), "threshold")
    ranked = M.ranking(rows.select(*key, gt.alias("y"), F.col("a").alias("score")), key).select(*key, "auroc", "auprc")
    return out.join(ranked, key)


def localisation(pixels: DataFrame, chosen: DataFrame, *, how: str = "minmax", optimise: str | None = None, grid: int = 100, **options) -> DataFrame:
    """Per (class, split): n_cases and means of the case metrics, without NaN; the driver of the localisation stage.

    pixels (class, split, sample_id, pos, a, gt, inside): attention already of the
    mask's size; chosen (class, split, sample_id): cases by `metrics.targets`.  Cases
    without ground truth go.  optimise: a split on which each class's thresholds are
    swept; the others are then measured with them.
    """
    key = ["class", "split", "sample_id"]
    rows = pixels.join(chosen.select(*key).distinct(), key)
    some = rows.groupBy(*key).agg(F.count_if("gt").alias("_g")).where("_g > 0").select(*key)
    rows = normalised(rows.join(some, key), key, how)
    thresholds = None
    if optimise is not None:
        thresholds = sweep_by(rows.where(F.col("inside") & (F.col("split") == optimise)), ["sample_id"], ["class"], grid).select("class", "thr_dice", "thr_iou")
        rows = rows.where(F.col("split") != optimise)
    cases = case_metrics(rows, key, thresholds=thresholds, **options)
    mean = lambda c: F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"mean_{c}")
    return cases.groupBy("class", "split").agg(F.count("*").alias("n_cases"), *map(mean, ("energy", "pointing", "topk_dice", "topk_iou", "dice", "iou", "auprc")))


def sweep(pixels: DataFrame, key: list[str], n: int = 100) -> DataFrame:
    """(thr_dice, dice, thr_iou, iou): the grid points i / n with the largest sums over cases with ground truth; 0.5 without a case."""
    out = sweep_by(pixels, key, [], n)
    return out.select("thr_dice", "dice", "thr_iou", "iou")


def sweep_by(pixels: DataFrame, key: list[str], by: list[str], n: int = 100) -> DataFrame:
    """The same for each value of `by`; a class without cases is no row.

    A histogram per case and suffix sums, not a pass per threshold.  A pixel counts at
    grid points i / n <= a; its largest one is found against the grid's own values.
    """
    near = F.floor(F.col("a") * n).cast("int")
    at = F.when((near + 1) / F.lit(float(n)) <= F.col("a"), near + 1).when(near / F.lit(float(n)) > F.col("a"), near - 1).otherwise(near)
    both = [*by, *key]
    bins = pixels.withColumn("i", F.least(F.greatest(at, F.lit(-1)), F.lit(n))).groupBy(*both, "i").agg(F.count("*").alias("m"), F.count_if("gt").alias("t"))
    cases = bins.groupBy(*both).agg(F.sum("t").alias("g")).where("g > 0")
    full = cases.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).join(bins, [*both, "i"], "left")
    up = W.partitionBy(*both).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("p", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("x", F.coalesce(F.sum("t").over(up), F.lit(0)))
    per = full.groupBy(*by, "i").agg(F.sum(2 * F.col("x") / (F.col("p") + F.col("g") + 1e-8)).alias("dice"), F.sum(F.col("x") / (F.col("p") + F.col("g") - F.col("x") + 1e-8)).alias("iou"))
    return _best_of_grid(per, by, n)
