"""Pictures as rows: Spark expressions on an array of pixels (row by row), its height and its width.

A value of a pixel is an element of `transform`; what a picture has of its own (mean,
deviation, quantiles, sizes) is an expression on the whole array; the cumulative
histogram that equalisation needs is rows of `stats.histogram`, joined back.
Resizing is separable, and described by *taps*: for each place of the result, the
first place of the source it reads, and its weights from there on.  So one expression
resizes by any kind, and pictures of a table may differ in size.

A null picture stays null; an empty one stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import grounding, stats
from loomwork.operators.grounding import let

#: Channel means and deviations of two public encoders.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
RAD_DINO = ((0.5307, 0.5307, 0.5307), (0.2583, 0.2583, 0.2583))
#: Percentiles of a stretch, and the bins of an equalisation.
LOW, HIGH, LEVELS = 1.0, 99.0, 2048


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _upto(n) -> Column:
    """0 .. n - 1"""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _doubles(pixels) -> Column:
    return _col(pixels).cast("array<double>")


def _sum(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _ranked(pixels) -> Column:
    return F.array_sort(_doubles(pixels))


def _at_share(ranked, share: float) -> Column:
    at = F.lit(share) * (F.size(ranked) - 1)
    low, high = (F.get(ranked, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def quantile(pixels, share: float) -> Column:
    """The value below which `share` of the pixels lie, interpolated."""
    return let(_ranked(pixels), lambda r: _at_share(r, share))


def moments(pixels) -> Column:
    """struct(n, mean, deviation): the unbiased deviation, 0 for one pixel."""
    x = _doubles(pixels)
    n = F.size(x)
    total = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("k")), lambda s, v: F.struct((s["s"] + v).alias("s"), (s["k"] + 1).alias("k")), lambda s: s["s"] / s["k"])
    off = F.zip_with(x, F.array_repeat(total, n), lambda v, m: (v - m) * (v - m))
    return F.struct(n.alias("n"), total.alias("mean"), F.when(n > 1, F.sqrt(_sum(off) / (n - 1))).otherwise(0.0).alias("deviation"))


def stretched(pixels, low: float = LOW, high: float = HIGH, least: float = 0.0) -> Column:
    """Contrast: pixels as shares of the way between two percentiles, held to [0, 1]; as they are if the way is not longer than `least`."""
    x = _doubles(pixels)
    held = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    ends = let(_ranked(pixels), lambda r: F.struct(_at_share(r, low / 100).alias("a"), _at_share(r, high / 100).alias("b")))
    moved = lambda e: F.when(e["b"] > e["a"] + least, F.transform(x, lambda v: held((v - e["a"]) / (e["b"] - e["a"])))).otherwise(x)
    return F.when(x.isNotNull(), let(ends, moved))


def equalised(rows: DataFrame, key: list[str], pixels: str = "pixels", levels: int = LEVELS) -> DataFrame:
    """rows (key, pixels of [0, 1]) with each pixel as its share of the picture's cumulative histogram, linear between the left edges of its bins.

    Pixels beyond [0, 1] are held to it.  The histogram is a row for each level that a
    picture has; levels between them are filled in when it is gathered as one array.
    """
    held = rows.withColumn("_held", F.transform(_doubles(pixels), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))
    bins = stats.histogram(held.select(*key, F.explode("_held").alias("_v")), "_v", levels, 0.0, 1.0, key)
    cells = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bin", "cdf"))).alias("_c")).select(*(F.col(k).alias(f"_{k}") for k in key), "_c")
    spans = F.transform("_c", lambda c, i: F.array_repeat(c["cdf"], F.coalesce(F.get("_c", i + 1)["bin"], F.lit(levels)) - c["bin"]))
    dense = F.concat(F.array_repeat(F.lit(0.0), F.get("_c", F.lit(0))["bin"]), F.flatten(spans))
    cells = cells.withColumn("_c", dense).withColumn("_base", F.get("_c", F.lit(0)))
    joined = held.join(cells, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")

    def share(v):
        at = F.least(F.floor(v * levels), F.lit(levels - 1)).cast("int")
        here = F.get("_c", at)
        there = F.coalesce(F.get("_c", at + 1), here)
        value = here + (there - here) * (v * levels - at)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.col("_base")) / F.greatest(1 - F.col("_base"), F.lit(1e-12))))

    out = F.when(F.size("_held") > 0, F.transform("_held", share)).otherwise(F.col("_held"))
    return joined.withColumn(pixels, out).select(*rows.columns)


# ------------------------------------------------------------ resizing


def taps(n_in: Column, n_out: Column, kind: str) -> Column:
    """For each of n_out places: struct(first, weights) of the n_in places it is made from.

    nearest: the one whose span holds the place's centre.  linear: the two centres around
    it.  bilinear: a triangle as wide as the step between places, at least 1, so that a
    smaller picture is averaged.
    """
    step = n_in / n_out.cast("double")
    centre = lambda i: (i + 0.5) * step
    last = n_in - 1
    if kind == "nearest":
        one = lambda i: F.struct(F.least(F.floor(centre(i)).cast("int"), last).alias("first"), F.array(F.lit(1.0)).alias("weights"))
    elif kind == "linear":

        def one(i):
            at = F.greatest(centre(i) - 0.5, F.lit(0.0))
            first = F.least(F.floor(at).cast("int"), last)
            return F.struct(first.alias("first"), F.when(first < last, F.array(1 - (at - first), at - first)).otherwise(F.array(F.lit(1.0))).alias("weights"))

    elif kind == "bilinear":
        reach = F.greatest(step, F.lit(1.0))

        def one(i):
            first = F.greatest(F.ceil(centre(i) - reach - 0.5), F.lit(0)).cast("int")
            final = F.least(F.floor(centre(i) + reach - 0.5).cast("int"), last)
            raw = F.transform(F.sequence(first, final), lambda k: F.greatest(F.lit(0.0), 1 - F.abs(k + 0.5 - centre(i)) / reach))
            return F.struct(first.alias("first"), F.zip_with(raw, F.array_repeat(_sum(raw), F.size(raw)), lambda w, s: w / s).alias("weights"))

    else:
        raise ValueError(kind)
    return F.transform(_upto(n_out), one)


def resized(pixels, height, width, to_height, to_width, kind: str = "bilinear") -> Column:
    """The pixels of another size: rows are mixed first, then the places of each row."""
    x, h, w = _doubles(pixels), _col(height).cast("int"), _col(width).cast("int")
    goal_h, goal_w = (F.lit(v) if isinstance(v, int) else _col(v).cast("int") for v in (to_height, to_width))
    share = lambda t, k: F.get(t["weights"], k)
    mixed = lambda p, t: F.aggregate(_upto(F.size(t["weights"])), F.array_repeat(F.lit(0.0), w), lambda s, k: F.zip_with(s, F.slice(p, (t["first"] + k) * w + 1, w), lambda a, b: a + b * share(t, k)))
    place = lambda r, t: F.aggregate(_upto(F.size(t["weights"])), F.lit(0.0), lambda s, k: s + F.get(r, t["first"] + k) * share(t, k))
    rows = let(x, lambda p: F.transform(taps(h, goal_h, kind), lambda t: mixed(p, t)))
    out = let(taps(w, goal_w, kind), lambda across: F.flatten(F.transform(rows, lambda r: F.transform(across, lambda t: place(r, t)))))
    return F.when(x.isNotNull(), out)


def letterboxed(pixels, height, width, size: int, *, pad: float = 0.0, kind: str = "bilinear") -> Column:
    """size x size: the picture with its proportions kept, in the middle of `pad`."""
    box = grounding.letterbox(_col(height), _col(width), size)
    h, w, y0, x0 = (box[f] for f in ("nh", "nw", "y0", "x0"))
    inner = resized(pixels, height, width, h, w, kind)
    blank = lambda n: F.array_repeat(F.lit(float(pad)), n)
    line = lambda part, y: F.concat(blank(x0), F.slice(part, (y - y0) * w + 1, w), blank(F.lit(size) - x0 - w))
    lines = lambda part: F.transform(_upto(F.lit(size)), lambda y: F.when((y >= y0) & (y < y0 + h), line(part, y)).otherwise(blank(F.lit(size))))
    return F.when(_col(pixels).isNotNull(), F.flatten(let(inner, lines)))


def squared(pixels, height, width, size: int, *, keep: bool = True, pad: float = 0.0, kind: str = "bilinear") -> Column:
    """size x size: letterboxed, or (keep: false) scaled as a whole."""
    return letterboxed(pixels, height, width, size, pad=pad, kind=kind) if keep else resized(pixels, height, width, size, size, kind)


def evaluated(height, width, size: int, region: str = "non_padded") -> Column:
    """Which of size x size places count: those that a letterboxed picture covers, or the full_canvas."""
    if region == "full_canvas":
        return F.array_repeat(F.lit(True), size * size)
    if region != "non_padded":
        raise ValueError(region)
    box = grounding.letterbox(_col(height), _col(width), size)
    inside = lambda v, start, n: (v >= start) & (v < start + n)
    return F.transform(_upto(F.lit(size * size)), lambda i: inside(F.floor(i / size), box["y0"], box["nh"]) & inside(i % size, box["x0"], box["nw"]))


def raised(grid, height, width, size: int) -> Column:
    """A small attention grid, raised linearly to size x size."""
    return resized(grid, height, width, size, size, "linear")


# ------------------------------------------------------------ normalisation


def _channels(pixels: Column, table) -> Column:
    """Three channels, one after another, each less its mean and over its deviation."""
    one = lambda m, s: F.transform(pixels, lambda v: (v - m) / s)
    return F.concat(*(one(m, s) for m, s in zip(*table, strict=True)))


def _own(pixels: Column, eps: float) -> Column:
    parts = F.array_repeat(moments(pixels), F.size(pixels))
    return F.zip_with(pixels, parts, lambda v, m: (v - m["mean"]) / F.when(m["deviation"] < eps, 1.0).otherwise(m["deviation"]))


def normalised(pixels, mode: str, *, mean: float | None = None, std: float | None = None, low: float = LOW, high: float = HIGH, eps: float = 1e-6) -> Column:
    """none; imagenet, rad_dino_maira_2: channels (the latter from 0 .. 255 if a value passes 1.5); cxr_global: by a table's mean and std, if both are given and std is no less than eps; cxr_per_image: by its own, only centred when flat; cxr_percentile: stretched."""
    x = _doubles(pixels)
    known = mean is not None and std is not None and std >= eps
    modes = {
        "none": lambda: x,
        "imagenet": lambda: _channels(x, IMAGENET),
        "rad_dino_maira_2": lambda: _channels(F.when(F.array_max(x) > 1.5, F.transform(x, lambda v: v / 255)).otherwise(x), RAD_DINO),
        "cxr_global": lambda: F.transform(x, lambda v: (v - mean) / std) if known else x,
        "cxr_per_image": lambda: _own(x, eps),
        "cxr_percentile": lambda: stretched(x, low, high, eps),
    }
    if mode not in modes:
        raise ValueError(mode)
    return modes[mode]()
