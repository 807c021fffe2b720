"""Numeric, hash and vector expressions (Column -> Column)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_label(text) -> Column:
    """A label's integer: booleans, integers, integral floats, digit strings; else null."""
    t = F.lower(F.trim(_c(text)))
    number = t.try_cast("double")
    return F.when(t == "true", 1).when(t == "false", 0).when((number == F.floor(number)) & (F.abs(number) < 1e9), number.cast("int"))


def lenient_float(text) -> Column:
    """A number, or null for '', 'nan' and words."""
    return F.nanvl(F.trim(_c(text)).try_cast("double"), F.lit(None).cast("double"))


def lenient_int(text) -> Column:
    """Cut towards zero."""
    x = lenient_float(text)
    return F.when(F.abs(x) < 9e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))


def is_binary(text) -> Column:
    """'0' or '1' as text, or a number equal to one."""
    return F.coalesce(F.trim(_c(text)).try_cast("double").isin(0.0, 1.0), F.lit(False))


def divided(a, b, empty: float | None = None) -> Column:
    """a / b; `empty` (default null) where b is 0."""
    return F.when(_c(b) == 0, F.lit(empty).cast("double")).otherwise(_c(a) / F.nullif(_c(b), F.lit(0)))


def sigmoid(x, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-_c(x) / F.lit(max(temperature, 1e-6))))


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def is_finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf")), F.lit(False))


def log_temperature(tau, least: float | None = None, most: float | None = None) -> Column:
    """ln(tau) held to the logarithms of the bounds; bounds must be positive and in order."""
    if any(b is not None and b <= 0 for b in (least, most)) or least is not None and most is not None and least >= most:
        raise ValueError("0 < least < most")
    out = F.ln(_c(tau))
    if least is not None:
        out = F.greatest(out, F.ln(F.lit(float(least))))
    return F.least(out, F.ln(F.lit(float(most)))) if most is not None else out


def temperature(log_tau) -> Column:
    return F.exp(_c(log_tau))


def dot(a, b) -> Column:
    """In double precision, component by component in order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a, eps: float = 1e-12, added: bool = False) -> Column:
    """a over its length: eps added to it, or as its least value."""
    n = norm(a)
    by = n + F.lit(eps) if added else F.greatest(n, F.lit(eps))
    return F.transform(_c(a), lambda x: x.cast("double") / by)


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def cut(a, width: int) -> Column:
    """The first `width` components."""
    return F.slice(_c(a), 1, width)


def grid(n: int = 500) -> Column:
    """0, 1/n, .., 1"""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i / F.lit(float(n)))


def steps(lo: float, hi: float, step: float) -> Column:
    """lo, lo + step, .. below hi, rounded to 6 places."""
    n = max(0, math.ceil((hi - lo) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(lo) + i * F.lit(step), 6)) if n else F.array().cast("array<double>")


def rounded(x) -> Column:
    """To the even neighbour at halves."""
    return F.bround(_c(x), 0).cast("long")


def learning_rate(step, rate: float, warm: int, total: int) -> Column:
    """Linear warm-up, then cosine decay."""
    part = (_c(step) - warm) / F.lit(float(max(1, total - warm)))
    return F.when(_c(step) < warm, F.lit(rate) * _c(step) / F.lit(float(max(1, warm)))).otherwise(F.lit(rate / 2) * (1 + F.cos(F.lit(3.141592653589793) * part)))


def hash32(*parts) -> Column:
    """The first 8 hex digits of sha1 of the parts joined by |, as a number."""
    joined = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.sha1(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def hash52(*parts) -> Column:
    """The first 13 hex digits: exact as a double."""
    joined = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.sha1(joined.cast("binary")), 1, 13), 16, 10).cast("long")


def pick(pool, seed: int, report, path) -> Column:
    """One sentence of a pool, by hash of seed, report and path."""
    return F.when(F.size(pool) > 0, F.element_at(pool, (F.pmod(hash32(F.lit(str(seed)), report, path), F.greatest(F.size(pool), F.lit(1))) + 1).cast("int")))


def fingerprint(names) -> Column:
    """sha1 of the names joined by |: their order counts."""
    return F.sha1(F.array_join(names, "|").cast("binary"))


def tempered_weight(pos, neg, gamma: float = 1.0, alpha: float = 0.0, prior=None, eps: float = 1e-6) -> Column:
    """((1 - p) / p) ** gamma of a smoothed positive share p."""
    n = _c(pos) + _c(neg)
    p = (_c(pos) + 1) / (n + 2) if alpha <= 0 else (_c(pos) + F.lit(alpha) * prior) / F.greatest(n + F.lit(alpha), F.lit(eps))
    p = clamp(p, eps, 1 - eps)
    return F.pow((1 - p) / p, F.lit(gamma))


def plain_weight(pos, neg, most: float | None = None) -> Column:
    w = (_c(neg) + 1) / (_c(pos) + 1)
    return F.least(w, F.lit(most)) if most else w


def softplus(x) -> Column:
    """ln(1 + e^x), stable."""
    return F.greatest(_c(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(_c(x))))
