"""Small column builders shared by the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX = 13                       # 52 bits: exact in a double


def _digest(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_long(seed, *cols: Column) -> Column:
    """52-bit integer that depends only on the seed and the row's own values."""
    return F.conv(F.substring(_digest(seed, cols), 1, _HEX), 16, 10).cast("long")


def uniform(seed, *cols: Column) -> Column:
    """Uniform [0,1) from row values: the same for any partitioning, batch size or retry."""
    return hash_long(seed, *cols).cast("double") / F.lit(float(16 ** _HEX))


def uniform_between(lo: float, hi: float, seed, *cols: Column) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * uniform(seed, *cols)


def normal(seed, *cols: Column) -> Column:
    """Standard normal (Box-Muller) from the two halves of one row digest."""
    d = _digest(seed, cols)
    top = float(16 ** _HEX)
    u1 = (F.conv(F.substring(d, 1, _HEX), 16, 10).cast("double") + F.lit(1.0)) / F.lit(top + 1.0)
    u2 = F.conv(F.substring(d, 1 + _HEX, _HEX), 16, 10).cast("double") / F.lit(top)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce_with_logits(z: Column, y: Column) -> Column:
    """Overflow-free binary cross-entropy of one logit."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 as double (an untyped literal would make the mean a decimal)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def interp(x: Column, xs, ys) -> Column:
    """Piecewise-linear interpolation over literal knots, clamped at both ends."""
    out = F.when(x <= F.lit(float(xs[0])), F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs[:-1], xs[1:], ys[:-1], ys[1:]):
        slope = (y1 - y0) / (x1 - x0)
        out = out.when(x <= F.lit(float(x1)), F.lit(float(y0)) + F.lit(slope) * (x - F.lit(float(x0))))
    return out.otherwise(F.lit(float(ys[-1])))


def to_byte(x: Column) -> Column:
    """[0,1] to 0..255, clamped, halves rounded up."""
    return F.floor(clip(x, 0.0, 1.0) * 255.0 + 0.5).cast("int")
