"""Small numeric Column builders shared by every operator (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INF = float("inf")


def isfinite(c: Column) -> Column:
    """True for ordinary numbers; NaN, +-inf and NULL are all non-finite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def clip(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def pmod_(c: Column, n) -> Column:
    """Non-negative modulo."""
    return F.pmod(c, n if isinstance(n, Column) else F.lit(n))


def ratio(a: Column, b: Column) -> Column:
    """a/b with NULL for a zero denominator (ANSI mode raises otherwise)."""
    return F.try_divide(a, b)


# Abramowitz & Stegun 7.1.26 rational approximation of erf.
ERF_P = 0.3275911
ERF_COEFFS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function, |error| <= 1.5e-7 (Spark has no built-in erf)."""
    t = 1.0 / (1.0 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFS):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def half_precision(x: Column) -> Column:
    """Round to the nearest IEEE half-precision number, kept in a double column."""
    mag = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.greatest(mag, F.lit(2.0**-30)))).cast("double"), F.lit(-14.0))
    ulp = F.pow(F.lit(2.0), exponent - 10.0)
    q = F.rint(x / ulp) * ulp
    return F.when(F.abs(q) > 65504.0, F.signum(x) * F.lit(INF)).otherwise(q)


def pack16(x: Column, scale: Column, offset: Column) -> Column:
    """CF-style 16-bit packing."""
    return F.rint(F.coalesce(F.try_divide(x - offset, scale), F.lit(0.0))).cast("smallint")


def unpack16(p: Column, scale: Column, offset: Column) -> Column:
    return p.cast("double") * scale + offset


def interp_levels(x: Column, xs: Column, fs: Column) -> Column:
    """Piecewise-linear table lookup with clamped ends.

    ``xs`` (ascending) and ``fs`` are array columns holding one short level table.
    """
    n = F.size(xs)
    hit = F.size(F.filter(xs, lambda v: v <= x))
    lo = F.least(F.greatest(hit, F.lit(1)), n - 1)
    x0, x1 = F.get(xs, lo - 1), F.get(xs, lo)
    f0, f1 = F.get(fs, lo - 1), F.get(fs, lo)
    t = clip(F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)), 0.0, 1.0)
    return F.when(n == 1, F.get(fs, F.lit(0))).otherwise(f0 + (f1 - f0) * t)


def neighbour(value: Column | str, along: str, w: WindowSpec, step: int) -> Column:
    """The value at index ``along`` + ``step`` (1 or -1) of a window ordered by
    ``along``; NULL where that index is absent, whatever row comes next."""
    at = F.lead if step > 0 else F.lag
    return F.when(at(along).over(w) == F.col(along) + step, at(value).over(w))
