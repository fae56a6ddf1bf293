"""Closed-form flux-footprint parameterisation (Kljun et al. 2015) as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import erf, isfinite

KAPPA = 0.4
# Published fit constants of the parameterisation.
A, B, C, D = 1.4524, -1.9914, 1.4622, 0.1359
AC, BC, CC = 2.17, 1.66, 20.0
XSTAR_MAX = -C / B + D


def psi_from_ratio(zl: Column) -> Column:
    """Integrated stability correction as a function of z/L."""
    chi = F.pow(F.greatest(1.0 - 19.0 * zl, F.lit(0.0)), F.lit(0.25))
    unstable = F.ln((1.0 + chi * chi) / 2.0) + 2.0 * F.ln((1.0 + chi) / 2.0) - 2.0 * F.atan(chi) + math.pi / 2.0
    return F.when(zl > 0, -5.3 * zl).when(zl < 0, unstable).otherwise(0.0)


def near_neutral(L: Column) -> Column:
    return ~isfinite(L) | (F.abs(L) > 1e5)


def psi_m(zm: Column, L: Column) -> Column:
    return F.when(near_neutral(L), 0.0).otherwise(psi_from_ratio(F.coalesce(F.try_divide(zm, L), F.lit(0.0))))


def pi4(zm: Column, ustar: Column, umean: Column | None, z0: Column | None = None, L: Column | None = None) -> Column:
    """Measured wind ratio where known, else the similarity profile."""
    parts = []
    if umean is not None:
        parts.append(umean / ustar * KAPPA)
    if z0 is not None:
        parts.append(F.ln(zm / z0) - psi_m(zm, L))
    return F.coalesce(*parts)


def x_scale(zm: Column, h: Column, p4: Column) -> Column:
    return zm / (1.0 - zm / h) * p4


def crosswind_integrated(x: Column, scale: Column) -> Column:
    """f_y(x) [1/m]."""
    s = x / scale - D
    safe = F.when(s > 0, s)
    return F.coalesce(A * F.pow(safe, F.lit(B)) * F.exp(-C / safe), F.lit(0.0)) / scale


def stability_factor(zm: Column, L: Column) -> Column:
    p = F.when(L <= 0, 0.8).otherwise(0.55)
    mixed = F.least(F.lit(1.0), F.try_divide(F.lit(1e-5), F.abs(zm / F.when(L != 0, L))) + p)
    return F.when(near_neutral(L), 0.8).otherwise(mixed)


def sigma_y(x: Column, scale: Column, zm: Column, ustar: Column, sigma_v: Column, L: Column) -> Column:
    """Crosswind spread [m] at upwind distance x."""
    s = F.greatest(x / scale, F.lit(0.0))
    star = AC * F.sqrt(BC * s * s / (1.0 + CC * s))
    return star * zm * sigma_v / (ustar * stability_factor(zm, L))


def gaussian_2d(fy: Column, sy: Column, y: Column) -> Column:
    s = F.greatest(sy, F.lit(1e-6))
    return fy * F.exp(-y * y / (2.0 * s * s)) / (math.sqrt(2.0 * math.pi) * s)


def cell_integrated_2d(fy: Column, sy: Column, y_lo: Column, y_hi: Column) -> Column:
    """Crosswind Gaussian averaged over [y_lo, y_hi] instead of sampled."""
    s = math.sqrt(2.0) * F.greatest(sy, F.lit(1e-6))
    return fy * 0.5 * (erf(y_hi / s) - erf(y_lo / s)) / (y_hi - y_lo)


def peak_distance(scale: Column) -> Column:
    return XSTAR_MAX * scale


def implied_roughness(zm: Column, p4: Column) -> Column:
    return zm * F.exp(-p4)


def normalisation() -> float:
    """Integral of the scaled curve; 1 when the constants are consistent."""
    return A * C ** (B + 1.0) * math.gamma(-B - 1.0)
