"""Surface-layer and convective-layer relations as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kljun import KAPPA, psi_from_ratio
from .numeric import clip, isfinite

GRAVITY = 9.81
R_DRY = 287.05
CP_DRY = 1004.5
# Neutral surface-layer variance ratios sigma^2/u*^2 of u, v, w
# (2.5^2, 1.9^2, 1.25^2), normalised below so the three sum to 3.
SURFACE_RATIOS = (6.25, 3.61, 1.5625)


def anisotropy() -> tuple[float, float, float]:
    total = sum(SURFACE_RATIOS)
    return tuple(3.0 * r / total for r in SURFACE_RATIOS)


def check_anisotropy(split) -> tuple[float, float, float]:
    if abs(sum(split) - 3.0) > 1e-6:
        raise ValueError(f"variance split must sum to 3, got {sum(split)}")
    return tuple(split)


def sensible_flux(acc: Column) -> Column:
    """Accumulated kJ m-2 h-1 to W m-2."""
    return acc * 1000.0 / 3600.0


def kinematic_flux(h: Column, psfc: Column, tk: Column) -> Column:
    rho = psfc / (R_DRY * tk)
    return h / (rho * CP_DRY)


def obukhov(ustar: Column, theta: Column, wth: Column, floor: float = 1e-6) -> Column:
    """Obukhov length; +inf when the flux is negligible."""
    return F.when(F.abs(wth) > floor, F.try_divide(-F.pow(ustar, 3) * theta, KAPPA * GRAVITY * wth)).otherwise(
        F.lit(float("inf"))
    )


def with_ustar(df: DataFrame, u10: str, wth: str, theta: str, z0: float = 0.05, rounds: int = 12) -> DataFrame:
    """Add us and L: joint friction velocity and Obukhov length.

    The fixed point is written as one select whose columns refer to earlier
    ones, so every round is a generated projection evaluated once per row. The
    one-element inline at the end keeps later filters and expressions on us and
    L from being pushed down into copies of the whole chain.
    """
    k, ln10 = repr(KAPPA) + "D", repr(math.log(10.0 / z0)) + "D"
    cols = [f"{k} * {u10} / {ln10} AS _us0"]
    for n in range(1, rounds + 1):
        c, zl = f"_chi{n}", f"_zl{n}"
        unstable = f"ln((1D + {c} * {c}) / 2D) + 2D * ln((1D + {c}) / 2D) - 2D * atan({c}) + {math.pi / 2!r}D"
        psi = f"CASE WHEN {zl} > 0 THEN -5.3D * {zl} WHEN {zl} < 0 THEN {unstable} ELSE 0D END"
        length = f"try_divide(-power(greatest(_us{n - 1}, 1e-3D), 3D) * {theta}, {k} * {GRAVITY!r}D * {wth})"
        cols += [
            f"coalesce(CASE WHEN abs({wth}) > 1e-6D THEN {length} END, 1e9D) AS _ln{n}",
            f"least(greatest(10D / _ln{n}, -2D), 1D) AS {zl}",
            f"power(greatest(1D - 19D * {zl}, 0D), 0.25D) AS {c}",
            f"{k} * {u10} / greatest({ln10} - ({psi}), 0.5D) AS _us{n}",
        ]
    out = df.selectExpr("*", *cols)
    return out.selectExpr(*df.columns, f"inline(array(struct(_us{rounds} AS us, _ln{rounds} AS L)))")


def profile_wind(us: Column, L: Column, zm: float = 30.0, z0: float = 0.05) -> Column:
    zl = clip(F.coalesce(F.try_divide(F.lit(zm), L), F.lit(0.0)), -2.0, 1.0)
    return us / KAPPA * F.greatest(math.log(zm / z0) - psi_from_ratio(zl), F.lit(0.5))


# Class upper bounds (inclusive) on z/L and their names.
STABILITY_CLASSES = (
    (-0.5, "very unstable"),
    (-0.05, "unstable"),
    (0.05, "near-neutral"),
    (0.5, "stable"),
)
LAST_CLASS = "very stable"


def stability_class(zl: Column) -> Column:
    expr = F
    for bound, name in STABILITY_CLASSES:
        expr = expr.when(zl <= bound, name)
    return F.when(isfinite(zl), expr.otherwise(LAST_CLASS))


def convective_velocity(theta: Column, wth: Column, zi: Column, floor: float = 1e-9) -> Column:
    return F.cbrt(GRAVITY / theta * F.greatest(wth, F.lit(floor)) * zi)


def lenschow(zeta: Column) -> Column:
    """sigma_w / w* in the mixed layer."""
    return 1.34 * F.cbrt(F.greatest(zeta, F.lit(1e-6))) * F.greatest(1.0 - 0.8 * zeta, F.lit(0.0))


def dissipation(e: Column, theta: Column, dthdz: Column, delta: Column) -> Column:
    """Sub-grid dissipation with a stability-limited length scale."""
    n2 = GRAVITY / theta * dthdz
    root_e = F.sqrt(F.greatest(e, F.lit(0.0)))
    buoyancy = 0.76 * root_e / F.sqrt(F.greatest(n2, F.lit(1e-12)))
    stable = F.greatest(F.least(buoyancy, delta), F.lit(1e-2))
    length = F.when(n2 > 0, stable).otherwise(delta)
    return 0.93 * F.pow(root_e, 3) / F.greatest(length, F.lit(1e-2))


def height_over_length(z: Column, L: Column) -> Column:
    """z/L; 0 where the length is undefined, that is in neutral air."""
    return F.coalesce(F.when(isfinite(L) & (F.abs(L) > 1e-6), F.try_divide(z, L)), F.lit(0.0))


def phi_w(zeta: Column) -> Column:
    """sigma_w / u* over its neutral value: a cube root in unstable air, a slow linear rise up to zeta = 2 in stable air."""
    unstable = F.cbrt(1.0 - 3.0 * F.least(zeta, F.lit(0.0)))
    stable = 1.0 + 0.2 * clip(zeta, 0.0, 2.0)
    return F.when(zeta < 0, unstable).otherwise(stable)


def sigma_w_surface(z: Column, h: Column, L: Column, ustar: Column) -> Column:
    """Vertical fluctuation of the surface layer, falling to nothing at the top h."""
    depth = F.greatest(1.0 - z / F.greatest(h, F.lit(1.0)), F.lit(0.0))
    return 1.25 * ustar * phi_w(height_over_length(z, L)) * F.sqrt(depth) * F.sqrt(F.sqrt(depth))


def sigma_w_mixed(z: Column, h: Column, wth: Column, theta: Column) -> Column:
    """Vertical fluctuation of a convective mixed layer of depth h; 0 without a heat flux from below."""
    depth = F.greatest(h, F.lit(1.0))
    return convective_velocity(theta, wth, depth, floor=0.0) * lenschow(clip(z / depth, 1e-4, 1.5))


def sigma_w_target(z: Column, h: Column, L: Column, ustar: Column, wth: Column, theta: Column, mode: Column) -> Column:
    """What ``mode`` asks for: "surface", "mixed" or the lesser of both. Without convection only the surface layer counts."""
    surface, mixed = sigma_w_surface(z, h, L, ustar), sigma_w_mixed(z, h, wth, theta)
    asked = F.coalesce(F.element_at(F.create_map(F.lit("surface"), surface, F.lit("mixed"), mixed), mode), F.least(surface, mixed))
    return F.when(wth > 0, asked).otherwise(surface)


def near_ground(z: Column, h: Column) -> Column:
    """1 up to a tenth of the layer's depth, 0 from a fifth on, linear between."""
    return 1.0 - clip(z / (0.1 * h) - 1.0, 0.0, 1.0)


def subgrid_multiplier(target: Column, resolved: Column, e: Column, weight: Column) -> Column:
    """By how much the sub-grid variance 2/3 e is to be raised to fill the target's variance beside the resolved one; never lowered."""
    share = F.greatest(target * target - resolved, F.lit(0.0)) / F.greatest(e * 2.0 / 3.0, F.lit(1e-9))
    return F.lit(1.0) + weight * (F.greatest(share, F.lit(1.0)) - 1.0)
