"""Coordinate conventions: periodic raster, wind frame, streamline frame."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import pmod_


@dataclass(frozen=True)
class Domain:
    """A periodic north-up raster with the receptor on a cell centre."""

    nx: int = 64
    ny: int = 64
    dx: float = 24.0
    i_r: int = 32
    j_r: int = 32
    x0: float = 0.0
    y0: float = 0.0

    @property
    def length(self) -> float:
        return self.nx * self.dx

    @property
    def width(self) -> float:
        return self.ny * self.dx

    @property
    def xr(self) -> float:
        return self.x0 + self.i_r * self.dx

    @property
    def yr(self) -> float:
        return self.y0 + self.j_r * self.dx

    @property
    def area(self) -> float:
        return self.dx * self.dx

    def xc(self, i: Column) -> Column:
        return (i - self.i_r) * self.dx

    def yc(self, j: Column) -> Column:
        return (j - self.j_r) * self.dx


def frac_index(x: Column, origin: float, dx: float, n: int) -> Column:
    """Wrapped fractional cell index in [0, n)."""
    return pmod_((x - origin) / dx, float(n))


def nearest_cell(fi: Column, n: int) -> Column:
    """Nearest cell; halves go to the even cell, the seam folds back to 0."""
    return pmod_(F.rint(fi).cast("bigint"), n)


def fold_offset(fi: Column, n: int, i_r: int, dx: float) -> Column:
    """Receptor-relative coordinate after folding into the periodic raster."""
    return (pmod_(fi + 0.5, float(n)) - 0.5 - i_r) * dx


def wrapped(dx: Column, dy: Column, lx: float, ly: float) -> Column:
    """True where the fold moves a touchdown (exact, no threshold to tune)."""
    return (F.abs(dx) > 0.5 * lx) | (F.abs(dy) > 0.5 * ly)


def wind_frame(dx: Column, dy: Column, ang: Column) -> tuple[Column, Column]:
    """(upwind-positive distance, crosswind distance) of a map offset."""
    ca, sa = F.cos(ang), F.sin(ang)
    return -(dx * ca + dy * sa), dy * ca - dx * sa


def met_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows FROM, degrees clockwise from north."""
    return pmod_(F.lit(270.0) - F.degrees(F.atan2(v, u)), 360.0)


def yaw_pitch(u: Column, v: Column, w: Column) -> tuple[Column, Column]:
    return F.atan2(v, u), F.atan2(w, F.hypot(u, v))


def streamline_w(u: Column, v: Column, w: Column, yaw: Column, pitch: Column) -> Column:
    """Vertical velocity in the double-rotated (streamline) frame."""
    return w * F.cos(pitch) - (u * F.cos(yaw) + v * F.sin(yaw)) * F.sin(pitch)


def octant(wdir: Column) -> Column:
    return F.floor(pmod_(wdir + 22.5, 360.0) / 45.0)


def quarter_turn_vector(u: Column, v: Column, m: Column) -> tuple[Column, Column]:
    """(u, v) after m counter-clockwise quarter turns."""
    q = pmod_(m, 4)
    ru = F.when(q == 1, -v).when(q == 2, -u).when(q == 3, v).otherwise(u)
    rv = F.when(q == 1, u).when(q == 2, -v).when(q == 3, -u).otherwise(v)
    return ru, rv


def quarter_turn_target(j: Column, i: Column, n: int, m: Column) -> tuple[Column, Column]:
    """Where a cell (j, i) of an n x n plane lands after m quarter turns.

    One turn reads new[j, i] from old[-i mod n, j], so old (j, i) moves to
    (i, -j mod n); the four cases are closed forms of repeating that.
    """
    q = pmod_(m, 4)
    neg_j, neg_i = pmod_(-j, n), pmod_(-i, n)
    tj = F.when(q == 1, i).when(q == 2, neg_j).when(q == 3, neg_i).otherwise(j)
    ti = F.when(q == 1, neg_j).when(q == 2, neg_i).when(q == 3, j).otherwise(i)
    return tj, ti


def chord(wdir: Column, west: float, east: float, south: float, north: float) -> Column:
    """Distance along the upwind ray to the edge of a rectangle around the tower."""
    a = F.radians(wdir)

    def leg(u: Column, lo: float, hi: float) -> Column:
        far = F.when(u > 0, F.lit(hi)).otherwise(F.lit(lo))
        return F.when(F.abs(u) >= 1e-9, F.try_divide(far, u))

    return F.greatest(F.least(leg(F.sin(a), west, east), leg(F.cos(a), south, north)), F.lit(0.0))


def aligned_offset(along: Column, across: Column, wind_from: Column) -> tuple[Column, Column]:
    """Map offset of a wind-aligned grid point (along = downwind, across = left)."""
    b = F.radians(pmod_(wind_from + 180.0, 360.0))
    ex, ey = F.sin(b), F.cos(b)
    return along * ex - across * ey, along * ey + across * ex


def terrain_height(z_flat: Column, zg: Column, z_top: Column) -> Column:
    """Height of a flat-column level above terrain zg."""
    return z_flat * (z_top - zg) / z_top + zg


def terrain_level(z: Column, zg: Column, z_top: Column) -> Column:
    """Flat-column height of a physical height (inverse of terrain_height)."""
    return (z - zg) * z_top / F.greatest(z_top - zg, F.lit(1e-12))


def taper(idx: Column, n: int, pad: int) -> Column:
    """Raised-cosine edge weight, 1 in the interior."""
    if pad <= 0:
        return F.lit(1.0)
    edge = F.least(idx, F.lit(n - 1) - idx)
    ramp = 0.5 * (1.0 - F.cos(F.lit(math.pi) * (edge + 0.5) / pad))
    return F.when(edge < pad, ramp).otherwise(1.0)


def level_gradient(f, fm, fp, z, zm, zp) -> Column:
    """Second-order gradient on uneven levels, one-sided at either end."""
    hs, hd = z - zm, zp - z
    inner = (hs * hs * fp + (hd * hd - hs * hs) * f - hd * hd * fm) / (hs * hd * (hs + hd))
    return F.when(zm.isNull(), F.try_divide(fp - f, hd)).when(zp.isNull(), F.try_divide(f - fm, hs)).otherwise(inner)


