"""Multi-linear interpolation as a corner join.

A point becomes one row per surrounding grid corner with its weight; the
corners meet the grid in an ordinary equi-join and the weighted values are
summed back per point. All fields share the one join. Periodic axes use a
modulo in the key, so no padded copies of the grid exist.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import interp_levels, isfinite


@dataclass(frozen=True)
class Axis:
    """One grid axis: fractional coordinate column, index column, size, edge rule.

    ``edge`` is "clamp" (hold the end value), "wrap" (periodic), "extrapolate"
    (keep the end cell's slope) or "open" (indices as they come, also outside).
    ``size`` may name a column.
    """

    coord: str
    index: str
    size: int | str
    edge: str = "clamp"

    def corners(self) -> list[tuple[Column, Column]]:
        n = F.col(self.size) if isinstance(self.size, str) else F.lit(self.size)
        c = F.col(self.coord)
        if self.edge in ("wrap", "open"):
            base = F.floor(c)
            at = (lambda k: F.pmod(k, n)) if self.edge == "wrap" else (lambda k: k)
            return [(at(base), 1.0 - (c - base)), (at(base + 1), c - base)]
        if self.edge == "clamp":
            c = F.least(F.greatest(c, F.lit(0.0)), (n - 1).cast("double"))
        base = F.least(F.greatest(F.floor(c), F.lit(0)), F.greatest(n - 2, F.lit(0)))
        return [(base, 1.0 - (c - base)), (F.least(base + 1, n - 1), c - base)]


def cell_corners(j: Axis, i: Axis) -> list[tuple[Column, Column, Column]]:
    """(j, i, weight) of the four cells around a point of the plane."""
    return [(jj, ii, wj * wi) for jj, wj in j.corners() for ii, wi in i.corners()]


def corner_rows(points: DataFrame, keys: Sequence[str], pid: str, axes: Sequence[Axis]) -> DataFrame:
    """One row per (point, corner) with a non-zero weight.

    Axes are split one after the other, two small structs at a time: a point on
    a grid plane never fans out along that axis, and each generated method
    stays small enough for the JIT.
    """
    later = dict.fromkeys(c for a in axes for c in (a.coord, a.size) if isinstance(c, str))
    out = points.select(*keys, pid, *later, F.lit(1.0).alias("_w"))
    done: list[str] = []
    for n, a in enumerate(axes):
        pair = F.array(*[F.struct(i.cast("bigint").alias("i"), w.alias("w")) for i, w in a.corners()])
        rest = dict.fromkeys(c for x in axes[n + 1 :] for c in (x.coord, x.size) if isinstance(c, str))
        out = out.select(*keys, pid, *done, *rest, "_w", F.explode(pair).alias("_c")).where(F.col("_c.w") != 0.0)
        done.append(a.index)
        out = out.select(*keys, pid, *done[:-1], F.col("_c.i").alias(a.index), *rest, (F.col("_w") * F.col("_c.w")).alias("_w"))
    return out


def interpolate(
    points: DataFrame, grid: DataFrame, keys: Sequence[str], pid: str, axes: Sequence[Axis], values: Sequence[str]
) -> DataFrame:
    """Sample ``values`` of ``grid`` at the points; NULL where a corner is missing.

    Every point comes back, also one that lies wholly outside the grid.
    """
    on = [*keys, *[a.index for a in axes]]
    hit = corner_rows(points, keys, pid, axes).join(grid.select(*on, *values, F.lit(1).alias("_hit")), on, "left")
    sums = [F.sum(F.col(v) * F.col("_w")).alias(v) for v in values]
    out = hit.groupBy(*keys, pid).agg(*sums, F.coalesce(F.sum(F.col("_w") * F.col("_hit")), F.lit(0.0)).alias("_w"))
    whole = F.col("_w") > 1.0 - 1e-9
    return out.select(*keys, pid, *[F.when(whole, F.col(v)).alias(v) for v in values])


def pack_planes(cells: DataFrame, keys: Sequence[str], nx: int, values: Sequence[str]) -> DataFrame:
    """One row per (keys, k) plane with row-major value arrays.

    ``at`` has the places of the cells that exist, in order. A plane is bounded by the grid (ny * nx floats), so
    collecting it is safe; stored this way a dump is read back in a few thousand rows.
    """
    row = F.struct((F.col("j") * nx + F.col("i")).alias("at"), *values)
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_p"))
    return packed.select(
        *keys, F.col("_p.at").alias("at"), *[F.col(f"_p.{v}").alias(v) for v in values]
    )


def interpolate_planes(
    points: DataFrame,
    planes: DataFrame,
    keys: Sequence[str],
    pid: str,
    outer: Sequence[Axis],
    j: Axis,
    i: Axis,
    nx: int,
    ny: int,
    values: Sequence[str],
    prune: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Same answer as :func:`interpolate` on packed planes: only the outer axes
    are exploded and joined, the four horizontal corners are array look-ups.

    ``prune(planes, wanted)`` may leave out planes that no row of ``wanted``
    (keys and outer indices) needs. In a plane with holes a corner is searched
    for among the places that exist.
    """
    flat = points.select(
        *keys,
        pid,
        *[a.coord for a in outer],
        *[a.size for a in outer if isinstance(a.size, str)],
        F.array(*[F.struct((jj * nx + ii).cast("int").alias("at"), w.alias("w")) for jj, ii, w in cell_corners(j, i)]).alias("_h"),
    )
    c = corner_rows(flat, [*keys, "_h"], pid, outer)
    on = [*keys, *[a.index for a in outer]]
    if prune is not None:
        planes = prune(planes, corner_rows(flat, keys, pid, outer))
    # stored planes lie by their key: the points come to them
    hit = c.join(planes.select(*on, "at", *values).hint("merge"), on, "left")
    whole, zero = F.size("at") == nx * ny, F.lit(0.0)
    corners = range(4)
    for n in corners:
        at, w = F.col("_h")[n]["at"], F.col("_h")[n]["w"]
        place = F.when(whole, at).otherwise((F.array_position("at", at.cast("bigint")) - 1).cast("int"))
        # a corner without weight may be missing
        hit = hit.withColumn(f"_a{n}", F.when(w != 0.0, place)).withColumn(f"_w{n}", F.when(F.col(f"_a{n}") >= 0, w).otherwise(zero))
    share = lambda v, n: F.when(F.col(f"_w{n}") != 0.0, F.col(f"_w{n}") * F.get(F.col(v), F.col(f"_a{n}"))).otherwise(zero)
    added = lambda terms: reduce(lambda x, y: x + y, terms)
    vals = [F.sum(F.col("_w") * added([share(v, n) for n in corners])).alias(v) for v in values]
    weight = F.col("_w") * added([F.col(f"_w{n}") for n in corners])
    out = hit.groupBy(*keys, pid).agg(*vals, F.coalesce(F.sum(weight), zero).alias("_w"))
    return out.select(*keys, pid, *[F.when(F.col("_w") > 1.0 - 1e-9, F.col(v)).alias(v) for v in values])


def level_arrays(levels: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Level tables as sorted arrays, one row per key (a column has a few hundred levels)."""
    packed = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[v for v in values if v != order]))).alias("_l"))
    return packed.select(*keys, *[F.col(f"_l.{v}").alias(f"{v}_arr") for v in dict.fromkeys([order, *values])])


def at_height(points: DataFrame, arrays: DataFrame, keys: Sequence[str], z: str, xs: str, fs: Sequence[str]) -> DataFrame:
    """Clamped 1-D interpolation of several level arrays at column ``z``."""
    j = points.join(arrays, list(keys))
    out = j.withColumns({f"{f}_at": interp_levels(F.col(z), F.col(xs), F.col(f)) for f in fs})
    return out.drop(*[c for c in arrays.columns if c not in keys])
