"""Surface rasters: resampling, class lookups, smoothing, slopes, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.geometry import Domain
from ..functions.numeric import neighbour
from ..sources.shared_table import materialize
from ..sources.spread import deal, tasks
from .ordered import wide_quantiles

# Land-cover class -> roughness length [m].
COVER_Z0 = {
    10: 1.00,
    20: 0.20,
    30: 0.03,
    40: 0.10,
    50: 0.50,
    60: 0.01,
    70: 0.001,
    80: 1.0e-4,
    90: 0.05,
    95: 0.20,
    100: 0.02,
}
# Land-cover class -> multiplier on the reference heat flux.
COVER_HEAT = {
    10: 1.10,
    20: 1.10,
    30: 1.10,
    40: 1.00,
    50: 1.50,
    60: 1.40,
    70: 0.30,
    80: 0.12,
    90: 0.60,
    95: 0.60,
    100: 1.00,
}
# Water code, array roughness/heat, fallbacks, array rectangle [m].
WATER_CLASS = 80
Z0_ARRAY, Z0_FALLBACK = 0.20, 0.05
HEAT_ARRAY, HEAT_FALLBACK = 1.60, 1.00
ARRAY_WEST, ARRAY_EAST, ARRAY_SOUTH, ARRAY_NORTH = -60.0, 60.0, -100.0, 250.0


# ---------------------------------------------------------------- resampling
def resample_mean(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average and population spread of fine pixels per coarse cell."""
    return pixels.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.count(F.lit(1)).alias("n_pixels")
    )


def resample_mode(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent class per coarse cell, the smallest class on a tie."""
    n = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value))


def class_histogram(cells: DataFrame, keys: Sequence[str], value: str = "lcclass") -> DataFrame:
    """Cells and share per class; ``place`` orders classes by count."""
    n = cells.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return n.select(
        *keys,
        value,
        "n",
        (100.0 * F.col("n") / F.sum("n").over(w)).alias("pct"),
        F.row_number().over(w.orderBy(F.col("n").desc(), F.col(value))).alias("place"),
    )


# ------------------------------------------------------------------- lookups
def lookup(code: Column, table: dict[int, float], fallback: float) -> Column:
    """Class-to-value lookup as one literal map, with a default for unknown codes."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code.cast("int")), F.lit(fallback))


def in_array(xc: Column, yc: Column) -> Column:
    return xc.between(ARRAY_WEST, ARRAY_EAST) & yc.between(ARRAY_SOUTH, ARRAY_NORTH)


def in_bearing_patch(xc: Column, yc: Column, bearing: float, distance: float, ew: float, ns: float) -> Column:
    """Map-aligned rectangle centred at a bearing and distance from the tower."""
    b = F.radians(F.lit(bearing))
    return (F.abs(xc - distance * F.sin(b)) <= ew / 2) & (F.abs(yc - distance * F.cos(b)) <= ns / 2)


def classify(cells: DataFrame, dom: Domain, wth: float = 0.1) -> DataFrame:
    """Roughness, heat flux and masks; the array rectangle beats the class."""
    # cell centres measured from the tower cell's centre
    arr = in_array(dom.xc(F.col("i")), dom.yc(F.col("j")))
    c = cells.withColumn("array", arr)
    return c.withColumns(
        {
            "z0m": F.when(F.col("array"), Z0_ARRAY).otherwise(lookup(F.col("lcclass"), COVER_Z0, Z0_FALLBACK)),
            "ht_flux": wth * F.when(F.col("array"), HEAT_ARRAY).otherwise(lookup(F.col("lcclass"), COVER_HEAT, HEAT_FALLBACK)),
            "water": (F.col("lcclass") == WATER_CLASS) & ~F.col("array"),
        }
    )


def water_from_spread(cells: DataFrame, keys: Sequence[str], spread_max: float = 0.02, tol: float = 1.0) -> DataFrame:
    """Water = flat inside the cell and near the median level of the flat cells."""
    flat = cells.where(F.col("spread") < spread_max)
    level = wide_quantiles(flat, keys, "mean", [0.5]).select(*keys, F.col("p50").alias("level"))
    out = cells.join(level, list(keys), "left")
    mask = (F.col("spread") < spread_max) & (F.abs(F.col("mean") - F.col("level")) < tol)
    return out.withColumn("water", F.coalesce(mask, F.lit(False)))


# ------------------------------------------------------------ taper, smoothing
def edge_ring(cells: DataFrame, dom: Domain) -> DataFrame:
    """The four edges as a bag: corner cells appear twice."""
    sides = F.filter(
        F.array(F.col("j") == 0, F.col("j") == dom.ny - 1, F.col("i") == 0, F.col("i") == dom.nx - 1), lambda s: s
    )
    return cells.withColumn("_side", F.explode(sides)).drop("_side")


def taper_terrain(cells: DataFrame, keys: Sequence[str], value: str, dom: Domain, pad: int) -> DataFrame:
    """Perturbation about the edge-ring median, faded to zero at the seam."""
    base = wide_quantiles(edge_ring(cells, dom), keys, value, [0.5]).select(*keys, F.col("p50").alias("datum"))
    wt = geo.taper(F.col("j"), dom.ny, pad) * geo.taper(F.col("i"), dom.nx, pad)
    return cells.join(base, list(keys)).withColumn("topo", (F.col(value) - F.col("datum")) * wt)


def _pass121(cells: DataFrame, keys: Sequence[str], value: str, across: str, along: str) -> DataFrame:
    w = Window.partitionBy(*keys, across).orderBy(along)
    lo, hi = neighbour(value, along, w, -1), neighbour(value, along, w, 1)
    inner = 0.25 * lo + 0.5 * F.col(value) + 0.25 * hi
    return cells.withColumn(value, F.when(lo.isNull() | hi.isNull(), F.col(value)).otherwise(inner))


def smooth121(cells: DataFrame, keys: Sequence[str], value: str, passes: int) -> DataFrame:
    """Separable 1-2-1 passes, first along j then along i; edges stay untouched.

    A window holds one raster line, never a whole raster.
    """
    for _ in range(passes):
        cells = _pass121(cells, keys, value, "i", "j")
        cells = _pass121(cells, keys, value, "j", "i")
    return cells


def _kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    import math

    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [(d, v / sum(raw)) for d, v in zip(range(-r, r + 1), raw)]


def gaussian_smooth(cells: DataFrame, keys: Sequence[str], value: str, dom: Domain, sigma: float = 1.0) -> DataFrame:
    """Separable Gaussian blur with reflected edges: scatter taps, then sum."""
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k")) for d, k in _kernel(sigma)])
    reach = F.sequence(F.lit(-1), F.lit(1))
    out = cells.select(*keys, "j", "i", F.col(value).alias("val"))
    for axis, n in (("j", dom.ny), ("i", dom.nx)):
        other = "i" if axis == "j" else "j"
        # a cell feeds target t when t + d is the cell or one of its mirror images
        images = F.flatten(
            F.transform(reach, lambda m: F.array(F.col(axis) + m * (2 * n), -F.col(axis) - 1 + m * (2 * n)))  # noqa: B023
        )
        pairs = F.flatten(
            F.transform(images, lambda g: F.transform(taps, lambda t: F.struct((g - t["d"]).alias("tgt"), t["k"].alias("k"))))
        )
        inside = F.filter(pairs, lambda p: (p["tgt"] >= 0) & (p["tgt"] < n))  # noqa: B023
        out = (
            out.select(*keys, other, "val", F.explode(inside).alias("p"))
            .groupBy(*keys, other, F.col("p.tgt").alias(axis))
            .agg(F.sum(F.col("val") * F.col("p.k")).alias("val"))
        )
    return out.select(*keys, "j", "i", F.col("val").alias(value))


# ------------------------------------------------------------------ gradients
def edge_slope(cells: DataFrame, keys: Sequence[str], value: str, dx: float) -> DataFrame:
    """|grad| with centred differences inside and one-sided differences at edges."""

    def grad(across: str, along: str) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        lo, hi, here = neighbour(value, along, w, -1), neighbour(value, along, w, 1), F.col(value)
        return F.when(lo.isNull(), (hi - here) / dx).when(hi.isNull(), (here - lo) / dx).otherwise((hi - lo) / (2 * dx))

    return cells.withColumn("gy", grad("i", "j")).withColumn("gx", grad("j", "i")).withColumn("slope", F.hypot("gx", "gy"))


def slope_quantiles(cells: DataFrame, keys: Sequence[str], dx: float, dz: float) -> DataFrame:
    """Slope percentiles and the CFL amplification at the steepest cell."""
    q = wide_quantiles(cells, keys, "slope", [0.5, 0.9, 0.99])
    m = cells.groupBy(*keys).agg(F.max("slope").alias("max_slope"))
    amp = F.sqrt(1.0 + F.pow(F.col("max_slope") * dx / dz, F.lit(2.0)))
    return q.join(m, list(keys)).select(*keys, "p50", "p90", "p99", "max_slope", amp.alias("cfl_amplification"))


def periodic_slope(cells: DataFrame, keys: Sequence[str], value: str, dom: Domain) -> DataFrame:
    """Centred periodic gradient: each cell sends its value to four neighbours."""
    half = 1.0 / (2.0 * dom.dx)
    v = F.col(value)

    def to(dj: int, di: int, gx: Column, gy: Column, own: Column) -> Column:
        return F.struct(
            F.pmod(F.col("j") + dj, F.lit(dom.ny)).alias("j"),
            F.pmod(F.col("i") + di, F.lit(dom.nx)).alias("i"),
            gx.alias("gx"),
            gy.alias("gy"),
            own.alias("own"),
        )

    zero, none = F.lit(0.0), F.lit(None).cast("double")
    sends = F.array(
        to(0, 1, -v * half, zero, none), to(0, -1, v * half, zero, none), to(1, 0, zero, -v * half, none), to(-1, 0, zero, v * half, none), to(0, 0, zero, zero, v)
    )
    return (
        cells.select(*keys, F.explode(sends).alias("s"))
        .groupBy(*keys, F.col("s.j").alias("j"), F.col("s.i").alias("i"))
        .agg(F.sum("s.gx").alias("zg_dx"), F.sum("s.gy").alias("zg_dy"), F.max("s.own").alias(value))
    )


# ------------------------------------------------------------------ transects
def ray_cells(rays: DataFrame, dom: Domain, rmax: float) -> DataFrame:
    """Cells under an upwind ray, one row per half-cell step.

    ``rays`` carries (run_id, site, wdir); the raster wraps.
    """
    step = dom.dx / 2.0
    a = F.radians("wdir")
    count = int(rmax / step) + 2
    s = rays.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(count)))).withColumn("d", F.col("n") * step)
    return s.select(
        "run_id",
        "site",
        "n",
        "d",
        F.pmod(F.rint(dom.i_r + F.col("d") * F.sin(a) / dom.dx).cast("bigint"), F.lit(dom.nx)).alias("i"),
        F.pmod(F.rint(dom.j_r + F.col("d") * F.cos(a) / dom.dx).cast("bigint"), F.lit(dom.ny)).alias("j"),
    )


def transect(rays: DataFrame, surface: DataFrame, dom: Domain, rmax: float) -> DataFrame:
    r = ray_cells(rays, dom, rmax)
    return r.join(surface, ["site", "j", "i"])


def longest_run(line: DataFrame, keys: Sequence[str], step: float, min_length: float = 130.0) -> DataFrame:
    """Longest contiguous run of every class along a transect, first one on ties.

    A window holds one transect line (a bounded number of steps).
    """
    w, wc = Window.partitionBy(*keys).orderBy("n"), Window.partitionBy(*keys, "lcclass").orderBy("n")
    isl = line.withColumn("isl", F.row_number().over(w) - F.row_number().over(wc))
    runs = isl.groupBy(*keys, "lcclass", "isl").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("cells"), F.min("d").alias("d0"))
    best = runs.groupBy(*keys, "lcclass").agg(F.min(F.struct((-F.col("cells")).alias("neg"), "first", "d0", "cells")).alias("b"))
    last = line.groupBy(*keys).agg(F.max("d").alias("d_max"))
    out = best.join(last, list(keys)).select(
        *keys,
        "lcclass",
        (F.col("b.cells") * step).alias("length"),
        (0.5 * (F.col("b.d0") + F.least(F.col("b.d0") + F.col("b.cells") * step, F.col("d_max")))).alias("label_at"),
    )
    return out.where(F.col("length") >= min_length)


# ---------------------------------------------------------------- comparisons
def box_contribution(field: DataFrame, keys: Sequence[str], boxes: Sequence[tuple], x_edge: float, y_edge: float, res: float) -> DataFrame:
    """Sum of a field over named boxes; a cell counts by its low edges."""
    x, y = x_edge + F.col("i") * res, y_edge + F.col("j") * res
    names = F.filter(
        F.array(*[F.when((x >= x0) & (x < x1) & (y >= y0) & (y < y1), F.lit(nm)) for nm, x0, x1, y0, y1 in boxes]),
        lambda n: n.isNotNull(),
    )
    return (
        field.select(*keys, "f", F.explode(names).alias("box")).groupBy(*keys, "box").agg((F.sum("f") * res * res).alias("contribution"))
    )


def raster_qa(cells: DataFrame, keys: Sequence[str], value: str, dom: Domain) -> DataFrame:
    """Range, relief, seam step in x and y, water share of the western half."""
    v, i, j = F.col(value), F.col("i"), F.col("j")
    base = cells.groupBy(*keys).agg(
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        (F.max(v) - F.min(v)).alias("relief"),
        F.avg(F.when(i < dom.i_r, F.col("water").cast("double"))).alias("water_west"),
        F.count_if(F.col("water")).alias("n_water"),
    )

    def seam(line: Column, edge: Column, n: int, name: str) -> DataFrame:
        ends = cells.where((edge == 0) | (edge == n - 1)).groupBy(*keys, line.alias("line"))
        step = ends.agg((F.sum(F.when(edge == 0, v)) - F.sum(F.when(edge == n - 1, v))).alias("s"))
        return step.groupBy(*keys).agg(F.max(F.abs("s")).alias(name))

    return base.join(seam(j, i, dom.nx, "seam_x"), list(keys)).join(seam(i, j, dom.ny, "seam_y"), list(keys))


# ------------------------------------------------------------- whole builds
def build_surface(pixels: DataFrame, dom: Domain, pad: int = 8, passes: int = 1, wth: float = 0.1) -> DataFrame:
    """Fine pixels to the model surface table (topo, z0m, ht_flux, masks).

    One pass over the pixels: the rows per cell and class yield mean elevation and commonest class, as
    :func:`resample_mean` and :func:`resample_mode` do, and are written once as cells.
    """
    key = ["site", "j", "i"]
    n = pixels.groupBy(*key, "lcclass").agg(F.count(F.lit(1)).alias("n"), F.sum("elevation").alias("s"), F.count("elevation").alias("m"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("lcclass").alias("v")))
    cells = deal(n, tasks(pixels), *key).groupBy(*key).agg(F.try_divide(F.sum("s"), F.sum("m")).alias("elevation"), best["v"].alias("lcclass"))
    cells = materialize(cells, "surface-cells")
    topo = smooth121(taper_terrain(cells, ["site"], "elevation", dom, pad), ["site"], "topo", passes)
    topo = topo.dropna(subset=key).select(*key, "elevation", "datum", "topo", "lcclass")
    return classify(topo, dom, wth)


def rotate_cells(cells: DataFrame, n: int, m: Column, vector: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Turn a square (j, i) plane and its vector columns by m quarter turns."""
    tj, ti = geo.quarter_turn_target(F.col("j"), F.col("i"), n, m)
    ru, rv = geo.quarter_turn_vector(F.col(vector[0]), F.col(vector[1]), m)
    return cells.withColumns({"_j": tj, "_i": ti, vector[0]: ru, vector[1]: rv}).drop("j", "i").withColumnsRenamed({"_j": "j", "_i": "i"})


def tiles_in_view(runs: DataFrame, dom: Domain, view: tuple[float, float, float, float], ntile: int = 1) -> DataFrame:
    """(run columns, tj, ti): the periods of the domain whose rotated tile may show in the view (x0, x1, y0, y1) of a run's footprint frame.

    ``runs`` has ``ang``, the wind's angle. A tile is kept where the bounding box of its four corners meets the view, so
    only its cells are joined; the tiles of the whole neighbourhood, (2 ntile + 1)**2 a run, are literals.
    """
    n = F.sequence(F.lit(-ntile), F.lit(ntile))
    t = runs.withColumn("tj", F.explode(n)).withColumn("ti", F.explode(n))
    ca, sa = F.cos("ang"), F.sin("ang")
    xs = [(F.col("ti") * dom.nx + c - dom.i_r) * dom.dx for c in (0, dom.nx - 1)]
    ys = [(F.col("tj") * dom.ny + c - dom.j_r) * dom.dx for c in (0, dom.ny - 1)]
    corners = [(-(x * ca + y * sa), y * ca - x * sa) for x in xs for y in ys]
    x0, x1, y0, y1 = view
    lo, hi = (lambda k: F.least(*[c[k] for c in corners])), (lambda k: F.greatest(*[c[k] for c in corners]))
    return t.where((hi(0) >= x0) & (lo(0) <= x1) & (hi(1) >= y0) & (lo(1) <= y1))


def tiled_masks(runs: DataFrame, cells: DataFrame, keys: Sequence[str], dom: Domain, view: tuple[float, float, float, float], ntile: int = 1) -> DataFrame:
    """Cells of the periodic surface in each run's footprint frame: (run columns, tj, ti, x, y) and the cell's columns.

    ``x`` points upwind and ``y`` across; only cells inside the view are returned, also those beyond the seam.
    """
    j = tiles_in_view(runs, dom, view, ntile).join(cells, list(keys))
    dx, dy = (F.col("ti") * dom.nx + F.col("i") - dom.i_r) * dom.dx, (F.col("tj") * dom.ny + F.col("j") - dom.j_r) * dom.dx
    ca, sa = F.cos("ang"), F.sin("ang")
    x0, x1, y0, y1 = view
    out = j.withColumns({"x": -(dx * ca + dy * sa), "y": dy * ca - dx * sa})
    return out.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def require_square(nx: int, ny: int) -> None:
    if nx != ny:
        raise ValueError(f"a quarter turn needs a square plane, got {ny} x {nx}")
