"""Touchdown events to flux-footprint maps and their metrics.

Every operator takes and returns DataFrames keyed by ``run_id`` (plus any extra
grouping keys). Sums are plain grouped aggregates, so Spark combines them
map-side and one run holding most rows costs no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.geometry import Domain
from ..sources.spread import deal, joined, tasks
from .interp import Axis, cell_corners
from .ordered import mass_threshold, top_sum, with_threshold

MARKS = (300.0, 450.0, 600.0, 750.0)
DISP_FRACTIONS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
#: Neighbouring particles of a run whose touchdowns are summed in one task.
BLOCK = 1 << 16


# ------------------------------------------------------------------ weighting
def release_frames(releases: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per-run means, double-rotation angles, release count and mid time."""
    m = releases.groupBy(*keys).agg(
        F.avg("rel_u").alias("u_bar"),
        F.avg("rel_v").alias("v_bar"),
        F.avg("rel_w").alias("w_bar"),
        F.count(F.lit(1)).alias("n_particles"),
        F.min("t_release").alias("t_first"),
        F.max("t_release").alias("t_last"),
    )
    yaw, pitch = geo.yaw_pitch(F.col("u_bar"), F.col("v_bar"), F.col("w_bar"))
    return m.withColumn("yaw", yaw).withColumn("pitch", pitch).withColumn("t_mid", (F.col("t_first") + F.col("t_last")) / 2.0)


def framed_releases(releases: DataFrame, frames: DataFrame) -> DataFrame:
    """Releases with streamline-frame w, wind angle and window half."""
    f = frames.select("run_id", "yaw", "pitch", "t_mid")
    wsf = geo.streamline_w(F.col("rel_u"), F.col("rel_v"), F.col("rel_w"), F.col("yaw"), F.col("pitch"))
    return releases.join(f, "run_id").select(
        "run_id",
        "particle",
        "t_release",
        "yaw",
        wsf.alias("w_release"),
        F.when(F.col("t_release") <= F.col("t_mid"), 1).otherwise(2).alias("half"),
    )


def contact_weight(td_w: Column, w_floor: float | Column = 0.02) -> Column:
    """Residence-time weight of one touchdown."""
    return 2.0 / F.greatest(td_w, w_floor if isinstance(w_floor, Column) else F.lit(w_floor))


def weigh(touchdowns: DataFrame, framed: DataFrame, dom: Domain, w_floor: float = 0.02) -> DataFrame:
    """Join each touchdown to its release; add signed weights and coordinates."""
    t = joined(touchdowns, framed, ["run_id", "particle"], tasks(touchdowns, framed))
    dx, dy = F.col("td_x") - dom.xr, F.col("td_y") - dom.yr
    up, cross = geo.wind_frame(dx, dy, F.col("yaw"))
    t = t.select(
        "*",
        contact_weight(F.col("td_w"), w_floor).alias("wt_c"),
        geo.frac_index(F.col("td_x"), dom.x0, dom.dx, dom.nx).alias("fi"),
        geo.frac_index(F.col("td_y"), dom.y0, dom.dx, dom.ny).alias("fj"),
        up.alias("x_up"),
        cross.alias("y_cross"),
        F.hypot(dx, dy).alias("disp"),
        geo.wrapped(dx, dy, dom.length, dom.width).alias("wrapped"),
    )
    return t.select(
        "*",
        (F.col("w_release") * F.col("wt_c")).alias("wt_f"),
        geo.nearest_cell(F.col("fj"), dom.ny).alias("jj"),
        geo.nearest_cell(F.col("fi"), dom.nx).alias("ii"),
        geo.fold_offset(F.col("fi"), dom.nx, dom.i_r, dom.dx).alias("xm"),
        geo.fold_offset(F.col("fj"), dom.ny, dom.j_r, dom.dx).alias("ym"),
    )


def _near(w: DataFrame) -> tuple[list[Column], list[str]]:
    """The block of a run that a touchdown belongs to, and the columns that lay blocks together; none for rows without particles.

    Touchdowns of a run share cells, bins and marks, so they are summed where its block lies before anything else moves;
    a run of many particles has many blocks.
    """
    if not {"run_id", "particle"} <= set(w.columns):
        return [], []
    return [F.floor(F.col("particle") / BLOCK).alias("_block")], ["run_id", "_block"]


# ----------------------------------------------------------------- deposition
def deposit_cic(
    w: DataFrame,
    keys: Sequence[str],
    x: Column,
    y: Column,
    x_edge: float,
    y_edge: float,
    res: float,
    nx: int,
    ny: int,
    periodic: bool = True,
) -> DataFrame:
    """Share each touchdown bilinearly between its four nearest cells."""
    values = {"flux": F.col("wt_f"), "conc": F.col("wt_c")}
    return deposit_values(w, keys, values, x, y, x_edge, y_edge, res, nx, ny, periodic)


def deposit_values(
    w: DataFrame, keys: Sequence[str], values: dict[str, Column], x: Column, y: Column, x_edge: float, y_edge: float, res: float, nx: int, ny: int, periodic: bool = True
) -> DataFrame:
    """(keys, j, i, values): each value shared bilinearly between the four cells nearest to its row.

    Rows collapse in the block of their run by the first of their four cells, to four sums a value, which are dealt out
    to the neighbours there; only the block's cells, one sum a value and bounded by the grid, move to the task of their key.
    """
    edge = "wrap" if periodic else "open"
    n_tasks, (block, near) = tasks(w), _near(w)
    run = [c for c in near[:1] if c not in keys]
    at = w.select(*run, *block, *keys, *[c.alias(f"_{n}") for n, c in values.items()], ((x - x_edge) / res - 0.5).alias("_u"), ((y - y_edge) / res - 0.5).alias("_v"))
    if near:
        at = deal(at, n_tasks, *near)
    around = cell_corners(Axis("_v", "j", ny, edge), Axis("_u", "i", nx, edge))
    first = at.select("*", around[0][0].alias("_j"), around[0][1].alias("_i"), *[part.alias(f"_p{k}") for k, (_, _, part) in enumerate(around)])
    if not periodic:
        first = first.where(F.col("_j").between(-1, ny - 1) & F.col("_i").between(-1, nx - 1))
    sums = [F.sum(F.col(f"_{n}") * F.col(f"_p{k}")).alias(f"_{n}{k}") for n in values for k in range(4)]
    group = list(dict.fromkeys([*near, *keys]))
    base = first.groupBy(*group, "_j", "_i").agg(*sums)
    if not near:
        base = deal(base, n_tasks, *keys)
    cells = base.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    j, i = _neighbour("_j", F.col("_k") >= 2, ny, periodic), _neighbour("_i", F.col("_k") % 2 == 1, nx, periodic)
    cells = cells.select(*group, j.alias("j"), i.alias("i"), *[_nth(f"_{n}", "_k").alias(f"_{n}") for n in values])
    if not periodic:
        cells = cells.where(F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1))
    if near:
        cells = deal(cells.groupBy(*group, "j", "i").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values]), n_tasks, *keys)
    return cells.groupBy(*keys, "j", "i").agg(*[F.sum(f"_{n}").alias(n) for n in values])


def _neighbour(index: str, up: Column, size: int, periodic: bool) -> Column:
    """The index itself or, where ``up``, the next one."""
    after = F.col(index) + 1
    return F.when(up, F.pmod(after, F.lit(size)) if periodic else after).otherwise(F.col(index))


def _nth(name: str, corner: str) -> Column:
    """The sum of one of the four cells."""
    return F.when(F.col(corner) == 0, F.col(f"{name}0")).when(F.col(corner) == 1, F.col(f"{name}1")).when(F.col(corner) == 2, F.col(f"{name}2")).otherwise(F.col(f"{name}3"))


def deposit_static(w: DataFrame, dom: Domain, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Cloud-in-cell on the north-up raster whose cells are the model columns."""
    return deposit_cic(
        w,
        keys,
        F.col("xm"),
        F.col("ym"),
        (-0.5 - dom.i_r) * dom.dx,
        (-0.5 - dom.j_r) * dom.dx,
        dom.dx,
        dom.nx,
        dom.ny,
    )


def deposit_nearest(
    w: DataFrame, keys: Sequence[str], x: Column, y: Column, x_edge: float, y_edge: float, res: float, nx: int, ny: int
) -> DataFrame:
    """Plain 2-D histogram; the last bin of each axis is closed, outside is dropped."""

    def bin_of(c: Column, lo: float, n: int) -> Column:
        b = F.floor((c - lo) / res)
        return F.when(c == lo + n * res, F.lit(n - 1).cast("bigint")).otherwise(b)

    b = w.select(*keys, "wt_f", "wt_c", bin_of(y, y_edge, ny).alias("j"), bin_of(x, x_edge, nx).alias("i"))
    return (
        b.where(F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1))
        .groupBy(*keys, "j", "i")
        .agg(F.sum("wt_f").alias("flux"), F.sum("wt_c").alias("conc"))
    )


def density(cells: DataFrame, totals: DataFrame, keys: Sequence[str], area: float, which: str = "flux") -> DataFrame:
    """Footprint density [1/m2]; n counts every release, also without touchdown."""
    n = F.greatest(F.col("n_particles"), F.lit(1))
    return cells.join(totals.select(*keys, "n_particles"), list(keys)).select(
        *keys, "j", "i", (F.col(which) / n / area).alias("f")
    )


# -------------------------------------------------------------- 1-D histogram
def fy_histogram(w: DataFrame, spine: DataFrame, keys: Sequence[str], dom: Domain) -> DataFrame:
    """Crosswind-integrated footprint over dense upwind bins.

    ``spine`` holds the keys with ``n_particles``; empty bins come out as zero.
    """
    nfy = dom.nx
    top = (nfy + 0.5) * dom.dx
    b = F.when(F.col("x_up") == top, F.lit(2 * nfy - 1).cast("bigint")).otherwise(F.floor(F.col("x_up") / dom.dx - 0.5) + nfy)
    sums = (
        w.select(*keys, "wt_f", b.alias("bin"))
        .where(F.col("bin").between(0, 2 * nfy - 1))
        .groupBy(*keys, "bin")
        .agg(F.sum("wt_f").alias("s"))
    )
    return dense_fy(sums, spine, keys, dom)


def dense_fy(sums: DataFrame, spine: DataFrame, keys: Sequence[str], dom: Domain) -> DataFrame:
    """Fill missing bins with zero and scale sums to a density per metre."""
    nfy = dom.nx
    bins = spine.select(*keys, "n_particles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2 * nfy - 1).cast("bigint"))).alias("bin"))
    return bins.join(sums, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        ((F.col("bin") - nfy + 1) * dom.dx).alias("xc"),
        (F.coalesce("s", F.lit(0.0)) / F.greatest("n_particles", F.lit(1)) / dom.dx).alias("f"),
    )


def fy_smooth(fy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """5-bin moving mean, zero-padded (a key has 2*nx bins at most)."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-2, 2)
    return fy.withColumn("sm", F.sum("f").over(w) / 5.0)


def fy_metrics(fy: DataFrame, keys: Sequence[str], res: float) -> DataFrame:
    """Peak of the smoothed curve, mean distance, 80% distance, integral."""
    w = Window.partitionBy(*keys).orderBy("bin")
    s = fy_smooth(fy, keys).withColumn("pos", F.greatest("f", F.lit(0.0)))
    s = s.withColumn(
        "c", F.try_divide(F.sum("pos").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("pos").over(Window.partitionBy(*keys)))
    )
    s = s.withColumn("c1", F.lead("c").over(w)).withColumn("x1", F.lead("xc").over(w))
    crossing = (F.col("c") <= 0.8) & (F.col("c1") > 0.8)
    at = F.col("xc") + (F.col("x1") - F.col("xc")) * F.try_divide(F.lit(0.8) - F.col("c"), F.col("c1") - F.col("c"))
    g = s.groupBy(*keys).agg(
        F.min(F.struct((-F.col("sm")).alias("s"), "bin", "xc"))["xc"].alias("peak_x"),
        F.try_divide(F.sum(F.col("pos") * F.col("xc")), F.sum("pos")).alias("mean_x"),
        F.coalesce(F.max(F.when(crossing, at)), F.min("xc")).alias("x80"),
        F.sum("f").alias("sf"),
    )
    ok = F.col("sf") > 0
    return g.select(
        *keys,
        F.when(ok, F.col("peak_x")).alias("peak_x"),
        F.when(ok, F.col("mean_x")).alias("mean_x"),
        F.when(ok, F.col("x80")).alias("x80"),
        F.when(ok, F.col("sf") * res).otherwise(0.0).alias("integral"),
    )


# ------------------------------------------------------- one-pass partial sums
def capture_curve(w: DataFrame, totals: DataFrame, dom: Domain, marks: Sequence[float] = MARKS, t_back: float = 900.0) -> DataFrame:
    """The estimator truncated at shorter backward times, with curve metrics."""
    all_marks = F.array(*[F.lit(float(m)) for m in (*marks, t_back)])
    m = w.select("run_id", "wt_f", "x_up", "td_age", F.explode(all_marks).alias("mark")).where(F.col("td_age") <= F.col("mark"))
    spine = totals.select("run_id", "n_particles", F.explode(all_marks).alias("mark"))
    keys = ["run_id", "mark"]
    shape = fy_metrics(fy_histogram(m, spine, keys, dom), keys, dom.dx).drop("integral", "mean_x")
    integ = m.groupBy(*keys).agg(F.sum("wt_f").alias("s"))
    out = (
        spine.join(integ, keys, "left")
        .withColumn("integral", F.coalesce("s", F.lit(0.0)) / F.col("n_particles"))
        .withColumn("full", F.max(F.when(F.col("mark") == t_back, F.col("integral"))).over(Window.partitionBy("run_id")))
    )
    return out.join(shape, keys).select(
        *keys, "integral", (F.col("integral") / F.greatest("full", F.lit(1e-12))).alias("frac"), "peak_x", "x80"
    )


def by_displacement(w: DataFrame, totals: DataFrame, dom: Domain) -> DataFrame:
    """Integral within each multiple of the domain length of true displacement, 0 for a run without touchdowns."""
    sums = [F.sum(F.when(F.col("disp") <= f * dom.length, F.col("wt_f")).otherwise(0.0)).alias(f"s{n}") for n, f in enumerate(DISP_FRACTIONS)]
    g = totals.select("run_id", "n_particles").join(w.groupBy("run_id").agg(*sums), "run_id", "left").na.fill(0.0)
    rows = F.array(
        *[
            F.struct(F.lit(f * dom.length).alias("max_disp"), F.lit(f).alias("frac_of_lx"), F.col(f"s{n}").alias("s"))
            for n, f in enumerate(DISP_FRACTIONS)
        ]
    )
    return g.select("run_id", "n_particles", F.explode(rows).alias("r")).select(
        "run_id", "r.max_disp", "r.frac_of_lx", (F.col("r.s") / F.col("n_particles")).alias("integral")
    )


def cover_classes() -> Column:
    """Names of the (possibly overlapping) cover classes of one raster cell."""
    names = F.array(
        F.when(F.col("water"), F.lit("water")),
        F.when(F.col("array"), F.lit("solar array")),
        F.when(~F.col("array"), F.concat(F.lit("class "), F.col("lcclass").cast("string"))),
    )
    return F.filter(names, lambda n: n.isNotNull())


def cover_share(w: DataFrame, surface: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Footprint-weighted class shares, folded and for unwrapped touchdowns only.

    Touchdowns collapse to one row per (run, site, cell) of a run's block before the raster join. Each such row counts for
    its classes and for its run's total, so one pass over the touchdowns serves both. With ``totals``, a run of it that
    touches no class has one row, whose cover and shares are NULL.
    """
    live = F.when(~F.col("wrapped"), F.col("wt_f")).otherwise(0.0)
    n_tasks, (block, near) = tasks(w), _near(w)
    at = w.select("run_id", "site", *block, F.col("jj").alias("j"), F.col("ii").alias("i"), "wt_f", live.alias("live"))
    if near:
        at = deal(at, n_tasks, *near)
    cells = at.groupBy("run_id", *near[1:], "site", "j", "i").agg(F.sum("wt_f").alias("s"), F.sum("live").alias("s_nw"))
    place = ["site", "j", "i"]
    if n_tasks:
        cells, surface = deal(cells, n_tasks, *place), deal(surface, n_tasks, *place)
    raster = surface.groupBy(*place).agg(F.flatten(F.collect_list(cover_classes())).alias("classes"))
    entry = lambda c, whole: F.struct(c.cast("string").alias("cover"), F.lit(whole).alias("whole"))
    entries = F.concat(F.transform(F.coalesce("classes", F.array().cast("array<string>")), lambda c: entry(c, False)), F.array(entry(F.lit(None), True)))
    hit = cells.join(raster, place, "left").select("run_id", "s", "s_nw", F.explode(entries).alias("e"))
    by = hit.groupBy("run_id", "e.cover", "e.whole").agg(F.sum("s").alias("s"), F.sum("s_nw").alias("s_nw"))
    run, total = Window.partitionBy("run_id"), F.col("whole")
    by = by.withColumns({"t": F.max(F.when(total, F.col("s"))).over(run), "t_nw": F.max(F.when(total, F.col("s_nw"))).over(run)})
    by = by.where(~total & F.col("run_id").isNotNull()).drop("whole")
    if totals is not None:
        by = totals.select("run_id").join(by, "run_id", "left")
    return by.select(
        "run_id",
        "cover",
        F.try_divide("s", "t").alias("share"),
        F.try_divide("s_nw", "t_nw").alias("share_nowrap"),
    )


def wrapped_fraction(w: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Share of the flux beyond the domain and touchdown count; with ``totals``, zeros for its runs without touchdowns."""
    g = w.groupBy("run_id").agg(
        (F.sum(F.when(F.col("wrapped"), F.col("wt_f")).otherwise(0.0)) / F.greatest(F.sum("wt_f"), F.lit(1e-30))).alias("wrapped_fraction"),
        F.count(F.lit(1)).alias("n_touchdown"),
    )
    return g if totals is None else totals.select("run_id").join(g, "run_id", "left").na.fill({"wrapped_fraction": 0.0, "n_touchdown": 0})


def half_totals(framed: DataFrame) -> DataFrame:
    return framed.groupBy("run_id", "half").agg(F.count(F.lit(1)).alias("n_particles"))


def frame_sweep(touchdowns: DataFrame, releases: DataFrame, dom: Domain, tbacks: Sequence[float], w_floor: float = 0.02) -> DataFrame:
    """Raw, mean-removed and streamline-frame integrals for several backward times.

    The frame-dependent sums are linear in (u, v, w), so one pass over the
    joined touchdowns serves every frame. Without touchdowns the integrals are 0
    and the wrapped share is NULL.
    """
    marks = F.array(*[F.lit(float(t)) for t in tbacks])
    keys = ["run_id", "t_back"]
    rel = releases.select("*", F.explode(marks).alias("t_back")).where(F.col("t_release") >= F.col("t_back"))
    frames = release_frames(rel, keys)
    j = touchdowns.join(releases.select("run_id", "particle", "t_release", "rel_u", "rel_v", "rel_w"), ["run_id", "particle"])
    j = j.withColumn("s", contact_weight(F.col("td_w"), w_floor))
    far = (F.abs(F.col("td_x") - dom.xr) > dom.length).cast("double")
    live = (F.col("t_release") >= F.col("t_back")) & (F.col("td_age") <= F.col("t_back"))
    sums = (
        j.select("run_id", "s", "rel_u", "rel_v", "rel_w", "t_release", "td_age", far.alias("far"), F.explode(marks).alias("t_back"))
        .where(live)
        .groupBy(*keys)
        .agg(
            F.sum("s").alias("s"),
            F.sum(F.col("s") * F.col("rel_u")).alias("su"),
            F.sum(F.col("s") * F.col("rel_v")).alias("sv"),
            F.sum(F.col("s") * F.col("rel_w")).alias("sw"),
            F.avg("far").alias("far"),
        )
    )
    n = F.col("n_particles")
    return frames.join(sums, keys, "left").na.fill(0.0, ["s", "su", "sv", "sw"]).select(
        *keys,
        n.alias("n_particles"),
        (F.col("sw") / n).alias("raw"),
        ((F.col("sw") - F.col("w_bar") * F.col("s")) / n).alias("mean_removed"),
        (geo.streamline_w(F.col("su"), F.col("sv"), F.col("sw"), F.col("yaw"), F.col("pitch")) / n).alias("streamline"),
        (F.col("s") / n).alias("conc"),
        (-F.col("w_bar") * F.col("s") / n).alias("w_bar_c"),
        F.col("far").alias("wrapped_share"),
    )


# ----------------------------------------------------------- one-pass account
def accumulate(w: DataFrame, dom: Domain, marks: Sequence[float] = MARKS, t_back: float = 900.0) -> DataFrame:
    """Every per-run sum of a footprint from ONE pass over the touchdowns.

    Each touchdown is three rows (kind, a, b): the first of its four cells, its upwind
    bin, and the set of age marks and displacement edges it counts for with its wrapped
    flag. They are summed in the block of their run, so the touchdown join runs once and
    what moves on is bounded by the grid. A cell's row has the sums of all four; cells
    and sets are dealt out to the rows of the account where the run's half lies.
    """
    nfy = dom.nx
    n_tasks, (block, near) = tasks(w), _near(w)
    u, v = F.col("xm") / dom.dx + dom.i_r, F.col("ym") / dom.dx + dom.j_r
    around = cell_corners(Axis("v", "j", dom.ny, "wrap"), Axis("u", "i", dom.nx, "wrap"))
    p = w.select("run_id", "half", *block, "wt_f", "wt_c", "x_up", "disp", "td_age", "wrapped", u.alias("u"), v.alias("v"))
    if near:
        p = deal(p, n_tasks, *near)
    p = p.select("*", *[part.alias(f"_p{n}") for n, (_, _, part) in enumerate(around)])
    big = lambda c: c.cast("bigint")

    def key(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), big(a).alias("a"), big(b).alias("b"))

    zero = F.lit(0)
    top = (nfy + 0.5) * dom.dx
    bin_of = F.when(F.col("x_up") == top, F.lit(2 * nfy - 1)).otherwise(F.floor(F.col("x_up") / dom.dx - 0.5) + nfy)
    ages = [("age", n, F.col("td_age") <= m) for n, m in enumerate((*marks, t_back))]
    disps = [("disp", n, F.col("disp") <= f * dom.length) for n, f in enumerate(DISP_FRACTIONS)]
    flags = [*ages, *disps, ("wrap", 0, F.col("wrapped"))]
    # more flags than bits go to further rows of the same kind
    sets = [flags[n : n + 60] for n in range(0, len(flags), 60)]
    held = [sum((F.when(c, F.lit(1 << n)).otherwise(0).cast("bigint") for n, (_, _, c) in enumerate(part)), F.lit(0).cast("bigint")) for part in sets]
    keys = F.array(key("cell", around[0][0], around[0][1]), key("fy", bin_of, zero), *[key("set", bits, F.lit(n)) for n, bits in enumerate(held)])
    kind, is_cell = F.col("kind"), F.col("kind") == "cell"
    whole = [F.when(is_cell, F.col("_p0")).otherwise(1.0), *[F.when(is_cell, F.col(f"_p{n}")) for n in (1, 2, 3)]]
    sums = [F.sum(F.col(c) * part).alias(f"_{name}{n}") for name, c in (("flux", "wt_f"), ("conc", "wt_c")) for n, part in enumerate(whole)]
    parts = ["wt_f", "wt_c", "_p0", "_p1", "_p2", "_p3"]
    tagged = p.select("half", "run_id", *near[1:], *parts, F.explode(keys).alias("k")).select("half", "run_id", *near[1:], "k.*", *parts)
    first = tagged.groupBy("run_id", *near[1:], "half", "kind", "a", "b").agg(*sums, F.count(F.lit(1)).alias("_n"))

    def row(name: str | Column, a: Column, b: Column, n: int = 0) -> Column:
        tag = F.lit(name) if isinstance(name, str) else name
        return F.struct(tag.alias("kind"), big(a).alias("a"), big(b).alias("b"), F.col(f"_flux{n}").alias("flux"), F.col(f"_conc{n}").alias("conc"))

    a, b = F.col("a"), F.col("b")
    four = [row("cell", _neighbour("a", F.lit(n >= 2), dom.ny, True), _neighbour("b", F.lit(n % 2 == 1), dom.nx, True), n) for n in range(4)]
    in_set = [F.when((b == k) & (F.shiftright(a, n).bitwiseAND(1) == 1), row(name, F.lit(at), zero)) for k, part in enumerate(sets) for n, (name, at, _) in enumerate(part)]
    in_all = F.when(b == 0, row("all", zero, zero))
    rows = F.when(is_cell, F.array(*four)).when(kind == "fy", F.array(row("fy", a, b))).otherwise(F.filter(F.array(in_all, *in_set), lambda r: r.isNotNull()))
    dealt = deal(first, n_tasks, "run_id", "half").select("run_id", "half", "_n", F.explode(rows).alias("r")).select("run_id", "half", "r.*", "_n")
    return dealt.groupBy("run_id", "half", "kind", "a", "b").agg(F.sum("flux").alias("flux"), F.sum("conc").alias("conc"), F.sum("_n").alias("n"))


def account_cells(acc: DataFrame, by_half: bool = False) -> DataFrame:
    """(run_id[, half], j, i, flux, conc) from an account."""
    keys = ["run_id", "half"] if by_half else ["run_id"]
    c = acc.where(F.col("kind") == "cell")
    return c.groupBy(*keys, F.col("a").alias("j"), F.col("b").alias("i")).agg(F.sum("flux").alias("flux"), F.sum("conc").alias("conc"))


def account_fy(acc: DataFrame, spine: DataFrame, keys: Sequence[str], dom: Domain) -> DataFrame:
    """Dense crosswind-integrated curve from an account."""
    sums = acc.where((F.col("kind") == "fy") & F.col("a").between(0, 2 * dom.nx - 1))
    sums = sums.groupBy(*keys, F.col("a").alias("bin")).agg(F.sum("flux").alias("s"))
    return dense_fy(sums, spine, keys, dom)


def account_scalars(acc: DataFrame, totals: DataFrame) -> DataFrame:
    """Integral, wrapped fraction and touchdown count per run from an account, zeros for a run without touchdowns."""
    pick = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    g = acc.where(F.col("kind").isin("all", "wrap")).groupBy("run_id").agg(
        pick("all", "flux").alias("s"), pick("wrap", "flux").alias("sw"), pick("all", "conc").alias("sc"), pick("all", "n").alias("n_touchdown")
    )
    n = F.greatest("n_particles", F.lit(1))
    return totals.select("run_id", "n_particles").join(g, "run_id", "left").na.fill(0, ["s", "sw", "sc", "n_touchdown"]).select(
        "run_id",
        "n_particles",
        "n_touchdown",
        (F.col("s") / n).alias("integral_all"),
        (F.col("sc") / n).alias("conc_all"),
        (F.col("sw") / F.greatest("s", F.lit(1e-30))).alias("wrapped_fraction"),
    )


# -------------------------------------------------------------- map metrics
def source_area(field: DataFrame, keys: Sequence[str], frac: float = 0.8, value: str = "f", bounded: bool = True) -> DataFrame:
    """Cells of the smallest set that holds ``frac`` of each key's total.

    A field made by the deposits above has at most ny * nx cells per key. Pass
    ``bounded=False`` for fields of any size: the threshold then comes from
    value-ordered buckets and no key is sorted in one task.
    """
    if not bounded:
        thr = mass_threshold(field, keys, value, frac).select(*keys, "thr")
        return field.join(thr, list(keys)).where(F.col(value) >= F.col("thr"))
    return with_threshold(field, keys, {"thr": frac}, value).where(F.col(value) >= F.col("thr"))


def map_metrics(field: DataFrame, keys: Sequence[str], dom: Domain) -> DataFrame:
    """Centroid, bearing, peak cell and 80/50% areas of a north-up map.

    The thresholds and the closing aggregate share one shuffle by key.
    """
    f, i, j = F.col("f"), F.col("i"), F.col("j")
    out = with_threshold(field.select(*keys, "j", "i", "f"), keys, {"t80": 0.8, "t50": 0.5}).groupBy(*keys).agg(
        F.sum("f").alias("tot"),
        F.sum(f * dom.xc(i)).alias("fe"),
        F.sum(f * dom.yc(j)).alias("fn"),
        F.min(F.struct((-f).alias("nf"), j, i)).alias("pk"),
        F.count_if(f >= F.col("t80")).alias("area80"),
        F.count_if(f >= F.col("t50")).alias("area50"),
    )
    ok = F.col("tot") > 0
    e, n = F.col("fe") / F.when(ok, F.col("tot")), F.col("fn") / F.when(ok, F.col("tot"))
    return out.select(
        *keys,
        e.alias("centroid_e"),
        n.alias("centroid_n"),
        F.hypot(e, n).alias("centroid_dist"),
        geo.pmod_(F.degrees(F.atan2(e, n)), 360.0).alias("centroid_bearing"),
        F.col("area80").alias("area80_cells"),
        F.when(ok, F.col("area80") * dom.area / 1e4).alias("area80_ha"),
        F.when(ok, F.col("area50") * dom.area / 1e4).alias("area50_ha"),
        F.when(ok, dom.xc(F.col("pk.i"))).alias("peak_e"),
        F.when(ok, dom.yc(F.col("pk.j"))).alias("peak_n"),
        F.when(ok, -F.col("pk.nf")).alias("peak_value"),
        (F.col("tot") * dom.area).alias("integral"),
    )


def crosswind_sum(field: DataFrame, keys: Sequence[str], res: float, value: str = "f") -> DataFrame:
    """Integrate a 2-D field over its crosswind axis."""
    return field.groupBy(*keys, "i").agg((F.sum(value) * res).alias("fy"))


def wind_metrics(field: DataFrame, keys: Sequence[str], x_edge: float, y_edge: float, res: float) -> DataFrame:
    """Peak, centroid and near/far extent of the 80% area on a wind-frame map."""
    xc, yc = x_edge + (F.col("i") + 0.5) * res, y_edge + (F.col("j") + 0.5) * res
    inside = F.col("f") >= F.col("thr")
    # columns of the map first: they carry everything the closing aggregate needs
    cols = with_threshold(field.select(*keys, "j", "i", "f"), keys, {"thr": 0.8}).groupBy(*keys, "i").agg(
        F.sum("f").alias("fy"),
        F.sum(F.col("f") * yc).alias("fyc"),
        F.count_if(inside).alias("n_in"),
        F.max("thr").alias("thr"),
    )
    g = cols.groupBy(*keys).agg(
        F.sum("fy").alias("tot"),
        F.sum(F.col("fy") * xc).alias("fx"),
        F.sum("fyc").alias("fyc"),
        F.min(F.struct((-F.col("fy")).alias("s"), "i"))["i"].alias("ip"),
        F.min(F.when(F.col("n_in") > 0, xc)).alias("x80_near"),
        F.max(F.when(F.col("n_in") > 0, xc)).alias("x80_far"),
        F.sum("n_in").alias("area80_cells"),
        F.max("thr").alias("thr80"),
    )
    ok = F.when(F.col("tot") > 0, F.col("tot"))
    return g.select(
        *keys,
        F.when(ok.isNotNull(), x_edge + (F.col("ip") + 0.5) * res).alias("peak_x"),
        (F.col("fx") / ok).alias("centroid_x"),
        (F.col("fyc") / ok).alias("centroid_y"),
        "x80_near",
        "x80_far",
        "area80_cells",
        "thr80",
    )


def field_peak_centroid(field: DataFrame, keys: Sequence[str], x_edge: float, res: float) -> DataFrame:
    """(peak_x, centroid_x) only, without the source area; null when total <= 0."""
    xc = x_edge + (F.col("i") + 0.5) * res
    cols = crosswind_sum(field, keys, 1.0)
    g = cols.groupBy(*keys).agg(
        F.sum("fy").alias("tot"), F.sum(F.col("fy") * xc).alias("fx"), F.min(F.struct((-F.col("fy")).alias("s"), "i"))["i"].alias("ip")
    )
    ok = F.col("tot") > 0
    return g.select(
        *keys,
        F.when(ok, x_edge + (F.col("ip") + 0.5) * res).alias("peak_x"),
        (F.col("fx") / F.when(ok, F.col("tot"))).alias("centroid_x"),
    )


# ---------------------------------------------------------------- comparisons
def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], frac: float = 0.8) -> DataFrame:
    """Jaccard index of the two maps' source areas (negative cells clipped first)."""

    def side(f: DataFrame, n: int) -> DataFrame:
        return f.select(*keys, "j", "i", F.greatest("f", F.lit(0.0)).alias("f"), F.lit(n).alias("side"))

    both = source_area(side(a, 1).unionByName(side(b, 2)), [*keys, "side"], frac)
    cells = both.groupBy(*keys, "j", "i").agg(F.count(F.lit(1)).alias("_hits"))
    return cells.groupBy(*keys).agg((F.count_if(F.col("_hits") == 2) / F.count(F.lit(1))).alias("overlap"))


def shape_l1(a: DataFrame, b: DataFrame, keys: Sequence[str], unit: bool = False) -> DataFrame:
    """Normalised L1 difference; ``unit`` first scales each map to a unit total."""

    def scaled(f: DataFrame, name: str) -> DataFrame:
        if unit:
            t = f.groupBy(*keys).agg(F.sum("f").alias("t"))
            f = f.join(t, list(keys)).withColumn("f", F.try_divide("f", "t"))
        return f.select(*keys, "j", "i", F.col("f").alias(name))

    both = scaled(a, "fa").join(scaled(b, "fb"), [*keys, "j", "i"], "full_outer").na.fill(0.0, ["fa", "fb"])
    return both.groupBy(*keys).agg(
        F.try_divide(F.sum(F.abs(F.col("fa") - F.col("fb"))), 0.5 * (F.sum(F.abs("fa")) + F.sum(F.abs("fb")))).alias("l1"),
        F.try_divide(F.sum(F.abs(F.col("fa") - F.col("fb"))), F.sum(F.abs("fa"))).alias("l1_first"),
    )


def tail_share(w: DataFrame, cells: DataFrame, keys: Sequence[str] = ("run_id",), totals: DataFrame | None = None) -> DataFrame:
    """Largest single weight and the share of the largest 0.1% of touchdowns.

    With ``totals``, its keys without touchdowns have count and share 0 and no largest weight.
    """
    k = F.greatest(F.floor(F.col("total") * 0.001), F.lit(1)).cast("double")
    top = top_sum(w, keys, "wt_f", k)
    tot = cells.groupBy(*keys).agg(F.sum(F.abs("flux")).alias("tot"))
    out = top.join(tot, list(keys)).select(
        *keys,
        F.col("biggest").alias("max_weight"),
        (F.col("top") / F.when(F.col("tot") == 0, 1.0).otherwise(F.col("tot"))).alias("top0p1pct_share"),
        F.col("n").cast("bigint").alias("n_touchdown"),
    )
    return out if totals is None else totals.select(*keys).join(out, list(keys), "left").na.fill({"top0p1pct_share": 0.0, "n_touchdown": 0})


# ------------------------------------------------------------------ planning
def release_plan(windows: DataFrame, n_per: int, dt: float, t_back: float, rel_seconds: float | None = None) -> DataFrame:
    """Particles to release for each window (run_id, t_start, t_end)."""
    first = F.col("t_start") + t_back
    if rel_seconds is not None:
        first = F.greatest(first, F.col("t_end") - rel_seconds)
    w = windows.withColumn("t_first", first)
    times = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t_end") - F.col("t_first") + 1e-9) / dt))
    w = w.where(F.col("t_end") > F.col("t_first")).select("run_id", "t_first", F.explode(times).alias("n"))
    w = w.select("run_id", "n", (F.col("t_first") + F.col("n") * dt).alias("t_release"), F.explode(F.sequence(F.lit(0), F.lit(n_per - 1))).alias("m"))
    return w.select("run_id", (F.col("n") * n_per + F.col("m")).alias("particle"), "t_release")


def averaging_period(series: DataFrame, t_first: float | Column, t_last: float | Column, t: str = "t") -> DataFrame:
    """Samples of the averaging period, with a little slack at both ends."""
    return series.where(F.col(t).between(t_first - 1e-6, t_last + 1e-6))


def check_windows(windows: DataFrame, t_back: float) -> DataFrame:
    """Windows without enough history for a single release."""
    return windows.where(F.col("t_end") - F.col("t_start") <= t_back)


def subwindow_index(t: Column, t_first: float, sub: float, nsub: int) -> Column:
    return F.least(F.greatest(F.floor((t - t_first) / sub), F.lit(0)), F.lit(nsub - 1)).cast("bigint")
