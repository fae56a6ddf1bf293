"""Composite reports: what a user calls, built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.geometry import Domain
from ..operators import climate, compare
from ..operators import footprint as fp
from ..operators import levels as lv
from ..operators import rasters
from ..operators import reference_model as rm
from ..sources import sinks
from ..sources.shared_table import materialize


def spinup_gate(cells: DataFrame, surface: DataFrame, dt: float) -> DataFrame:
    """Stationarity verdict and the newest dump's sigma_w^2 peak per run."""
    trend = lv.trend_gate(lv.dump_history(cells, surface, dt)).select("run_id", "n", "sig_tke", "sig_us", "stationary")
    prof = lv.dump_profiles(cells).join(lv.levels_table(cells), ["run_id", "k"])
    pick = F.max_by(F.struct("ww", "z", "step"), F.struct("step", "ww", (-F.col("k")).alias("nk")))
    peak = prof.groupBy("run_id").agg(pick.alias("p")).select("run_id", "p.*")
    j = trend.join(peak, "run_id").join(lv.surface_means(surface), ["run_id", "step"])
    return j.select(
        "run_id",
        "n",
        "sig_tke",
        "sig_us",
        "stationary",
        (F.col("ww") / F.greatest(F.col("us") * F.col("us"), F.lit(1e-30))).alias("sw2_over_us2"),
        F.col("z").alias("z_peak"),
        F.col("us").alias("ustar"),
    )


def cbl_report(cells: DataFrame, surface: DataFrame, dt: float) -> DataFrame:
    """Final convective state, growth and entrainment verdict per run."""
    conv = lv.convective_state(cells, surface, dt)
    last = lv.newest_rows(conv).join(lv.growth_rate(conv), "run_id", "left")
    ok = F.col("entrainment").between(0.10, 0.35)
    return last.select(
        "run_id",
        "step",
        "z_i",
        "w_star",
        "ustar",
        "wth_s",
        "entrainment",
        "tke_int",
        "L",
        F.try_divide("z_i", "L").alias("zi_over_l"),
        "growth",
        F.when(ok, "OK").otherwise("OUTSIDE").alias("gate"),
    )


def near_surface(cells: DataFrame, surface: DataFrame) -> DataFrame:
    """Variance ratios and grid-scale correlation of w per plane."""
    corr = lv.lag1_autocorr(cells).drop("std")
    j = corr.join(lv.variance_ratio(cells), ["run_id", "step"]).join(lv.surface_means(surface), ["run_id", "step"])
    return j.select("run_id", "step", "k", "corr_x", "corr_y", "ratio_u", "ratio_v", "ratio_w", "ratio_theta", F.col("us").alias("ustar"))


def footprint_report(touchdowns: DataFrame, releases: DataFrame, params: DataFrame, dom: Domain) -> DataFrame:
    """Measured map and curve metrics next to the closed-form model, per run.

    A run without touchdowns has integral 0 and no map or curve metrics; one without ``params`` has no model metrics.
    """
    run = ["run_id"]
    frames = materialize(fp.release_frames(releases), "frames")
    framed = fp.framed_releases(releases, frames)
    # the touchdown join runs once; everything below reads the bounded account
    acc = materialize(fp.accumulate(fp.weigh(touchdowns, framed, dom), dom), "account")
    full = fp.density(fp.account_cells(acc), frames, run, dom.area)
    halves = fp.density(fp.account_cells(acc, True), fp.half_totals(framed), ["run_id", "half"], dom.area)
    first, second = (halves.where(F.col("half") == n).drop("half") for n in (1, 2))
    model = materialize(rm.static_raster(params, dom), "model")
    mm = fp.map_metrics(full, run, dom).select("run_id", "area80_ha", "centroid_dist", "centroid_bearing", F.col("integral").alias("integral_les"))
    fm = fp.fy_metrics(fp.account_fy(acc, frames, run, dom), run, dom.dx).select("run_id", "peak_x", "x80")
    kl = model.groupBy("run_id").agg((F.sum("f") * dom.area).alias("integral_kljun"))
    out = (
        fp.account_scalars(acc, frames)
        .join(mm, "run_id", "left")
        .join(kl, "run_id", "left")
        .join(fm, "run_id", "left")
        .join(rm.peaks(params).select("run_id", F.col("x_max").alias("peak_kljun")), "run_id", "left")
        .join(fp.overlap(full, model, run).withColumnRenamed("overlap", "overlap_kljun"), "run_id", "left")
        .join(fp.overlap(first, second, run).withColumnRenamed("overlap", "overlap_halves"), "run_id", "left")
    )
    return out.select(
        "run_id",
        "n_particles",
        "area80_ha",
        "centroid_dist",
        "centroid_bearing",
        F.coalesce("integral_les", F.lit(0.0)).alias("integral_les"),
        "integral_kljun",
        "peak_x",
        "peak_kljun",
        "x80",
        F.when(F.col("integral_kljun").isNotNull(), F.col("overlap_kljun")).alias("overlap_kljun"),
        "overlap_halves",
        "wrapped_fraction",
    )


MAP_FIELDS = ("centroid_e", "centroid_n", "centroid_dist", "centroid_bearing", "area80_ha", "area50_ha", "peak_e", "peak_n", "peak_value")
CURVE_FIELDS = ("peak_x", "mean_x", "x80")


def window_report(touchdowns: DataFrame, releases: DataFrame, params: DataFrame, dom: Domain) -> DataFrame:
    """All scalars of a window's result, a row for each run.

    Frame of the releases and what the rotation left of w; map metrics of the measured and of the modelled footprint
    (``les_``, ``kljun_``), curve metrics of the measured one; integrals inside and outside the raster; overlaps at 80% and
    50%; the error floor from the window's halves. The tables that belong to it (capture, displacement, cover) are
    those of :func:`compute_footprint`. A run without touchdowns has integral 0 and no metrics.
    """
    run = ["run_id"]
    parts = compute_footprint(touchdowns, releases, None, dom)
    frames, full = parts["frames"], materialize(parts["map"], "map")
    halves, model = materialize(parts["halves"], "halves"), materialize(rm.static_raster(params, dom), "model")
    turned = geo.streamline_w(F.col("u_bar"), F.col("v_bar"), F.col("w_bar"), F.col("yaw"), F.col("pitch"))
    out = frames.select(
        "run_id", "n_particles", F.degrees("yaw").alias("wind_angle"), F.degrees("pitch").alias("pitch"), "w_bar", turned.alias("w_sf_mean"), (F.col("t_last") - F.col("t_first")).alias("rel_seconds")
    )
    out = out.join(parts["scalars"].select("run_id", "n_touchdown", F.col("integral_all").alias("integral_les_all"), "wrapped_fraction"), run, "left")
    for name, field in (("les", full), ("kljun", model)):
        m = fp.map_metrics(field, run, dom).select("run_id", F.col("integral").alias(f"integral_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in MAP_FIELDS])
        out = out.join(m, run, "left")
    curve = fp.fy_metrics(parts["fy"], run, dom.dx).select("run_id", *[F.col(c).alias(f"les_{c}") for c in CURVE_FIELDS])
    out = out.join(curve, run, "left").na.fill({"integral_les": 0.0})
    for frac, name in ((0.8, "overlap_kljun"), (0.5, "overlap50_kljun")):
        out = out.join(fp.overlap(full, model, run, frac).withColumnRenamed("overlap", name), run, "left")
    one, two = (halves.where(F.col("half") == n).drop("half") for n in (1, 2))
    out = out.join(fp.overlap(one, two, run).withColumnRenamed("overlap", "halves_overlap"), run, "left")
    side = lambda c, n: F.max(F.when(F.col("half") == n, F.col(c)))
    keys = ["run_id", "half"]
    peaks = fp.fy_metrics(parts["fy_halves"], keys, dom.dx).groupBy("run_id").agg((side("peak_x", 1) - side("peak_x", 2)).alias("halves_dpeak"))
    centres = fp.map_metrics(halves, keys, dom).groupBy("run_id").agg(
        F.hypot(side("centroid_e", 1) - side("centroid_e", 2), side("centroid_n", 1) - side("centroid_n", 2)).alias("halves_dcentroid")
    )
    return out.join(peaks, run, "left").join(centres, run, "left")


def flat_vs_terrain(flat: DataFrame, terrain: DataFrame, dom: Domain, box: tuple) -> DataFrame:
    """Integrals, box contributions and 80% overlap of two maps per run."""
    e = (-0.5 - dom.i_r) * dom.dx
    run = ["run_id"]

    def side(f: DataFrame, tag: str) -> DataFrame:
        tot = f.groupBy(*run).agg((F.sum("f") * dom.area).alias(f"integral_{tag}"))
        b = rasters.box_contribution(f, run, [("box", *box)], e, e, dom.dx)
        return tot.join(b.select(*run, F.col("contribution").alias(f"box_{tag}")), run, "left")

    j = side(flat, "flat").join(side(terrain, "terrain"), run).join(fp.overlap(terrain, flat, run), run, "left")
    ratio = F.col("box_terrain") / F.greatest("box_flat", F.lit(1e-12))
    return j.select("run_id", "integral_flat", "integral_terrain", "box_flat", "box_terrain", ratio.alias("ratio"), "overlap")


def climate_report(derived: DataFrame) -> DataFrame:
    """Wind rose by stability with class medians, margins included."""
    derived = materialize(derived.select("site", "cls", "oct", "qc", "pblh", "us", "wth"), "derived")
    rose = climate.rose_wide(climate.wind_rose(derived))
    tab = climate.stability_table(derived).drop("pct")
    octs = [f"oct_{o}" for o in [*range(8), "all"]]
    return rose.join(tab, ["site", "cls"], "left").select("site", "cls", "n", "pblh_p50", "us_p50", "wth_p50", *octs)


def transect_report(rays: DataFrame, surface: DataFrame, dom: Domain, rmax: float) -> DataFrame:
    """Cover, terrain and roughness along each run's upwind ray, with label places."""
    line = rasters.transect(rays, surface, dom, rmax)
    g = line.groupBy("run_id", "lcclass").agg(F.count(F.lit(1)).alias("n"), F.avg("topo").alias("topo"), F.avg("z0m").alias("z0m"))
    return g.join(rasters.longest_run(line, ["run_id"], dom.dx / 2.0), ["run_id", "lcclass"], "left")


def restart_tables(cells: DataFrame, levels: DataFrame, surface: DataFrame, n: int, turns: Column) -> DataFrame:
    """Turn the flow, inject an unturned surface and rebuild the level heights.

    ``surface`` has (run_id, step, j, i, z0m, zg) and stays as it is.
    """
    top = levels.groupBy("run_id").agg(F.max("z").alias("z_top"))
    turned = rasters.rotate_cells(cells, n, turns).select("run_id", "step", "k", "j", "i", "u", "v", "w")
    lev = levels.select("run_id", "k", "z").join(top, "run_id")
    j = turned.join(lev, ["run_id", "k"]).join(surface, ["run_id", "step", "j", "i"])
    z = geo.terrain_height(F.col("z"), F.col("zg"), F.col("z_top"))
    return j.select(
        "run_id", "step", "k", "j", "i", "u", "v", "w", z.alias("z_new"), "z0m", F.least("z0m", F.lit(0.01)).alias("z0t")
    )


def precision_ab(full: DataFrame, coarse: DataFrame, dom: Domain) -> DataFrame:
    """Overlap, per-cell L1 and integral difference of a reduced-precision map."""
    run = ["run_id"]
    l1 = fp.shape_l1(full, coarse, run).select("run_id", F.col("l1_first").alias("l1"))
    tot = lambda f, n: f.groupBy(*run).agg((F.sum("f") * dom.area).alias(n))
    j = fp.overlap(coarse, full, run).join(l1, run).join(tot(full, "a"), run).join(tot(coarse, "b"), run)
    return j.select("run_id", "overlap", "l1", (F.col("b") - F.col("a")).alias("d_integral"))


def compute_footprint(touchdowns: DataFrame, releases: DataFrame, surface: DataFrame | None, dom: Domain, w_floor: float = 0.02) -> dict[str, DataFrame]:
    """Everything one averaging window yields, as tables keyed by run.

    Two passes over the touchdowns at most: the account, and the per-cell
    cover sums when a surface is given.
    """
    run = ["run_id"]
    frames = materialize(fp.release_frames(releases), "frames")
    framed = fp.framed_releases(releases, frames)
    w = fp.weigh(touchdowns, framed, dom, w_floor)
    acc = materialize(fp.accumulate(w, dom), "account")
    sums = acc.where(F.col("kind").isin("age", "disp")).groupBy("run_id", "kind", "a").agg(F.sum("flux").alias("s"))
    per = F.greatest("n_particles", F.lit(1))
    edges = frames.select("run_id", "n_particles", F.posexplode(F.array(*[F.lit(v) for v in fp.DISP_FRACTIONS])).alias("a", "frac_of_lx"))
    by_disp = edges.join(sums.where(F.col("kind") == "disp"), ["run_id", "a"], "left")
    out = {
        "frames": frames,
        "map": fp.density(fp.account_cells(acc), frames, run, dom.area),
        "concentration": fp.density(fp.account_cells(acc), frames, run, dom.area, "conc"),
        "halves": fp.density(fp.account_cells(acc, True), fp.half_totals(framed), ["run_id", "half"], dom.area),
        "fy": fp.account_fy(acc, frames, run, dom),
        "fy_halves": fp.account_fy(acc, fp.half_totals(framed), ["run_id", "half"], dom),
        "capture": fp.capture_curve(w, frames, dom),
        "by_disp": by_disp.select("run_id", "frac_of_lx", (F.coalesce("s", F.lit(0.0)) / per).alias("integral")),
        "scalars": fp.account_scalars(acc, frames),
    }
    if surface is not None:
        out["cover"] = fp.cover_share(w, surface, frames)
    return out


def regression_metrics(touchdowns: DataFrame, releases: DataFrame, params: DataFrame, dom: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first half's metrics, whole window's metrics, half difference): long tables (run_id, metric, value) and (run_id, dpeak)."""
    run, keys = ["run_id"], ["run_id", "half"]
    parts = compute_footprint(touchdowns, releases, None, dom)
    maps, full = materialize(parts["halves"], "halves"), materialize(parts["map"], "map")
    first, second = (maps.where(F.col("half") == n).drop("half") for n in (1, 2))
    peaks = fp.fy_metrics(parts["fy_halves"], keys, dom.dx)
    h = peaks.groupBy("run_id").agg(*[F.max(F.when(F.col("half") == n, F.col("peak_x"))).alias(f"p{n}") for n in (1, 2)])
    h = materialize(h, "half-peaks")
    total = lambda f: f.groupBy("run_id").agg((F.sum("f") * dom.area).alias("integral"))
    area = lambda f: fp.map_metrics(f, run, dom).select("run_id", "area80_ha")
    base = h.select("run_id", F.col("p1").alias("peak_x")).join(total(first), run).join(fp.overlap(first, second, run), run).join(area(first), run)
    now = fp.fy_metrics(parts["fy"], run, dom.dx).select("run_id", "peak_x").join(total(full), run)
    now = now.join(fp.overlap(full, rm.static_raster(params, dom), run), run).join(area(full), run)
    names = ["peak_x", "area80_ha", "integral", "overlap"]
    was = materialize(compare.melt(base, run, names), "baseline")
    # the stored candidate and the verdict both read it: the model's raster is made once
    now = materialize(compare.melt(now, run, names), "candidate")
    return was, now, h.select("run_id", (F.col("p1") - F.col("p2")).alias("dpeak"))


def regression(touchdowns: DataFrame, releases: DataFrame, params: DataFrame, dom: Domain) -> DataFrame:
    """First half as baseline, whole window as candidate, half difference as tolerance."""
    was, now, floor = regression_metrics(touchdowns, releases, params, dom)
    return compare.verdict(was, now, compare.tolerances(was, floor))


def against_baseline(spark: SparkSession, path: str, now: DataFrame, floor: DataFrame) -> DataFrame:
    """The verdict on ``now`` against the newest accepted version of the baseline stored at ``path``."""
    was = sinks.baseline(spark, path).select("run_id", "metric", "value")
    return compare.verdict(was, now, compare.tolerances(was, floor))
