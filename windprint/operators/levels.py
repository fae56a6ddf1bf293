"""Level profiles, window statistics and quality gates over gridded dumps.

Two-level means everywhere: a statistic is taken per dump and level first and
only then averaged over dumps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boundary_layer as bl
from ..functions import geometry as geo
from ..functions.numeric import isfinite, neighbour, ratio

KAPPA, G = 0.4, 9.81


# ------------------------------------------------------------------- geometry
def levels_table(cells: DataFrame) -> DataFrame:
    """Static level heights from the first dump that carries them."""
    z = cells.where(F.col("z_pos").isNotNull()).groupBy("run_id", "k").agg(F.min_by("z_pos", "step").alias("z"))
    w = Window.partitionBy("run_id").orderBy("k")
    lo, hi, here = F.lag("z").over(w), F.lead("z").over(w), F.col("z")
    dz = F.when(lo.isNull(), hi - here).when(hi.isNull(), here - lo).otherwise((hi - lo) / 2.0)
    return z.withColumn("dz", dz)


def with_delta(levels: DataFrame, dx: float) -> DataFrame:
    return levels.withColumn("delta", F.cbrt(dx * dx * F.col("dz")))


def nearest_level(levels: DataFrame, z_target: float) -> DataFrame:
    """(run_id, k_r, z_r): first of the levels closest to the target height."""
    best = F.min(F.struct(F.abs(F.col("z") - z_target).alias("d"), "k", "z"))
    return levels.groupBy("run_id").agg(best.alias("b")).select("run_id", F.col("b.k").alias("k_r"), F.col("b.z").alias("z_r"))


def terrain_columns(levels: DataFrame, ground: DataFrame) -> DataFrame:
    """(run_id, j, i, zg, z_arr, agl_arr): level heights of every column over terrain, absolute and above its ground.

    ``levels`` (run_id, k, z) are those of a flat column, ``ground`` (run_id, j, i, zg) is the surface: levels follow
    the terrain and meet at the top, so they differ by column.
    """
    z = F.array_sort(F.collect_list(F.struct("k", "z")))
    flat = levels.groupBy("run_id").agg(z.alias("l")).select("run_id", F.col("l.z").alias("flat"), F.array_max("l.z").alias("top"))
    c = ground.join(flat, "run_id")
    heights = F.transform("flat", lambda f: geo.terrain_height(f, F.col("zg"), F.col("top")))
    c = c.select("run_id", "j", "i", "zg", heights.alias("z_arr"))
    return c.withColumn("agl_arr", F.transform("z_arr", lambda v: v - F.col("zg")))


def regrid_above_ground(cells: DataFrame, columns: DataFrame, heights: Sequence[float], values: Sequence[str]) -> DataFrame:
    """(run_id, step, j, i, h, values): fields at fixed heights above the ground of each column.

    A column's levels (a few hundred) become one array in the order of k; each height is then searched in the heights of
    its own column and interpolated, without a join per height. Heights outside the column hold its end value; a column
    that lacks a level has NULL.
    """
    from ..functions.numeric import interp_levels

    packed = cells.groupBy("run_id", "step", "j", "i").agg(F.array_sort(F.collect_list(F.struct("k", *values))).alias("c"))
    rows = packed.join(columns, ["run_id", "j", "i"])
    whole = F.size("c") == F.size("agl_arr")
    rows = rows.select("run_id", "step", "j", "i", "agl_arr", *[F.when(whole, F.col(f"c.{v}")).alias(f"{v}_arr") for v in values], F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("h"))
    return rows.select("run_id", "step", "j", "i", "h", *[F.when(F.col(f"{v}_arr").isNotNull(), interp_levels(F.col("h"), F.col("agl_arr"), F.col(f"{v}_arr"))).alias(v) for v in values])


def receptor_height(columns: DataFrame, levels: DataFrame, z_target: float, j_r: Column, i_r: Column) -> DataFrame:
    """(run_id, j, i, k_r, z_r, agl_r, zg): absolute height of the receptor's level in its own column, and above its ground.

    The level is the one nearest to the target in the flat column; over terrain it lies that far above the local ground.
    """
    here = columns.where((F.col("j") == j_r) & (F.col("i") == i_r)).join(nearest_level(levels, z_target).select("run_id", "k_r"), "run_id")
    at = lambda a: F.get(F.col(a), F.col("k_r").cast("int"))
    return here.select("run_id", "j", "i", "k_r", at("z_arr").alias("z_r"), at("agl_arr").alias("agl_r"), "zg")


def mean_levels(columns: DataFrame) -> DataFrame:
    """(run_id, k, z, dz): mean height of each level above the mean ground, with centred spacings."""
    z = columns.select("run_id", "zg", F.posexplode("z_arr").alias("k", "z")).groupBy("run_id", F.col("k").cast("bigint").alias("k")).agg((F.avg("z") - F.avg("zg")).alias("z"))
    w = Window.partitionBy("run_id").orderBy("k")
    lo, hi, here = F.lag("z").over(w), F.lead("z").over(w), F.col("z")
    return z.withColumn("dz", F.when(lo.isNull(), hi - here).when(hi.isNull(), here - lo).otherwise((hi - lo) / 2.0))


def receptor_column(pin: Column, frac: float, n: int) -> Column:
    """Pinned index where given, else the rounded domain fraction."""
    return F.coalesce(pin, F.rint(F.lit(frac * n))).cast("bigint")


# ------------------------------------------------------------------- profiles
def dump_profiles(cells: DataFrame) -> DataFrame:
    """Horizontal means and population (co)variances per (run, step, k)."""
    e = F.greatest("tke", F.lit(0.0))
    return cells.groupBy("run_id", "step", "k").agg(
        F.avg("u").alias("U"),
        F.avg("v").alias("V"),
        F.avg("theta").alias("TH"),
        F.avg(e).alias("E"),
        F.var_pop("u").alias("uu"),
        F.var_pop("v").alias("vv"),
        F.var_pop("w").alias("ww"),
        F.covar_pop("u", "v").alias("uv"),
        F.covar_pop("u", "w").alias("uw"),
        F.covar_pop("v", "w").alias("vw"),
        F.covar_pop("w", "theta").alias("wt"),
    ).withColumn("tke", 0.5 * (F.col("uu") + F.col("vv") + F.col("ww")))


def mean_profiles(prof: DataFrame) -> DataFrame:
    names = ["U", "V", "TH", "E", "uu", "vv", "ww", "uv", "uw", "vw", "wt", "tke"]
    return prof.groupBy("run_id", "k").agg(*[F.avg(n).alias(n) for n in names])


def surface_means(surface: DataFrame) -> DataFrame:
    """Per-dump means of the surface fields; a column a run never wrote is NULL."""
    have = set(surface.columns)
    cols = {"ustar": "us", "ht_flux": "hf", "inv_l": "il"}
    aggs = [(F.avg(c) if c in have else F.max(F.lit(None).cast("double"))).alias(a) for c, a in cols.items()]
    return surface.groupBy("run_id", "step").agg(*aggs)


def surface_flux(hf: Column, us: Column, th: Column, il: Column) -> Column:
    """Written heat flux, else derived from 1/L, else 0 for neutral."""
    derived = F.when(F.abs(il) > 1e-12, -F.pow(us, F.lit(3.0)) * th * il / (KAPPA * G)).otherwise(0.0)
    return F.coalesce(hf, derived)


def surface_scalars(prof: DataFrame, surface: DataFrame) -> DataFrame:
    """Window means of u*, heat flux and lowest-level theta."""
    th = prof.where(F.col("k") == 0).select("run_id", "step", F.col("TH").alias("th"))
    s = surface_means(surface).join(th, ["run_id", "step"])
    return s.groupBy("run_id").agg(
        F.avg("us").alias("ustar"),
        F.avg(surface_flux(F.col("hf"), F.col("us"), F.col("th"), F.col("il"))).alias("ht_flux"),
        F.avg("th").alias("theta0"),
        F.count(F.lit(1)).alias("n_dumps"),
    )


def boundary_height(mean_prof: DataFrame, levels: DataFrame) -> DataFrame:
    """First level at or above the TKE maximum with TKE < 5% of it, else the top."""
    p = mean_prof.join(levels, ["run_id", "k"])
    top = p.groupBy("run_id").agg(
        F.min(F.struct((-F.col("tke")).alias("s"), "k")).alias("m"), F.max_by("z", "k").alias("z_top")
    )
    top = top.select("run_id", F.col("m.k").alias("k_max"), (-F.col("m.s")).alias("tke_max"), "z_top")
    hit = (F.col("k") >= F.col("k_max")) & (F.col("tke") < 0.05 * F.col("tke_max"))
    return p.join(top, "run_id").groupBy("run_id").agg(
        F.coalesce(F.min_by("z", F.when(hit, F.col("k"))), F.max("z_top")).alias("h"), F.max("k_max").alias("k_max")
    )


def window_stats(cells: DataFrame, surface: DataFrame, z_target: float = 30.0) -> DataFrame:
    """One row per run: everything the reference model and the gates need."""
    levels, prof = levels_table(cells), dump_profiles(cells)
    mean_prof = mean_profiles(prof)
    at = nearest_level(levels, z_target)
    rec = mean_prof.join(at, "run_id").where(F.col("k") == F.col("k_r"))
    j = rec.join(surface_scalars(prof, surface), "run_id").join(boundary_height(mean_prof, levels).select("run_id", "h"), "run_id")
    sgs = 2.0 / 3.0 * F.col("E")
    ang = F.atan2("V", "U")
    sa, ca = F.sin(ang), F.cos(ang)
    svr = F.greatest(sa * sa * F.col("uu") - 2.0 * sa * ca * F.col("uv") + ca * ca * F.col("vv"), F.lit(0.0))
    return j.select(
        "run_id",
        "n_dumps",
        "k_r",
        "z_r",
        "U",
        "V",
        F.hypot("U", "V").alias("u_mean"),
        geo.met_direction(F.col("U"), F.col("V")).alias("wdir"),
        F.sqrt(F.col("uu") + sgs).alias("sigma_u"),
        F.sqrt(svr + sgs).alias("sigma_v"),
        F.sqrt(F.col("ww") + sgs).alias("sigma_w"),
        F.sqrt(svr).alias("sigma_v_resolved"),
        F.sqrt("ww").alias("sigma_w_resolved"),
        F.col("E").alias("e_sgs"),
        "ustar",
        "ht_flux",
        "theta0",
        bl.obukhov(F.col("ustar"), F.col("theta0"), F.col("ht_flux")).alias("L"),
        "h",
    )


def closure_sweep(stats: DataFrame, factors: Sequence[float]) -> DataFrame:
    """sigma_w/u* for several multipliers on the sub-grid part, against 1.25."""
    f = stats.withColumn("factor", F.explode(F.array(*[F.lit(float(x)) for x in factors])))
    s = F.sqrt(F.pow("sigma_w_resolved", F.lit(2.0)) + F.col("factor") * 2.0 / 3.0 * F.col("e_sgs")) / F.col("ustar")
    return f.select("run_id", "factor", s.alias("sw_over_us"), (s - 1.25).alias("vs_target"))


# ---------------------------------------------------------------------- gates
def subgrid_fraction(cells: DataFrame, dx: float, levels: DataFrame | None = None) -> DataFrame:
    """Sub-grid share of the vertical variance per level against z/Delta.

    ``levels`` (run_id, k, z, dz) replaces the flat column's heights: over terrain those of :func:`mean_levels`.
    """
    lv = with_delta(levels_table(cells) if levels is None else levels, dx)
    p = mean_profiles(dump_profiles(cells)).join(lv, ["run_id", "k"])
    sg = 2.0 / 3.0 * F.col("E")
    return p.select(
        "run_id",
        "k",
        "z",
        "dz",
        "delta",
        (F.col("z") / F.col("delta")).alias("z_over_delta"),
        F.col("ww").alias("resolved"),
        sg.alias("subgrid"),
        (sg / F.greatest(F.col("ww") + sg, F.lit(1e-30))).alias("fraction"),
    )


def subgrid_gate(frac: DataFrame, z_target: float = 30.0, limit: float = 0.40) -> DataFrame:
    """Receptor verdict, plus where the fraction crosses the limit on z/Delta."""
    from ..functions.numeric import interp_levels

    rec = frac.groupBy("run_id").agg(F.min(F.struct(F.abs(F.col("z") - z_target).alias("d"), "k", "fraction", "delta")).alias("r"))
    arr = frac.where(isfinite(F.col("fraction")) & (F.col("z") > 0)).groupBy("run_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("z_over_delta", "fraction")))).alias("a")
    )
    return rec.join(arr, "run_id").select(
        "run_id",
        F.col("r.k").alias("k_r"),
        F.col("r.fraction").alias("fraction"),
        F.when(F.col("r.fraction") < limit, "PASS").otherwise("FAIL").alias("gate"),
        interp_levels(F.lit(limit), F.col("a.fraction"), F.col("a.z_over_delta")).alias("crossing"),
    )


def k0k1_gate(cells: DataFrame, limit: float = 1.0, floor: float = 1e-5) -> DataFrame:
    """Near-surface w-variance ratio; finiteness is tested before the ratio."""
    w = F.col("w").cast("double")
    ok = isfinite(w)
    at = lambda k: F.var_pop(F.when((F.col("k") == k) & ok, w))
    g = cells.groupBy("run_id", "step").agg(
        at(0).alias("ww0"), at(1).alias("ww1"), F.count_if(~ok).alias("n_bad"), F.count(F.lit(1)).alias("n_cells")
    )
    return gate_status(g, limit, floor)


def gate_status(g: DataFrame, limit: float = 1.0, floor: float = 1e-5) -> DataFrame:
    r = F.col("ww0") / F.greatest("ww1", F.lit(1e-30))
    g = g.withColumn("ratio", r)
    status = (
        F.when((F.col("n_bad") > 0) | ~isfinite(F.col("ratio")), "FAIL")
        .when(F.col("ww1") < floor, "SKIP")
        .when(F.col("ratio") >= limit, "FAIL")
        .otherwise("OK")
    )
    return g.withColumn("status", status)


EXPECTED = ("rho", "u", "v", "w", "theta")


def missing_variables(columns: Sequence[str], expected: Sequence[str] = EXPECTED) -> list[str]:
    return [c for c in expected if c not in set(columns)]


def field_qa(cells: DataFrame, expected: Sequence[str] = EXPECTED) -> DataFrame:
    """Min, max, mean, NaN and Inf counts per dump and variable in one pass.

    Expected variables that the table lacks come out as rows with present=false.
    """
    have = [c for c in expected if c in cells.columns]
    pairs = [F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("x")) for c in have]
    pairs += [F.struct(F.lit(c).alias("var"), F.lit(None).cast("double").alias("x")) for c in missing_variables(cells.columns, expected)]
    long = cells.select("run_id", "step", F.explode(F.array(*pairs)).alias("p")).select("run_id", "step", "p.var", "p.x")
    x = F.when(isfinite(F.col("x")), F.col("x"))
    qa = long.groupBy("run_id", "step", "var").agg(
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.avg(x).alias("mean"),
        F.count_if(F.coalesce(F.isnan("x"), F.lit(False))).alias("n_nan"),
        F.count_if(F.coalesce(F.abs("x") == float("inf"), F.lit(False))).alias("n_inf"),
        (F.count("x") > 0).alias("present"),
    )
    bad = ~F.col("present") | (F.col("n_nan") + F.col("n_inf") > 0) | ((F.col("var") == "rho") & (F.col("lo") <= 0))
    return qa.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), "FAIL").otherwise("ok"))


def theta_delta(prof: DataFrame) -> DataFrame:
    """Potential-temperature change over the column of each dump."""
    return prof.groupBy("run_id", "step").agg((F.max_by("TH", "k") - F.min_by("TH", "k")).alias("theta_delta"))


def variance_ratio(cells: DataFrame, fields: Sequence[str] = ("u", "v", "w", "theta")) -> DataFrame:
    """k0/k1 variance ratio of every field per dump."""
    at = lambda v, k: F.var_pop(F.when(F.col("k") == k, F.col(v)))
    return cells.groupBy("run_id", "step").agg(*[(at(v, 0) / F.greatest(at(v, 1), F.lit(1e-30))).alias(f"ratio_{v}") for v in fields])


def lag1_autocorr(cells: DataFrame, value: str = "w") -> DataFrame:
    """Lag-1 spatial autocorrelation along x and y of each (run, step, k) plane.

    One shuffle by plane serves both line windows and the closing aggregate.
    """
    plane = ["run_id", "step", "k"]
    c = cells.select(*plane, "j", "i", F.col(value).alias("f")).repartition(*plane)
    c = c.withColumn("fx", neighbour("f", "i", Window.partitionBy(*plane, "j").orderBy("i"), -1))
    c = c.withColumn("fy", neighbour("f", "j", Window.partitionBy(*plane, "i").orderBy("j"), -1))

    def pair(p: str) -> list[Column]:
        both = F.when(F.col(p).isNotNull(), F.col("f"))
        return [
            F.sum(F.col("f") * F.col(p)).alias(f"s_{p}"),
            F.sum(both + F.col(p)).alias(f"t_{p}"),
            F.count(p).alias(f"n_{p}"),
        ]

    g = c.groupBy(*plane).agg(F.avg("f").alias("m"), F.var_pop("f").alias("var"), F.stddev_pop("f").alias("std"), *pair("fx"), *pair("fy"))

    def corr(p: str) -> Column:
        cov = ratio(F.col(f"s_{p}") - F.col("m") * F.col(f"t_{p}"), F.col(f"n_{p}")) + F.col("m") * F.col("m")
        return cov / F.greatest("var", F.lit(1e-30))

    return g.select(*plane, "std", corr("fx").alias("corr_x"), corr("fy").alias("corr_y"))


# --------------------------------------------------------------- dump history
def dump_history(cells: DataFrame, surface: DataFrame, dt: float) -> DataFrame:
    """One row per dump: column TKE and friction velocity, newest first in ``back``."""
    col = dump_profiles(cells).groupBy("run_id", "step").agg(F.avg("tke").alias("tke_col"), F.avg("E").alias("sgs_col"))
    h = col.join(surface_means(surface).select("run_id", "step", "us"), ["run_id", "step"])
    back = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("step").desc()))
    return h.withColumn("t_min", F.col("step") * dt / 60.0).withColumn("back", back)


def _trend(x: str, y: str, tag: str) -> list[Column]:
    return [F.regr_slope(y, x).alias(f"slope_{tag}"), F.regr_syy(y, x).alias(f"syy_{tag}"), F.regr_sxy(y, x).alias(f"sxy_{tag}")]


def trend_gate(history: DataFrame, tail: int = 6, need: int = 5) -> DataFrame:
    """Least-squares trend and its standard error over the newest dumps."""
    size = F.max("back").over(Window.partitionBy("run_id"))
    t = history.withColumn("size", size).where((F.col("size") >= need) & (F.col("back") <= tail))
    g = t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("us", "t_min").alias("sxx"), *_trend("t_min", "tke_col", "tke"), *_trend("t_min", "us", "us")
    )
    for tag in ("tke", "us"):
        ssr = F.greatest(F.col(f"syy_{tag}") - F.col(f"sxy_{tag}") * F.col(f"sxy_{tag}") / F.col("sxx"), F.lit(0.0))
        g = g.withColumn(f"se_{tag}", F.sqrt(ssr / (F.col("n") - 2) / F.col("sxx")))
        g = g.withColumn(f"sig_{tag}", F.when(F.col(f"se_{tag}") > 0, F.try_divide(f"slope_{tag}", f"se_{tag}")).otherwise(0.0))
    ok = (F.abs("sig_tke") < 2.0) & (F.abs("sig_us") < 2.0)
    return g.select("run_id", "n", "slope_tke", "se_tke", "sig_tke", "slope_us", "se_us", "sig_us", ok.alias("stationary"))


def plateau(history: DataFrame, tail: int = 4, tol: float = 0.05) -> DataFrame:
    t = history.where(F.col("back") <= tail)
    g = t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("tke_col", "step").alias("last"), F.min_by("tke_col", "step").alias("first"), F.avg("tke_col").alias("m")
    )
    drift = (F.col("last") - F.col("first")) / F.greatest(F.abs("m"), F.lit(1e-30))
    return g.where(F.col("n") >= tail).select("run_id", drift.alias("drift"), (F.abs(drift) < tol).alias("plateau"))


def momentum_ustar(prof: DataFrame) -> DataFrame:
    """u* from the lowest level's momentum flux."""
    q = F.pow(F.pow("uw", F.lit(2.0)) + F.pow("vw", F.lit(2.0)), F.lit(0.25))
    return prof.where(F.col("k") == 0).select("run_id", "step", q.alias("ustar_flux"))


def profile_peak(cells: DataFrame, surface: DataFrame) -> DataFrame:
    """Peak and vanishing height of sigma_w^2 / u*^2 in the newest dump."""
    prof, lv = dump_profiles(cells), levels_table(cells)
    newest = prof.groupBy("run_id").agg(F.max("step").alias("step"))
    p = prof.join(newest, ["run_id", "step"]).join(lv, ["run_id", "k"]).join(surface_means(surface), ["run_id", "step"])
    p = p.withColumn("n", F.col("ww") / F.greatest(F.col("us") * F.col("us"), F.lit(1e-30)))
    top = p.groupBy("run_id").agg(F.min(F.struct((-F.col("ww")).alias("s"), "k", "z", "n")).alias("m"))
    j = p.join(top, "run_id")
    return j.groupBy("run_id").agg(
        F.max("step").alias("step"),
        F.max("m.z").alias("z_peak"),
        F.max("m.n").alias("peak_ratio"),
        F.max(F.when(F.col("ww") > -0.05 * F.col("m.s"), F.col("z"))).alias("z_zero"),
        F.max(F.when(F.col("n") > 0.1, F.col("z"))).alias("z_proxy"),
    )


def convective_state(cells: DataFrame, surface: DataFrame, dt: float) -> DataFrame:
    """Inversion height, w*, entrainment ratio and TKE integral per dump."""
    lv = levels_table(cells)
    p = dump_profiles(cells).join(lv, ["run_id", "k"])
    w = Window.partitionBy("run_id", "step").orderBy("k")
    trap = 0.5 * (F.col("tke") + F.lag("tke").over(w)) * (F.col("z") - F.lag("z").over(w))
    g = p.withColumn("area", trap).groupBy("run_id", "step").agg(
        F.min(F.struct("wt", "k", "z")).alias("m"),
        F.min(F.struct("k", "wt", "TH")).alias("s"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("tke_int"),
    )
    j = g.join(surface_means(surface), ["run_id", "step"])
    wts = F.when(isfinite(F.col("hf")), F.col("hf")).otherwise(F.col("s.wt"))
    j = j.withColumn("wth_s", wts)
    ws = bl.convective_velocity(F.col("s.TH"), F.col("wth_s"), F.col("m.z"))
    floor = F.greatest("wth_s", F.lit(1e-9))
    j = j.withColumn("w_star", ws)
    return j.select(
        "run_id",
        "step",
        (F.col("step") * dt).alias("t"),
        F.col("m.z").alias("z_i"),
        "w_star",
        F.col("us").alias("ustar"),
        "wth_s",
        (-F.col("m.wt") / floor).alias("entrainment"),
        "tke_int",
        (-F.pow("us", F.lit(3.0)) * F.col("s.TH") / (KAPPA * G * floor)).alias("L"),
    )


def newest_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the newest n dumps of each run (one row per dump expected)."""
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc())
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def growth_rate(conv: DataFrame) -> DataFrame:
    """z_i growth [m/h] over the last 3 dumps, where at least 3 exist."""
    t = newest_rows(conv, 3).withColumn("hours", F.col("t") / 3600.0)
    g = t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("z_i", "hours").alias("growth"))
    return g.where(F.col("n") > 2).select("run_id", "growth")


def entrainment_gate(conv: DataFrame) -> DataFrame:
    last = newest_rows(conv)
    ok = F.col("entrainment").between(0.10, 0.35)
    return last.select("run_id", "step", "z_i", "wth_s", "entrainment", F.when(ok, "OK").otherwise("OUTSIDE").alias("gate"))


def lenschow_table(cells: DataFrame, surface: DataFrame, dt: float) -> DataFrame:
    """sigma_w/w* of the newest dump against the mixed-layer reference."""
    last = newest_rows(convective_state(cells, surface, dt)).select("run_id", "step", "z_i", "w_star")
    p = dump_profiles(cells).join(last, ["run_id", "step"]).join(levels_table(cells), ["run_id", "k"])
    zeta = F.col("z") / F.col("z_i")
    sw = F.sqrt(F.col("ww") + 2.0 / 3.0 * F.col("E")) / F.col("w_star")
    ref = bl.lenschow(zeta)
    return p.select(
        "run_id", "k", zeta.alias("zeta"), sw.alias("sw_over_ws"), ref.alias("lenschow"), (sw / F.greatest(ref, F.lit(1e-9))).alias("ratio")
    )


# -------------------------------------------------------------- sub-grid terms
def variance_floor_table(mean_prof: DataFrame, levels: DataFrame, stats: DataFrame) -> DataFrame:
    """Similarity-anchored sub-grid factor per level for the three target modes."""
    modes = F.explode(F.array(F.lit("surface"), F.lit("mixed"), F.lit("blend")))
    s = stats.select("run_id", "ustar", "h", "L", "ht_flux", "theta0")
    p = mean_prof.select("run_id", "k", "ww", "E").join(levels.select("run_id", "k", "z"), ["run_id", "k"]).join(s, "run_id").withColumn("mode", modes)
    z, h, L = F.col("z"), F.col("h"), F.col("L")
    p = p.withColumn("target", bl.sigma_w_target(z, h, L, F.col("ustar"), F.col("ht_flux"), F.col("theta0"), F.col("mode")))
    factor = bl.subgrid_multiplier(F.col("target"), F.col("ww"), F.col("E"), bl.near_ground(z, h))
    return p.select("run_id", "k", "z", "mode", bl.phi_w(bl.height_over_length(z, L)).alias("phi_w"), "target", factor.alias("factor"))


def vertical_gradient(cells: DataFrame, levels: DataFrame, values: Sequence[str]) -> DataFrame:
    """Second-order d/dz on uneven levels, one column at a time."""
    w = Window.partitionBy("run_id", "step", "j", "i").orderBy("k")
    c = cells.join(levels.select("run_id", "k", "z", "dz"), ["run_id", "k"])
    zm, zp = neighbour("z", "k", w, -1), neighbour("z", "k", w, 1)
    return c.withColumns(
        {f"d{v}_dz": geo.level_gradient(F.col(v), neighbour(v, "k", w, -1), neighbour(v, "k", w, 1), F.col("z"), zm, zp) for v in values}
    )


def subgrid_terms(cells: DataFrame, dx: float) -> DataFrame:
    """Dissipation and the gradient of the sub-grid variance for every cell."""
    lv = levels_table(cells)
    c = cells.withColumn("e", F.greatest("tke", F.lit(0.0))).withColumn("sig2", 2.0 / 3.0 * F.greatest("tke", F.lit(0.0)))
    g = vertical_gradient(c, lv, ["theta", "sig2"])
    eps = bl.dissipation(F.col("e"), F.col("theta"), F.col("dtheta_dz"), F.cbrt(dx * dx * F.col("dz")))
    return g.withColumn("eps", eps)


def _log_law(p: Column, z_ref: Column) -> Column:
    """Wind at a height over wind at ``z_ref``, both from the neutral log law; from 0 to 1."""
    z0 = F.greatest(F.col("z0"), F.lit(1e-4))
    share = F.try_divide(F.ln(F.greatest(p, 1.001 * z0) / z0), F.ln(z_ref / z0))
    return F.greatest(F.lit(0.0), F.least(share, F.lit(1.0)))


#: How a field goes on below the first level, as a share of its value there, and the least value it may have anywhere.
BELOW = {
    "u": (_log_law, None),
    "v": (_log_law, None),
    "w": (lambda p, z_ref: p / z_ref, None),
    "eps": (lambda p, z_ref: z_ref / p, 1e-8),
}


def sublayer(p: DataFrame, z_ref: Column) -> DataFrame:
    """Sampled fields by the rules of ``BELOW``, and the scaled sub-grid variance with its vertical derivative.

    Needs zagl, u, v, w, e, eps, ds2, z0, sc, dsc; ``sc`` is the variance
    multiplier at the point's height and ``dsc`` its vertical derivative. The variance is that of the level, so its
    derivative (the product rule of sc times 2/3 e, ``ds2`` being that of 2/3 e) is zero below it.
    """
    height = F.col("zagl")
    under = height < z_ref
    fields = {}
    for name, (rule, least) in BELOW.items():
        value = F.col(name) * F.when(under, rule(height, z_ref)).otherwise(F.lit(1.0))
        fields[name] = value if least is None else F.greatest(value, F.lit(least))
    base = F.col("e") * 2.0 / 3.0
    slope = base * F.col("dsc") + F.col("ds2") * F.col("sc")
    return p.withColumns({**fields, "sig2": F.greatest(base * F.col("sc"), F.lit(1e-6)), "ds2": F.when(~under, slope).otherwise(F.lit(0.0))})


def approach_rate(u: Column, v: Column, w: Column, zg_dx: Column, zg_dy: Column) -> Column:
    """Velocity normal to the sloping ground."""
    return w - u * zg_dx - v * zg_dy


def split_variance(sig2: Column, ratios: Sequence[float]) -> list[Column]:
    ru, rv, rw = bl.check_anisotropy(ratios)
    return [sig2 * ru, sig2 * rv, sig2 * rw]


# ------------------------------------------------------------- dump selection
def strided_steps(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th dump of each run in step order."""
    steps = cells.select("run_id", "step").distinct()
    r = F.row_number().over(Window.partitionBy("run_id").orderBy("step"))
    return steps.withColumn("r", r).where(F.pmod(F.col("r") - 1, F.lit(stride)) == 0).select("run_id", "step")
