"""Raster family."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import interp, levels as lv, rasters
from ..operators.interp import Axis
from ..sources.fixtures import PLANE
from .registry import cte, query
from .shared import DOM, frames, surface

KEY = ["site", "j", "i"]


def elevation(t):
    return rasters.resample_mean(t.pixels, KEY, "elevation")


@query("resample_avg", "SELECT site, j, i, mean, spread, n_pixels FROM elev", {"mean": 7, "spread": 7})
def _(t):
    return elevation(t)


@query("resample_mode", "SELECT * FROM lc_mode")
def _(t):
    return rasters.resample_mode(t.pixels, KEY, "lcclass")


@query("class_lookup", "SELECT site, j, i, lcclass, z0m, ht_flux FROM srf", {"z0m": 6, "ht_flux": 6})
def _(t):
    lc = rasters.resample_mode(t.pixels, KEY, "lcclass")
    return rasters.classify(lc, DOM).select(*KEY, "lcclass", "z0m", "ht_flux")


@query(
    "array_override",
    """SELECT site, count(*) FILTER (WHERE "array") AS n_array, count(*) FILTER (WHERE water) AS n_water, count(*) FILTER (WHERE lcclass = 80 AND "array") AS n_both,
      count(*) FILTER (WHERE lcclass = 40 AND NOT "array") AS n_crop, count(*) AS n_cells,
      count(*) FILTER (WHERE abs((i-32)*24 - 150*sin(radians(20))) <= 60 AND abs((j-32)*24 - 150*cos(radians(20))) <= 175 AND NOT water) AS n_patch FROM srf GROUP BY site""",
)
def _(t):
    patch = rasters.in_bearing_patch(DOM.xc(F.col("i")), DOM.yc(F.col("j")), 20.0, 150.0, 120.0, 350.0)
    c = rasters.classify(rasters.resample_mode(t.pixels, KEY, "lcclass"), DOM)
    return c.groupBy("site").agg(
        F.count_if("array").alias("n_array"),
        F.count_if("water").alias("n_water"),
        F.count_if((F.col("lcclass") == 80) & F.col("array")).alias("n_both"),
        F.count_if((F.col("lcclass") == 40) & ~F.col("array")).alias("n_crop"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(patch & ~F.col("water")).alias("n_patch"),
    )


@query("taper", "SELECT site, j, i, datum, topo FROM tapered", {"datum": 7, "topo": 7})
def _(t):
    return rasters.taper_terrain(elevation(t), ["site"], "mean", DOM, 8).select(*KEY, "datum", "topo")


@query("smooth121", "SELECT site, j, i, topo FROM smooth_i", {"topo": 7})
def _(t):
    topo = rasters.taper_terrain(elevation(t), ["site"], "mean", DOM, 8).select(*KEY, "topo")
    return rasters.smooth121(topo, ["site"], "topo", 1)


cte("slope0", """
SELECT *, CASE WHEN im IS NULL THEN (ip - topo)/24 WHEN ip IS NULL THEN (topo - im)/24 ELSE (ip - im)/48 END AS gx,
  CASE WHEN jm IS NULL THEN (jp - topo)/24 WHEN jp IS NULL THEN (topo - jm)/24 ELSE (jp - jm)/48 END AS gy
FROM (SELECT *, lag(topo) OVER a AS im, lead(topo) OVER a AS ip, lag(topo) OVER b AS jm, lead(topo) OVER b AS jp FROM smooth_i
  WINDOW a AS (PARTITION BY site, j ORDER BY i), b AS (PARTITION BY site, i ORDER BY j))""")
cte("slope_q", """
SELECT site, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90, quantile_cont(s, 0.99) AS p99, max(s) AS max_slope,
  sqrt(1 + pow(max(s)*24/8.558, 2)) AS cfl_amplification FROM (SELECT site, sqrt(gx*gx + gy*gy) AS s FROM slope0) GROUP BY site""")


def slopes(t):
    topo = rasters.taper_terrain(elevation(t), ["site"], "mean", DOM, 8).select(*KEY, "topo")
    return rasters.edge_slope(rasters.smooth121(topo, ["site"], "topo", 1), ["site"], "topo", DOM.dx)


@query("slope_quantiles", "SELECT site, p50, p90, p99, max_slope FROM slope_q", {c: 6 for c in ("p50", "p90", "p99", "max_slope")})
def _(t):
    return rasters.slope_quantiles(slopes(t), ["site"], DOM.dx, 8.558).drop("cfl_amplification")


@query("slope_cfl", "SELECT site, sqrt(1 + pow(sqrt(gx*gx + gy*gy)*24/8.558, 2)) AS amp, j, i FROM slope0", {"amp": 6})
def _(t):
    return slopes(t).select("site", F.sqrt(1.0 + F.pow(F.col("slope") * DOM.dx / 8.558, F.lit(2.0))).alias("amp"), "j", "i")


@query("class_histogram", """
SELECT site, lcclass, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER (PARTITION BY site) AS pct,
  row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, lcclass)::INTEGER AS place FROM lc_mode GROUP BY site, lcclass""", {"pct": 6})
def _(t):
    return rasters.class_histogram(rasters.resample_mode(t.pixels, KEY, "lcclass"), ["site"])


cte("water_cells", """
SELECT e.*, coalesce(spread < 0.02 AND abs(mean - level) < 1, false) AS water, level FROM elev e
LEFT JOIN (SELECT site, median(mean) AS level FROM elev WHERE spread < 0.02 GROUP BY site) l ON l.site = e.site""")


@query("water_mask", "SELECT site, j, i, mean, level, water FROM water_cells", {"mean": 7, "level": 7})
def _(t):
    return rasters.water_from_spread(elevation(t), ["site"]).select(*KEY, "mean", "level", "water")


@query(
    "raster_qa",
    """WITH b AS (SELECT site, min(mean) AS lo, max(mean) AS hi, max(mean) - min(mean) AS relief,
        avg(CASE WHEN i < 32 THEN CASE WHEN water THEN 1.0::DOUBLE ELSE 0 END END) AS water_west, count(*) FILTER (WHERE water) AS n_water FROM water_cells GROUP BY site),
    x AS (SELECT site, max(abs(a.mean - b.mean)) AS seam_x FROM (SELECT * FROM elev WHERE i = 0) a JOIN (SELECT * FROM elev WHERE i = 63) b USING (site, j) GROUP BY site),
    y AS (SELECT site, max(abs(a.mean - b.mean)) AS seam_y FROM (SELECT * FROM elev WHERE j = 0) a JOIN (SELECT * FROM elev WHERE j = 63) b USING (site, i) GROUP BY site)
    SELECT * FROM b JOIN x USING (site) JOIN y USING (site)""",
    {c: 6 for c in ("lo", "hi", "relief", "water_west", "seam_x", "seam_y")},
)
def _(t):
    return rasters.raster_qa(rasters.water_from_spread(elevation(t), ["site"]), ["site"], "mean", DOM)


cte("gk", "SELECT d, exp(-0.5*d*d)/sum(exp(-0.5*d*d)) OVER () AS kk FROM (SELECT unnest(range(-4, 5)) AS d)")
cte("gs_j", """
SELECT t.site, t.j, t.i, sum(kk*s.mean) AS v FROM elev t CROSS JOIN gk
JOIN elev s ON s.site = t.site AND s.i = t.i AND s.j = CASE WHEN t.j + d < 0 THEN -(t.j + d) - 1 WHEN t.j + d > 63 THEN 127 - (t.j + d) ELSE t.j + d END GROUP BY ALL""")


@query("gaussian_smooth", """
SELECT t.site, t.j, t.i, sum(kk*s.v) AS mean FROM gs_j t CROSS JOIN gk
JOIN gs_j s ON s.site = t.site AND s.j = t.j AND s.i = CASE WHEN t.i + d < 0 THEN -(t.i + d) - 1 WHEN t.i + d > 63 THEN 127 - (t.i + d) ELSE t.i + d END GROUP BY ALL""", {"mean": 6})
def _(t):
    return rasters.gaussian_smooth(elevation(t), ["site"], "mean", DOM)


# ---- points ---------------------------------------------------------------------
def points(t):
    k = F.col("o_orderkey")
    site = F.floor(k / 15000).cast("bigint")
    return t.raw("orders").select(
        site.alias("site"), k.alias("pid"), ((k * 37 % 6700 - 150).cast("double") / 100.0).alias("fi"), ((k * 53 % 6700 - 150).cast("double") / 100.0).alias("fj")
    )


cte("pts", """
SELECT o_orderkey // 15000 AS site, o_orderkey AS pid, CAST((o_orderkey*37) % 6700 - 150 AS DOUBLE)/100 AS fi, CAST((o_orderkey*53) % 6700 - 150 AS DOUBLE)/100 AS fj FROM orders""")
cte("pt_ext", """
SELECT *, least(greatest(CAST(floor(fi) AS BIGINT), 0), 62) AS i0, least(greatest(CAST(floor(fj) AS BIGINT), 0), 62) AS j0 FROM pts""")


@query(
    "bilinear_sample",
    """SELECT p.site, pid, (1 - (fj-j0))*(1 - (fi-i0))*a.mean + (1 - (fj-j0))*(fi-i0)*b.mean + (fj-j0)*(1 - (fi-i0))*c.mean + (fj-j0)*(fi-i0)*d.mean AS mean
    FROM pt_ext p JOIN elev a ON a.site = p.site AND a.j = j0 AND a.i = i0 JOIN elev b ON b.site = p.site AND b.j = j0 AND b.i = i0 + 1
    JOIN elev c ON c.site = p.site AND c.j = j0 + 1 AND c.i = i0 JOIN elev d ON d.site = p.site AND d.j = j0 + 1 AND d.i = i0 + 1""",
    {"mean": 7},
)
def _(t):
    axes = [Axis("fj", "j", DOM.ny, "extrapolate"), Axis("fi", "i", DOM.nx, "extrapolate")]
    return interp.interpolate(points(t), elevation(t), ["site"], "pid", axes, ["mean"])


cte("pslope", """
SELECT c.site, c.j, c.i, c.topo, (e.topo - w.topo)/48 AS zg_dx, (n.topo - s.topo)/48 AS zg_dy FROM srf c
JOIN srf e ON e.site = c.site AND e.j = c.j AND e.i = (c.i + 1) % 64 JOIN srf w ON w.site = c.site AND w.j = c.j AND w.i = (c.i + 63) % 64
JOIN srf n ON n.site = c.site AND n.i = c.i AND n.j = (c.j + 1) % 64 JOIN srf s ON s.site = c.site AND s.i = c.i AND s.j = (c.j + 63) % 64""")
cte("pt_wrap", """
SELECT *, CAST(floor(fi) AS BIGINT) AS i0, CAST(floor(fj) AS BIGINT) AS j0 FROM pts""")


@query(
    "ground_slope",
    """SELECT p.site, pid, sum(w*topo) AS topo, sum(w*zg_dx) AS zg_dx, sum(w*zg_dy) AS zg_dy FROM (
      SELECT site, pid, (j0 + dj + 64) % 64 AS j, (i0 + di + 64) % 64 AS i,
        CASE WHEN di = 1 THEN fi - i0 ELSE 1 - (fi - i0) END * CASE WHEN dj = 1 THEN fj - j0 ELSE 1 - (fj - j0) END AS w
      FROM pt_wrap, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) p JOIN pslope s ON s.site = p.site AND s.j = p.j AND s.i = p.i GROUP BY p.site, pid""",
    {"topo": 6, "zg_dx": 7, "zg_dy": 7},
)
def _(t):
    g = rasters.periodic_slope(surface(t), ["site"], "topo", DOM)
    axes = [Axis("fj", "j", DOM.ny, "wrap"), Axis("fi", "i", DOM.nx, "wrap")]
    return interp.interpolate(points(t), g, ["site"], "pid", axes, ["topo", "zg_dx", "zg_dy"])


# ---- rays -----------------------------------------------------------------------
def rays(t):
    f = frames(t)
    return f.select("run_id", F.expr("cast(substring(run_id, 2) as bigint)").alias("site"), geo.met_direction(F.col("u_bar"), F.col("v_bar")).alias("wdir"))


RMAX = 1200.0
cte("ray", """
SELECT run_id, site, n, d, ((CAST(round_even(32 + d*sin(radians(wdir))/24, 0) AS BIGINT) % 64) + 64) % 64 AS i,
  ((CAST(round_even(32 + d*cos(radians(wdir))/24, 0) AS BIGINT) % 64) + 64) % 64 AS j FROM (
  SELECT run_id, CAST(substr(run_id, 2) AS BIGINT) AS site, ((270 - degrees(atan2(v_bar, u_bar))) % 360 + 360) % 360 AS wdir, n, n*12.0::DOUBLE AS d
  FROM frames CROSS JOIN (SELECT unnest(range(0, 103))::INTEGER AS n))""")
cte("tran", "SELECT r.run_id, r.n, r.d, topo, z0m, lcclass FROM ray r JOIN srf s ON s.site = r.site AND s.j = r.j AND s.i = r.i")


@query("transect", "SELECT * FROM tran", {"topo": 7, "z0m": 6})
def _(t):
    return rasters.transect(rays(t), surface(t), DOM, RMAX).select("run_id", "n", "d", "topo", "z0m", "lcclass")


_RUNS = """
WITH g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) - row_number() OVER (PARTITION BY run_id, lcclass ORDER BY n) AS isl FROM tran),
r AS (SELECT run_id, lcclass, isl, min(n) AS f, min(d) AS d0, count(*) AS c FROM g GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, lcclass ORDER BY c DESC, f) AS q FROM r),
m AS (SELECT run_id, max(d) AS dm FROM tran GROUP BY run_id)
SELECT run_id, lcclass, c*12.0::DOUBLE AS length, 0.5::DOUBLE*(d0 + least(d0 + c*12, dm)) AS label_at FROM b JOIN m USING (run_id) WHERE q = 1 AND c*12 >= 130"""


@query("longest_run", _RUNS)
def _(t):
    return rasters.longest_run(rasters.transect(rays(t), surface(t), DOM, RMAX), ["run_id"], DOM.dx / 2.0)


@query(
    "transect_report",
    f"""SELECT t.run_id, t.lcclass, count(*) AS n, avg(topo) AS topo, avg(z0m) AS z0m, any_value(length) AS length, any_value(label_at) AS label_at
    FROM tran t LEFT JOIN ({_RUNS}) l ON l.run_id = t.run_id AND l.lcclass = t.lcclass GROUP BY t.run_id, t.lcclass""",
    {"topo": 6, "z0m": 6},
)
def _(t):
    from ..plans import reports

    return reports.transect_report(rays(t), surface(t), DOM, RMAX)


# ---- flow rotation, terrain-following heights --------------------------------------
_ROT = """
SELECT run_id, step, k, CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN i WHEN 2 THEN (8 - j) % 8 WHEN 3 THEN (8 - i) % 8 ELSE j END AS j,
  CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN (8 - j) % 8 WHEN 2 THEN (8 - i) % 8 WHEN 3 THEN j ELSE i END AS i,
  CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN -v WHEN 2 THEN -u WHEN 3 THEN v ELSE u END AS u,
  CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN u WHEN 2 THEN -v WHEN 3 THEN -u ELSE v END AS v, w FROM fx_cells"""
TURNS = "cast(substring(run_id, 2) as bigint)"


@query("rotate_flow", _ROT, {"u": 7, "v": 7, "w": 7})
def _(t):
    rasters.require_square(PLANE, PLANE)
    return rasters.rotate_cells(t.cells, PLANE, F.expr(TURNS)).select("run_id", "step", "k", "j", "i", "u", "v", "w")


cte("geo_cells", """
SELECT c.run_id, c.step, c.k, c.j, c.i, z AS z_flat, z_top, (c.i + 2*c.j)/10.0::DOUBLE + c.step/100.0::DOUBLE AS zg FROM fx_cells c JOIN lvl l ON l.run_id = c.run_id AND l.k = c.k
JOIN (SELECT run_id, max(z) AS z_top FROM lvl GROUP BY run_id) m ON m.run_id = c.run_id""")


@query(
    "terrain_height",
    """SELECT run_id, step, k, j, i, z_flat*(z_top - zg)/z_top + zg AS z, (z_flat*(z_top - zg)/z_top)*z_top/greatest(z_top - zg, 1e-12) AS z_back,
      abs((z_flat*(z_top - zg)/z_top)*z_top/greatest(z_top - zg, 1e-12) - z_flat) > 1e-3 AS bad FROM geo_cells""",
    {"z": 6, "z_back": 6},
)
def _(t):
    l = lv.levels_table(t.cells).select("run_id", "k", F.col("z").alias("z_flat"))
    top = l.groupBy("run_id").agg(F.max("z_flat").alias("z_top"))
    zg = (F.col("i") + 2 * F.col("j")).cast("double") / 10.0 + F.col("step").cast("double") / 100.0
    c = t.cells.select("run_id", "step", "k", "j", "i", zg.alias("zg")).join(l.join(top, "run_id"), ["run_id", "k"])
    c = c.withColumn("z", geo.terrain_height(F.col("z_flat"), F.col("zg"), F.col("z_top")))
    back = geo.terrain_level(F.col("z"), F.col("zg"), F.col("z_top"))
    return c.select("run_id", "step", "k", "j", "i", "z", back.alias("z_back"), (F.abs(back - F.col("z_flat")) > 1e-3).alias("bad"))


@query(
    "forcing_vector",
    """SELECT run_id, CAST(substr(run_id, 2) AS BIGINT) % 4 AS turns, ug, vg, (degrees(atan2(-ug, -vg)) + 360) % 360 AS wind_from FROM (
      SELECT run_id, CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN -v0 WHEN 2 THEN -u0 WHEN 3 THEN v0 ELSE u0 END AS ug,
        CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 1 THEN u0 WHEN 2 THEN -v0 WHEN 3 THEN -u0 ELSE v0 END AS vg
      FROM (SELECT run_id, avg(u) AS u0, avg(v) AS v0 FROM fx_cells GROUP BY run_id))""",
    {"ug": 6, "vg": 6, "wind_from": 5},
)
def _(t):
    m = t.cells.groupBy("run_id").agg(F.avg("u").alias("u0"), F.avg("v").alias("v0")).withColumn("turns", F.expr(f"{TURNS} % 4"))
    ug, vg = geo.quarter_turn_vector(F.col("u0"), F.col("v0"), F.col("turns"))
    m = m.withColumns({"ug": ug, "vg": vg})
    return m.select("run_id", "turns", "ug", "vg", geo.pmod_(F.degrees(F.atan2(-F.col("ug"), -F.col("vg"))), 360.0).alias("wind_from"))


@query(
    "aligned_cells",
    """SELECT run_id, j, i, (i-32)*24*ex - (j-32)*24*ey AS x, (i-32)*24*ey + (j-32)*24*ex AS y FROM (
      SELECT run_id, s.j, s.i, sin(radians((wdir + 180) % 360)) AS ex, cos(radians((wdir + 180) % 360)) AS ey FROM (
        SELECT run_id, CAST(substr(run_id, 2) AS BIGINT) AS site, ((270 - degrees(atan2(v_bar, u_bar))) % 360 + 360) % 360 AS wdir FROM frames) r JOIN srf s ON s.site = r.site)""",
    {"x": 5, "y": 5},
)
def _(t):
    c = surface(t).select(*KEY).join(rays(t), "site")
    x, y = geo.aligned_offset(DOM.xc(F.col("i")), DOM.yc(F.col("j")), F.col("wdir"))
    return c.select("run_id", "j", "i", x.alias("x"), y.alias("y"))


@query("surface_build", 'SELECT site, j, i, topo, z0m, ht_flux, water, "array", lcclass FROM srf', {"topo": 7, "z0m": 6, "ht_flux": 6})
def _(t):
    return surface(t).select(*KEY, "topo", "z0m", "ht_flux", "water", "array", "lcclass")


@query(
    "restart_tables",
    f"""SELECT r.*, z*(z_top - zg)/z_top + zg AS z_new, z0m, least(z0m, 0.01) AS z0t FROM ({_ROT}) r JOIN lvl l ON l.run_id = r.run_id AND l.k = r.k
    JOIN (SELECT run_id, max(z) AS z_top FROM lvl GROUP BY run_id) m ON m.run_id = r.run_id
    JOIN (SELECT run_id, step, j, i, z0m, 10*z0m AS zg FROM fx_surface_dumps) s ON s.run_id = r.run_id AND s.step = r.step AND s.j = r.j AND s.i = r.i""",
    {"u": 7, "v": 7, "w": 7, "z_new": 6, "z0m": 7, "z0t": 7},
)
def _(t):
    from ..plans import reports

    s = t.surface_dumps.select("run_id", "step", "j", "i", "z0m", (10.0 * F.col("z0m")).alias("zg"))
    return reports.restart_tables(t.cells, lv.levels_table(t.cells), s, PLANE, F.expr(TURNS))
