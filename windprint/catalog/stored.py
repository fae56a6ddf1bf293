"""Queries over stored files: report texts, results by run, baselines; and columns, axes and tiles of the surface."""

from pyspark.sql import functions as F

from ..operators import climate, levels as lv, rasters
from ..plans import reports
from ..sources import sinks, text
from ..sources.shared_table import shared_folder
from .model import params
from .registry import ORACLES, cte, query
from .shared import DOM, frames, surface
from .surface import KEY

# ---- report texts ------------------------------------------------------------------------
HEAD, OTHER = "Footprint land-cover share of the window", "-- end of the table"


def report_files(t):
    """Reports written as text, a file for each of four tags, lines in the order of the events."""
    e = F.col("event_id")
    pct = lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    name = F.when(F.col("event_type") == "click", "solar array").otherwise(F.concat(F.lit("class"), (e % 7).cast("string")))
    row = F.concat(F.lit("  "), name, F.lit("  "), pct(e * 7 % 10000), F.lit("%  (domain area share  "), pct(e * 13 % 10000), F.lit("%)"))
    line = F.when((F.col("event_type") == "error") & (e % 3 == 0), HEAD).when((e % 401 == 0) | (e < 40), OTHER).otherwise(row)
    lines = t.raw("events").select((F.col("user_id") % 4).alias("tag"), e, line.alias("line"))
    folder = shared_folder(t.spark, "reports")
    lines.repartition("tag").sortWithinPartitions("tag", "event_id").select("tag", "line").write.partitionBy("tag").text(folder)
    return folder


@query(
    "cover_report",
    """WITH l AS (SELECT user_id % 4 AS tag, event_id AS e, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'h' WHEN event_id % 401 = 0 OR event_id < 40 THEN 'o' ELSE 'r' END AS kind,
      CASE WHEN event_type = 'click' THEN 'array' ELSE 'class' || (event_id % 7) END AS cover FROM events),
    h AS (SELECT tag, min(e) AS e0 FROM l WHERE kind = 'h' GROUP BY tag),
    s AS (SELECT tag, e0, min(CASE WHEN kind = 'o' AND e > e0 THEN e END) AS e1 FROM l JOIN h USING (tag) GROUP BY tag, e0)
    SELECT tag, cover, (e*7 % 10000)/100.0::DOUBLE AS share_pct, (e*13 % 10000)/100.0::DOUBLE AS area_pct FROM l JOIN s USING (tag) WHERE kind = 'r' AND e > e0 AND (e1 IS NULL OR e < e1)""",
)
def _(t):
    rows = text.cover_report(text.split_lines(t.spark, report_files(t)))
    tag = F.regexp_extract("path", r"tag=(\d+)", 1).cast("bigint")
    return rows.select(tag.alias("tag"), "cover", "share_pct", "area_pct")


# ---- results by run ------------------------------------------------------------------------
@query(
    "resumed_runs",
    """SELECT run_id, step, k, avg(u) AS "U", CASE WHEN run_id > 'r1' THEN var_pop(w) END AS ww FROM fx_cells GROUP BY run_id, step, k""",
    {"U": 8, "ww": 8},
)
def _(t):
    path = shared_folder(t.spark, "results")
    per = t.cells.groupBy("run_id", "step", "k")
    old, new = per.agg(F.avg("u").alias("U")), per.agg(F.avg("u").alias("U"), F.var_pop("w").alias("ww"))
    sinks.append_runs(old.where("run_id <= 'r1'"), path)  # runs of an older version, without the variance
    sinks.append_runs(new.where("run_id > 'r1' and k = 0"), path, mark=False)  # broken off, and incomplete
    sinks.append_runs(new, path)  # taken up again: finished runs are left alone
    sinks.append_runs(new, path)  # nothing is left to do
    return sinks.read_runs(t.spark, path).select("run_id", "step", "k", "U", "ww")


# ---- parts of the footprint as tables of their own, and the stored baseline -----------------
def parts(t):
    return reports.compute_footprint(t.touchdowns, t.releases, surface(t), DOM)


@query("footprint_conc", "SELECT run_id, j, i, conc/n_particles/576.0 AS f FROM cells_static JOIN frames USING (run_id)", {"f": 12})
def _(t):
    return parts(t)["concentration"].select("run_id", "j", "i", "f")


@query("footprint_cover", "SELECT * FROM cover_shares", {"share": 8, "share_nowrap": 8})
def _(t):
    return parts(t)["cover"]


def _same_as(name, of, digits):
    """Register ``name`` with the checking SQL of another query."""

    def wrap(fn):
        query(name, None, digits)(fn)
        ORACLES[name] = ORACLES[of]
        return fn

    return wrap


@_same_as("footprint_capture", "capture_curve", {"integral": 6, "frac": 6, "x80": 4})
def _(t):
    return parts(t)["capture"]


@_same_as("baseline_verdict", "regression_verdict", {"was": 6, "now": 6, "diff": 6, "tol": 6})
def _(t):
    was, now, floor = reports.regression_metrics(t.touchdowns, t.releases, params(t), DOM)
    path = shared_folder(t.spark, "baseline")
    sinks.propose(was.withColumn("value", F.col("value") * 3.0), path, 1)
    sinks.accept(t.spark, path, 1)
    sinks.propose(was.withColumn("value", F.col("value") + 1.0), path, 2)  # written wrongly, then again
    sinks.propose(was, path, 2)
    sinks.accept(t.spark, path, 2)
    sinks.propose(now, path, 3)  # not accepted
    return reports.against_baseline(t.spark, path, now, floor)


# ---- the whole report of a window ---------------------------------------------------------------
def _mask(src, frac, keys="run_id"):
    return f"""SELECT {keys}, j, i FROM (SELECT *, min(CASE WHEN c >= {frac}*tot THEN ord END) OVER (PARTITION BY {keys}) AS hit FROM (
      SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY g DESC RANGE UNBOUNDED PRECEDING) AS c, dense_rank() OVER (PARTITION BY {keys} ORDER BY g DESC) AS ord,
        sum(g) OVER (PARTITION BY {keys}) AS tot FROM (SELECT {keys}, j, i, f AS g FROM {src}))) WHERE ord <= hit AND tot > 0"""


def _metrics(src, name, keys="run_id"):
    ok = "CASE WHEN tot > 0 THEN {} END"
    return f"""SELECT *, sqrt({name}_centroid_e*{name}_centroid_e + {name}_centroid_n*{name}_centroid_n) AS {name}_centroid_dist, (degrees(atan2({name}_centroid_e, {name}_centroid_n)) + 360) % 360 AS {name}_centroid_bearing FROM (
      SELECT {keys}, tot*576.0::DOUBLE AS integral_{name}, {ok.format("fe/tot")} AS {name}_centroid_e, {ok.format("fn/tot")} AS {name}_centroid_n, n80*576.0::DOUBLE/1e4 AS {name}_area80_ha, n50*576.0::DOUBLE/1e4 AS {name}_area50_ha,
        {ok.format("pe")}::DOUBLE AS {name}_peak_e, {ok.format("pn")}::DOUBLE AS {name}_peak_n, {ok.format("pv")} AS {name}_peak_value
      FROM (SELECT {keys}, sum(f) AS tot, sum(f*(i-32)*24) AS fe, sum(f*(j-32)*24) AS fn FROM {src} GROUP BY {keys})
      JOIN (SELECT {keys}, f AS pv, (i-32)*24.0 AS pe, (j-32)*24.0 AS pn FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY f DESC, j, i) AS r FROM {src}) WHERE r = 1) USING ({keys})
      LEFT JOIN (SELECT {keys}, count(*) AS n80 FROM ({_mask(src, 0.8, keys)}) GROUP BY {keys}) USING ({keys})
      LEFT JOIN (SELECT {keys}, count(*) AS n50 FROM ({_mask(src, 0.5, keys)}) GROUP BY {keys}) USING ({keys}))"""


cte("wr_les", _metrics("fmap", "les"))
cte("wr_kl", _metrics("kl_map", "kljun"))
cte("wr_half", _metrics("fmap_half", "h", "run_id, half"))
cte("wr_pos", "SELECT run_id, j, i, greatest(f, 0) AS f FROM fmap")
cte("wr_m50", f"SELECT * FROM ({_mask('wr_pos', 0.5)}) UNION ALL SELECT * FROM ({_mask('kl_map', 0.5)})")
cte("wr_o50", """
SELECT run_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)/count(*) AS o FROM (SELECT run_id, j, i, count(*) AS n FROM wr_m50 GROUP BY ALL) GROUP BY run_id""")
_WR = {f"{n}_{c}": 4 for n in ("les", "kljun") for c in ("centroid_e", "centroid_n", "centroid_dist", "centroid_bearing", "area80_ha", "area50_ha", "peak_e", "peak_n")}


@query(
    "window_report",
    """WITH pk AS (SELECT run_id, xc AS px FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sm DESC, bin) AS r FROM fy_sm) WHERE r = 1),
    al AS (SELECT run_id, sum(wt_f) AS s, sum(CASE WHEN wrapped THEN wt_f ELSE 0 END) AS sw, count(*) AS n FROM wt GROUP BY run_id),
    hp AS (SELECT run_id, max(CASE WHEN half = 1 THEN peak_x END) - max(CASE WHEN half = 2 THEN peak_x END) AS d FROM fy_half_pk GROUP BY run_id),
    hc AS (SELECT run_id, max(CASE WHEN half = 1 THEN h_centroid_e END) - max(CASE WHEN half = 2 THEN h_centroid_e END) AS e, max(CASE WHEN half = 1 THEN h_centroid_n END) - max(CASE WHEN half = 2 THEN h_centroid_n END) AS n FROM wr_half GROUP BY run_id)
    SELECT f.run_id, f.n_particles, degrees(yaw) AS wind_angle, degrees(pitch) AS pitch, w_bar, w_bar*cos(pitch) - (u_bar*cos(yaw) + v_bar*sin(yaw))*sin(pitch) AS w_sf_mean, t_last - t_first AS rel_seconds,
      al.n AS n_touchdown, al.s/f.n_particles AS integral_les_all, sw/greatest(s, 1e-30) AS wrapped_fraction, l.* EXCLUDE (run_id), q.* EXCLUDE (run_id),
      CASE WHEN x.integral > 0 THEN px END::DOUBLE AS les_peak_x, CASE WHEN x.integral > 0 THEN mean_x END AS les_mean_x, CASE WHEN x.integral > 0 THEN x80 END AS les_x80,
      k.overlap AS overlap_kljun, wr_o50.o AS overlap50_kljun, h.overlap AS halves_overlap, hp.d::DOUBLE AS halves_dpeak, sqrt(hc.e*hc.e + hc.n*hc.n) AS halves_dcentroid
    FROM frames f JOIN al ON al.run_id = f.run_id JOIN wr_les l ON l.run_id = f.run_id JOIN wr_kl q ON q.run_id = f.run_id JOIN pk ON pk.run_id = f.run_id JOIN fy_x80 x ON x.run_id = f.run_id
    JOIN kl_overlap k ON k.run_id = f.run_id JOIN wr_o50 ON wr_o50.run_id = f.run_id JOIN half_overlap h ON h.run_id = f.run_id JOIN hp ON hp.run_id = f.run_id JOIN hc ON hc.run_id = f.run_id""",
    {**_WR, "wind_angle": 6, "pitch": 6, "w_bar": 8, "w_sf_mean": 8, "integral_les_all": 6, "wrapped_fraction": 8, "integral_les": 6, "integral_kljun": 6, "les_peak_value": 10, "kljun_peak_value": 10,
     "les_mean_x": 4, "les_x80": 4, "overlap_kljun": 9, "overlap50_kljun": 9, "halves_overlap": 9, "halves_dcentroid": 4},
)
def _(t):
    return reports.window_report(t.touchdowns, t.releases, params(t), DOM)


# ---- heights above ground over terrain -------------------------------------------------------
cte("gr", "SELECT run_id, j, i, ((j*3 + i*5) % 11)*1.5::DOUBLE AS zg FROM (SELECT DISTINCT run_id, j, i FROM fx_cells)")
cte("tcol", """
SELECT run_id, k, j, i, zg, z*(top - zg)/top + zg AS zc FROM gr JOIN lvl USING (run_id) JOIN (SELECT run_id, max(z) AS top FROM lvl GROUP BY run_id) USING (run_id)""")
cte("tlvl0", "SELECT run_id, k, avg(zc) - avg(zg) AS z FROM tcol GROUP BY run_id, k")
cte("tlvl", """
SELECT run_id, k, z, CASE WHEN a IS NULL THEN b - z WHEN b IS NULL THEN z - a ELSE (b - a)/2 END AS dz FROM (
  SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b FROM tlvl0 WINDOW w AS (PARTITION BY run_id ORDER BY k))""")
cte("tsgf", """
SELECT run_id, k, z, z/cbrt(576.0*dz) AS z_over_delta, 2.0/3.0*mE/greatest(ww + 2.0/3.0*mE, 1e-30) AS fraction FROM mprof JOIN tlvl USING (run_id, k)""")


def ground(t):
    zg = ((F.col("j") * 3 + F.col("i") * 5) % 11).cast("double") * 1.5
    return t.cells.select("run_id", "j", "i").distinct().withColumn("zg", zg)


def columns(t):
    return lv.terrain_columns(lv.levels_table(t.cells), ground(t))


@query(
    "above_ground",
    """WITH c AS (SELECT run_id, step, j, i, list(u ORDER BY k) AS us, list(w ORDER BY k) AS ws FROM fx_cells GROUP BY ALL),
    z AS (SELECT run_id, j, i, list(zc - zg ORDER BY k) AS zs FROM tcol GROUP BY ALL),
    q AS (SELECT *, unnest([5.0, 12.5, 40.0, 500.0])::DOUBLE AS h FROM c JOIN z USING (run_id, j, i)),
    p AS (SELECT *, least(greatest(len(list_filter(zs, lambda v: v <= h)), 1), len(zs) - 1) AS lo FROM q),
    f AS (SELECT *, least(greatest((h - zs[lo])/(zs[lo+1] - zs[lo]), 0), 1) AS a FROM p)
    SELECT run_id, step, j, i, h, CASE WHEN len(us) = len(zs) THEN us[lo] + (us[lo+1] - us[lo])*a END AS u, CASE WHEN len(us) = len(zs) THEN ws[lo] + (ws[lo+1] - ws[lo])*a END AS w FROM f""",
    {"u": 7, "w": 7},
)
def _(t):
    return lv.regrid_above_ground(t.cells, columns(t), (5.0, 12.5, 40.0, 500.0), ["u", "w"])


@query(
    "subgrid_gate_terrain",
    """WITH r AS (SELECT run_id, k AS k_r, fraction FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(z-30), k) AS n FROM tsgf) WHERE n = 1),
    a AS (SELECT run_id, list(fraction ORDER BY z_over_delta DESC) AS x, list(z_over_delta ORDER BY z_over_delta DESC) AS y FROM tsgf WHERE z > 0 GROUP BY 1),
    b AS (SELECT *, least(greatest(len(list_filter(x, lambda v: v <= 0.4)), 1), len(x) - 1) AS lo FROM a)
    SELECT run_id, k_r, fraction, CASE WHEN fraction < 0.4 THEN 'PASS' ELSE 'FAIL' END AS gate,
      y[lo] + (y[lo+1] - y[lo])*least(greatest((0.4 - x[lo])/(x[lo+1] - x[lo]), 0), 1) AS crossing FROM r JOIN b USING (run_id)""",
    {"fraction": 7, "crossing": 6},
)
def _(t):
    return lv.subgrid_gate(lv.subgrid_fraction(t.cells, 24.0, lv.mean_levels(columns(t))))


@query(
    "receptor_height",
    """SELECT run_id, j, i, k_r, zc AS z_r, zc - zg AS agl_r, zg FROM tcol JOIN (
      SELECT run_id, k AS k_r FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(z-30), k) AS n FROM lvl) WHERE n = 1) USING (run_id) WHERE k = k_r AND j = 3 AND i = 4""",
    {"z_r": 7, "agl_r": 7},
)
def _(t):
    at = [lv.receptor_column(F.lit(None), f, 8) for f in (0.375, 0.5)]
    return lv.receptor_height(columns(t), lv.levels_table(t.cells), 30.0, *at)


# ---- nearest cells, tiles -----------------------------------------------------------------------
cte("ax_x", "SELECT s_suppkey AS n, s_suppkey*90.0::DOUBLE + s_suppkey % 7 AS c FROM supplier")
cte("ax_y", "SELECT p_partkey AS n, p_partkey*13.0::DOUBLE + p_partkey % 5 AS c FROM part")
cte("ax_s", "SELECT c_custkey AS site, (c_custkey*7919 % 1200007)/100.0::DOUBLE AS x, (c_custkey*104729 % 3000017)/100.0::DOUBLE AS y FROM customer")


@query(
    "site_cells",
    """SELECT site, a.n AS ix, a.o AS dx, b.n AS iy, b.o AS dy FROM (
      SELECT site, n, c - x AS o FROM (SELECT site, x, n, c, row_number() OVER (PARTITION BY site ORDER BY abs(c - x), n) AS r FROM ax_s JOIN ax_x ON true) WHERE r = 1) a
      JOIN (SELECT site, n, c - y AS o FROM (SELECT site, y, n, c, row_number() OVER (PARTITION BY site ORDER BY abs(c - y), n) AS r FROM ax_s JOIN ax_y ON true) WHERE r = 1) b USING (site)""",
    {"dx": 6, "dy": 6},
)
def _(t):
    axis = lambda table, key, step, m: t.raw(table).select(F.col(key).alias("n"), (F.col(key) * step + F.col(key) % m).cast("double").alias("c"))
    k = F.col("c_custkey")
    sites = t.raw("customer").select(k.alias("site"), ((k * 7919 % 1200007).cast("double") / 100.0).alias("x"), ((k * 104729 % 3000017).cast("double") / 100.0).alias("y"))
    x = climate.nearest_cells(sites, axis("supplier", "s_suppkey", 90.0, 7), "site", "x", "c", "n", 5000.0)
    y = climate.nearest_cells(sites, axis("part", "p_partkey", 13.0, 5), "site", "y", "c", "n", 5000.0)
    return x.select("site", F.col("n").alias("ix"), F.col("offset").alias("dx")).join(y.select("site", F.col("n").alias("iy"), F.col("offset").alias("dy")), "site")


VIEW = (-300.0, 2100.0, -900.0, 900.0)


@query(
    "tiled_masks",
    """WITH r AS (SELECT run_id, CAST(substr(run_id, 2) AS BIGINT) AS site, yaw AS ang FROM frames),
    c AS (SELECT run_id, tj, ti, water, "array", ((ti*64 + i) - 32)*24.0::DOUBLE AS dx, ((tj*64 + j) - 32)*24.0::DOUBLE AS dy, cos(ang) AS ca, sin(ang) AS sa
      FROM r JOIN srf USING (site), (SELECT unnest([-1, 0, 1]) AS tj) a, (SELECT unnest([-1, 0, 1]) AS ti) b),
    w AS (SELECT *, -(dx*ca + dy*sa) AS x, dy*ca - dx*sa AS y FROM c)
    SELECT run_id, tj, ti, count(*) AS n, count(*) FILTER (WHERE water) AS n_water, count(*) FILTER (WHERE "array") AS n_array, sum(x) AS sx, sum(y) AS sy
    FROM w WHERE x BETWEEN -300 AND 2100 AND y BETWEEN -900 AND 900 GROUP BY run_id, tj, ti""",
    {"sx": 4, "sy": 4},
)
def _(t):
    runs = frames(t).select("run_id", F.expr("cast(substring(run_id, 2) as bigint)").alias("site"), F.col("yaw").alias("ang"))
    m = rasters.tiled_masks(runs, surface(t).select(*KEY, "water", "array"), ["site"], DOM, VIEW)
    return m.groupBy("run_id", "tj", "ti").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("water").alias("n_water"), F.count_if("array").alias("n_array"), F.sum("x").alias("sx"), F.sum("y").alias("sy")
    )
