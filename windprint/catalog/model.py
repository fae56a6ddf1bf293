"""Closed-form reference model and comparisons with the measured footprint."""

from pyspark.sql import functions as F

from ..functions import geometry as geo, kljun
from ..operators import compare, footprint as fp, rasters, reference_model as rm
from ..sources.shared_table import materialize
from .footprint import fy
from .registry import cte, query
from .shared import DOM, RUN, frames, static_map, surface, weighted

RECT = (rasters.ARRAY_WEST, rasters.ARRAY_EAST, rasters.ARRAY_SOUTH, rasters.ARRAY_NORTH)


def params(t):
    """Per-run surface-layer scalars for the model, from the release means."""
    f = frames(t)
    u = F.hypot("u_bar", "v_bar")
    kind = F.substring("run_id", 1, 1)
    return f.select(
        "run_id",
        "yaw",
        "n_particles",
        F.lit(30.0).alias("zm"),
        (700.0 + 100.0 * F.col("w_bar")).alias("h"),
        u.alias("u_mean"),
        geo.met_direction(F.col("u_bar"), F.col("v_bar")).alias("wdir"),
        (0.05 + 0.06 * u).alias("ustar"),
        (0.5 + F.abs("w_bar")).alias("sigma_v"),
        F.when(kind == "F", -80.0).when(kind == "O", float("inf")).otherwise(120.0).alias("L"),
        F.lit(0.05).alias("z0"),
    )


cte("par0", """
SELECT run_id, yaw, n_particles, 30.0::DOUBLE AS zm, 700 + 100*w_bar AS h, sqrt(u_bar*u_bar + v_bar*v_bar) AS u_mean,
  ((270 - degrees(atan2(v_bar, u_bar))) % 360 + 360) % 360 AS wdir, 0.5 + abs(w_bar) AS sigma_v,
  CASE substr(run_id, 1, 1) WHEN 'F' THEN -80.0::DOUBLE WHEN 'O' THEN 'inf'::DOUBLE ELSE 120.0::DOUBLE END AS ll FROM frames""")
cte("par", """
SELECT *, 0.05 + 0.06*u_mean AS ustar, 0.4*u_mean/(0.05 + 0.06*u_mean) AS p4, 30/(1 - 30/h)*0.4*u_mean/(0.05 + 0.06*u_mean) AS sc,
  CASE WHEN NOT isfinite(ll) OR abs(ll) > 1e5 THEN 0.8 ELSE least(1, 1e-5/abs(30/ll) + CASE WHEN ll <= 0 THEN 0.8 ELSE 0.55 END) END AS ps1
FROM par0""")


def fy_sql(x):
    return f"CASE WHEN ({x})/sc > 0.1359 THEN 1.4524*pow(greatest(({x})/sc - 0.1359, 1e-300), -1.9914)*exp(-1.4622/greatest(({x})/sc - 0.1359, 1e-300)) ELSE 0 END/sc"


def sy_sql(x):
    return f"2.17*sqrt(1.66*pow(greatest(({x})/sc, 0), 2)/(1 + 20*greatest(({x})/sc, 0)))*30*sigma_v/(ustar*ps1)"


def erf_sql(x):
    t = f"(1/(1 + 0.3275911*abs({x})))"
    return f"sign({x})*(1 - (((((1.061405429*{t} - 1.453152027)*{t} + 1.421413741)*{t} - 0.284496736)*{t} + 0.254829592)*{t})*exp(-({x})*({x})))"


cte("along", f"""
SELECT run_id, n, x, {fy_sql('x')} AS fy, {sy_sql('x')} AS sigma_y FROM (
  SELECT *, n*24.0::DOUBLE AS x FROM par CROSS JOIN (SELECT unnest(range(1, 129))::INTEGER AS n))""")


@query("kljun_fy", "SELECT run_id, n, x, fy FROM along", {"fy": 10})
def _(t):
    return rm.along_wind(params(t), DOM.dx, 128).select("run_id", "n", "x", "fy")


@query("kljun_sigma_y", "SELECT run_id, n, x, sigma_y FROM along", {"sigma_y": 6})
def _(t):
    return rm.along_wind(params(t), DOM.dx, 128).select("run_id", "n", "x", "sigma_y")


@query("kljun_peak", "SELECT run_id, p4, (1.4622/1.9914 + 0.1359)*sc AS x_max, 30*exp(-p4) AS z0_implied FROM par", {"p4": 6, "x_max": 5, "z0_implied": 8})
def _(t):
    return rm.peaks(params(t))


cte("psi_in", """
SELECT event_id AS rec, (((event_id*31) % 4001) - 3000)/1000.0::DOUBLE AS zl FROM events""")


def psi_sql(zl):
    chi = f"pow(greatest(1 - 19*({zl}), 0), 0.25)"
    return f"CASE WHEN ({zl}) > 0 THEN -5.3*({zl}) WHEN ({zl}) < 0 THEN ln((1 + {chi}*{chi})/2) + 2*ln((1 + {chi})/2) - 2*atan({chi}) + pi()/2 ELSE 0 END"


@query(
    "psi_m",
    f"SELECT rec, zl, psi, ln(30/0.05) - psi AS pi4 FROM (SELECT rec, zl, {psi_sql('zl')} AS psi FROM psi_in)",
    {"psi": 7, "pi4": 7},
)
def _(t):
    e = t.raw("events").select(F.col("event_id").alias("rec"), ((F.col("event_id") * 31 % 4001 - 3000).cast("double") / 1000.0).alias("zl"))
    L = F.coalesce(F.try_divide(F.lit(30.0), F.col("zl")), F.lit(float("inf")))
    psi = kljun.psi_m(F.lit(30.0), L)
    return e.select("rec", "zl", psi.alias("psi"), kljun.pi4(F.lit(30.0), F.lit(1.0), None, F.lit(0.05), L).alias("pi4"))


cte("ci", f"""
SELECT run_id, n, m, fy*0.5*(({erf_sql('hi/(sqrt(2)*sy)')}) - ({erf_sql('lo/(sqrt(2)*sy)')}))/24 AS f, fy*exp(-(lo+12)*(lo+12)/(2*sy*sy))/(sqrt(2*pi())*sy) AS f_centre FROM (
  SELECT run_id, n, m, fy, greatest(sigma_y, 1e-6) AS sy, m*24.0::DOUBLE AS lo, m*24.0::DOUBLE + 24 AS hi
  FROM along CROSS JOIN (SELECT unnest(range(-8, 8))::INTEGER AS m) WHERE n <= 64)""")


@query("kljun_cell_integrated", "SELECT * FROM ci", {"f": 11, "f_centre": 11})
def _(t):
    return rm.cell_integrated(params(t), DOM.dx, 64, 8)


cte("kl_sub", """
SELECT run_id, j, i, sc, ustar, sigma_v, ps1, yaw, (i - 32 + (si + 0.5)/8 - 0.5)*24 AS ex, (j - 32 + (sj + 0.5)/8 - 0.5)*24 AS nn FROM par
CROSS JOIN (SELECT unnest(range(0, 64)) AS j) CROSS JOIN (SELECT unnest(range(0, 64)) AS i)
CROSS JOIN (SELECT unnest(range(0, 8)) AS sj) CROSS JOIN (SELECT unnest(range(0, 8)) AS si)""")
cte("kl_map", f"""
SELECT run_id, j, i, avg(fy*exp(-y*y/(2*sy*sy))/(sqrt(2*pi())*sy)) AS f FROM (
  SELECT run_id, j, i, y, {fy_sql('x')} AS fy, greatest({sy_sql('x')}, 1e-6) AS sy FROM (
    SELECT *, -(ex*cos(yaw) + nn*sin(yaw)) AS x, nn*cos(yaw) - ex*sin(yaw) AS y FROM kl_sub)) GROUP BY run_id, j, i""")


@query("kljun_static_raster", "SELECT run_id, j, i, f FROM kl_map", {"f": 12})
def _(t):
    return rm.static_raster(params(t), DOM)


cte("chords", """
SELECT run_id, wdir, greatest(least(CASE WHEN abs(sin(radians(wdir))) >= 1e-9 THEN CASE WHEN sin(radians(wdir)) > 0 THEN 60 ELSE -60 END/sin(radians(wdir)) END,
  CASE WHEN abs(cos(radians(wdir))) >= 1e-9 THEN CASE WHEN cos(radians(wdir)) > 0 THEN 250 ELSE -100 END/cos(radians(wdir)) END), 0) AS chord FROM par""")


@query("chord", "SELECT * FROM chords", {"wdir": 6, "chord": 6})
def _(t):
    return params(t).select("run_id", "wdir", geo.chord(F.col("wdir"), *RECT).alias("chord"))


cte("pshare", f"""
SELECT p.run_id, p.wdir, chord, 100*kl AS kljun_cum, cf AS crosswind, 100*kl*cf AS pred_kljun, 100*share_nowrap AS measured, 100*les*cf AS pred_les FROM (
  SELECT *, {erf_sql('60/greatest(sqrt(2)*sy, 1e-6)')} AS cf FROM (SELECT par.*, chord, {sy_sql('greatest(chord/2, 1)')} AS sy FROM par JOIN chords USING (run_id))) p
JOIN (SELECT run_id, sum(CASE WHEN x <= ceil(greatest(chord, 1)) THEN f ELSE 0 END)/sum(f) AS kl FROM (
  SELECT run_id, x, chord, {fy_sql('x')} AS f FROM par JOIN chords USING (run_id) CROSS JOIN (SELECT unnest(range(1, 6000)) AS x)) GROUP BY run_id) k ON k.run_id = p.run_id
JOIN (SELECT run_id, max(CASE WHEN xc <= chord AND x1 > chord THEN c + (c1 - c)*(chord - xc)/(x1 - xc) END) AS les FROM fy_cum JOIN chords USING (run_id) GROUP BY run_id) l
  ON l.run_id = p.run_id
LEFT JOIN (SELECT * FROM cover_shares WHERE cover = 'solar array') s ON s.run_id = p.run_id""")


@query("predicted_share", "SELECT * FROM pshare", {"wdir": 6, "chord": 6, "kljun_cum": 6, "crosswind": 7, "pred_kljun": 6, "measured": 6, "pred_les": 6})
def _(t):
    w = weighted(t)
    measured = fp.cover_share(w, surface(t)).where(F.col("cover") == "solar array").select("run_id", F.col("share_nowrap").alias("share"))
    return rm.predicted_share(params(t), fy(t), measured, RECT)


cte("case_shares", """
SELECT substr(run_id, 2) AS site, cover, substr(run_id, 1, 1) AS kase, coalesce(share_nowrap, 0) AS share FROM cover_shares""")


def case_shares(t, srf):
    s = fp.cover_share(weighted(t), srf)
    return s.select(
        F.expr("substring(run_id, 2)").alias("site"), "cover", F.substring("run_id", 1, 1).alias("case"), F.coalesce("share_nowrap", F.lit(0.0)).alias("share")
    )


@query(
    "swing",
    """WITH m AS (SELECT site::VARCHAR AS site, count(*) AS n FROM srf GROUP BY 1),
    c AS (SELECT site, 'water' AS cover FROM srf WHERE water UNION ALL SELECT site, 'solar array' FROM srf WHERE "array" UNION ALL SELECT site, 'class ' || lcclass FROM srf WHERE NOT "array"),
    a AS (SELECT c.site::VARCHAR AS site, cover, count(*)/any_value(n)::DOUBLE AS area FROM c JOIN m ON m.site = c.site::VARCHAR GROUP BY ALL),
    g AS (SELECT site, cover, max(share) AS hi, arg_min(kase, (-share, kase)) AS hc, min(share) AS lo, arg_min(kase, (share, kase)) AS lc FROM case_shares GROUP BY site, cover)
    SELECT site, cover, hi AS max_share, hc AS max_case, lo AS min_share, lc AS min_case, hi/greatest(lo, 1e-4) AS swing, hi/nullif(area, 0) AS enrich_best,
      lo/nullif(area, 0) AS enrich_worst FROM g JOIN a USING (site, cover)""",
    {"max_share": 7, "min_share": 7, "swing": 5, "enrich_best": 6, "enrich_worst": 6},
)
def _(t):
    srf = materialize(surface(t).select("site", "j", "i", "lcclass", "array", "water"), "surface")
    cells = srf.select(F.col("site").cast("string").alias("site"), fp.cover_classes().alias("names"))
    whole = cells.groupBy("site").agg(F.count(F.lit(1)).alias("cells"))
    area = cells.select("site", F.explode("names").alias("cover")).groupBy("site", "cover").agg(F.count(F.lit(1)).alias("n"))
    area = area.join(whole, "site").select("site", "cover", (F.col("n") / F.col("cells")).alias("area_share"))
    return compare.swing(case_shares(t, srf), ["site", "cover"], area)


@query(
    "pair_ratio",
    """SELECT a.site, a.cover, a.kase || '/' || b.kase AS pair, a.share/greatest(b.share, 1e-9) AS ratio_share FROM case_shares a JOIN case_shares b USING (site, cover)
    WHERE (a.kase, b.kase) IN (('F', 'O'), ('F', 'P'), ('P', 'O'))""",
    {"ratio_share": 5},
)
def _(t):
    return compare.pair_ratio(case_shares(t, surface(t)), ["site", "cover"], "case", [("F", "O"), ("F", "P"), ("P", "O")], ["share"])


# ---- report: measured and modelled footprint side by side -----------------------
def _mask_sql(src):
    return f"""SELECT run_id, j, i FROM (
      SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id) AS hit FROM (
        SELECT *, sum(g) OVER (PARTITION BY run_id ORDER BY g DESC RANGE UNBOUNDED PRECEDING) AS c,
          dense_rank() OVER (PARTITION BY run_id ORDER BY g DESC) AS ord, sum(g) OVER (PARTITION BY run_id) AS tot
        FROM (SELECT run_id, j, i, greatest(f, 0) AS g FROM {src}))) WHERE ord <= hit AND tot > 0"""


cte("mask_les", _mask_sql("fmap"))
cte("mask_kl", _mask_sql("kl_map"))
cte("kl_overlap", """
SELECT run_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)/count(*) AS overlap FROM (
  SELECT run_id, j, i, count(*) AS n FROM (SELECT * FROM mask_les UNION ALL SELECT * FROM mask_kl) GROUP BY ALL) GROUP BY run_id""")


@query("overlap_model", "SELECT * FROM kl_overlap", {"overlap": 9})
def _(t):
    return fp.overlap(static_map(t), rm.static_raster(params(t), DOM), RUN)


@query(
    "footprint_report",
    """WITH km AS (SELECT run_id, sum(f)*576 AS integral_kljun FROM kl_map GROUP BY run_id),
    pk AS (SELECT run_id, xc AS peak_x FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sm DESC, bin) AS r FROM fy_sm) WHERE r = 1),
    kp AS (SELECT run_id, (1.4622/1.9914 + 0.1359)*sc AS peak_kljun FROM par),
    wf AS (SELECT run_id, sum(CASE WHEN wrapped THEN wt_f ELSE 0 END)/greatest(sum(wt_f), 1e-30) AS wrapped_fraction FROM wt GROUP BY run_id)
    SELECT m.run_id, n_particles, m.area80_ha, m.centroid_dist, m.centroid_bearing, m.integral AS integral_les, integral_kljun,
      CASE WHEN fx.integral > 0 THEN peak_x END::DOUBLE AS peak_x, peak_kljun, CASE WHEN fx.integral > 0 THEN x80 END AS x80, k.overlap AS overlap_kljun,
      h.overlap AS overlap_halves, wrapped_fraction
    FROM map_metrics_sql m JOIN frames USING (run_id) JOIN km USING (run_id) JOIN pk USING (run_id) JOIN kp USING (run_id) JOIN fy_x80 fx USING (run_id)
    JOIN kl_overlap k USING (run_id) JOIN half_overlap h USING (run_id) JOIN wf USING (run_id)""",
    {"area80_ha": 4, "centroid_dist": 4, "centroid_bearing": 4, "integral_les": 6, "integral_kljun": 6, "peak_kljun": 4, "x80": 4, "overlap_kljun": 9, "overlap_halves": 9, "wrapped_fraction": 8},
)
def _(t):
    from ..plans import reports

    return reports.footprint_report(t.touchdowns, t.releases, params(t), DOM)


@query(
    "flat_vs_terrain",
    f"""WITH mt AS ({_mask_sql('(SELECT * FROM fmap_half WHERE half = 2)')}), mf AS ({_mask_sql('(SELECT * FROM fmap_half WHERE half = 1)')}),
    ov AS (SELECT run_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)/count(*) AS overlap FROM (
      SELECT run_id, j, i, count(*) AS n FROM (SELECT * FROM mt UNION ALL SELECT * FROM mf) GROUP BY ALL) GROUP BY run_id),
    bx AS (SELECT run_id, sum(CASE WHEN half = 1 THEN f ELSE 0 END)*576 AS box_flat, sum(CASE WHEN half = 2 THEN f ELSE 0 END)*576 AS box_terrain
      FROM fmap_half WHERE (i - 32.5)*24 >= 165 AND (i - 32.5)*24 < 285 AND (j - 32.5)*24 >= -195 AND (j - 32.5)*24 < 195 GROUP BY run_id),
    tt AS (SELECT run_id, sum(CASE WHEN half = 1 THEN f ELSE 0 END)*576 AS integral_flat, sum(CASE WHEN half = 2 THEN f ELSE 0 END)*576 AS integral_terrain
      FROM fmap_half GROUP BY run_id)
    SELECT run_id, integral_flat, integral_terrain, box_flat, box_terrain, box_terrain/greatest(box_flat, 1e-12) AS ratio, overlap
    FROM tt JOIN bx USING (run_id) JOIN ov USING (run_id)""",
    {"integral_flat": 6, "integral_terrain": 6, "box_flat": 7, "box_terrain": 7, "ratio": 3, "overlap": 9},
)
def _(t):
    from ..plans import reports
    from .shared import half, half_maps

    maps = half_maps(t)
    return reports.flat_vs_terrain(half(maps, 1), half(maps, 2), DOM, (165.0, 285.0, -195.0, 195.0))


BOXES = (("array", -60.0, 60.0, -100.0, 250.0), ("upwind", -768.0, 0.0, -768.0, 768.0), ("overlapping", -300.0, 100.0, 0.0, 300.0))


@query(
    "box_contribution",
    """WITH b(box, x0, x1, y0, y1) AS (VALUES ('array', -60, 60, -100, 250), ('upwind', -768, 0, -768, 768), ('overlapping', -300, 100, 0, 300))
    SELECT run_id, box, sum(f)*576 AS contribution FROM fmap JOIN b ON (i-32.5)*24 >= x0 AND (i-32.5)*24 < x1 AND (j-32.5)*24 >= y0 AND (j-32.5)*24 < y1 GROUP BY ALL""",
    {"contribution": 7},
)
def _(t):
    e = (-0.5 - DOM.i_r) * DOM.dx
    return rasters.box_contribution(static_map(t), RUN, BOXES, e, e, DOM.dx)


@query(
    "surface_effect",
    """WITH u AS (SELECT run_id, half, j, i, f/sum(f) OVER (PARTITION BY run_id, half) AS f FROM fmap_half)
    SELECT run_id, j, i, coalesce(b.f, 0) - coalesce(a.f, 0) AS diff FROM (SELECT * FROM u WHERE half = 1) a FULL OUTER JOIN (SELECT * FROM u WHERE half = 2) b USING (run_id, j, i)""",
    {"diff": 7},
)
def _(t):
    from .shared import half, half_maps

    maps = half_maps(t)
    return compare.aligned_difference(half(maps, 1), half(maps, 2), RUN)


cte("fy_half", """
SELECT run_id, half, bin, (bin - 63)*24.0 AS xc, coalesce(s, 0)/n/24.0 AS f FROM (SELECT run_id, half, n, bin FROM half_n CROSS JOIN bins)
LEFT JOIN (SELECT run_id, half, CAST(floor(x_up/24.0 - 0.5) AS BIGINT) + 64 AS bin, sum(wt_f) AS s FROM wt GROUP BY ALL) USING (run_id, half, bin)""")
cte("fy_half_pk", """
SELECT run_id, half, CASE WHEN tot > 0 THEN xc END AS peak_x FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, half ORDER BY sm DESC, bin) AS r FROM (
    SELECT *, sum(f) OVER (PARTITION BY run_id, half ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5 AS sm, sum(f) OVER (PARTITION BY run_id, half) AS tot FROM fy_half))
WHERE r = 1""")


cte("h1_area", """
SELECT run_id, j, i FROM (SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id) AS hit FROM (
  SELECT *, sum(f) OVER (PARTITION BY run_id ORDER BY f DESC RANGE UNBOUNDED PRECEDING) AS c, dense_rank() OVER (PARTITION BY run_id ORDER BY f DESC) AS ord,
    sum(f) OVER (PARTITION BY run_id) AS tot FROM fmap_half WHERE half = 1)) WHERE ord <= hit AND tot > 0""")


@query(
    "regression_verdict",
    """WITH pk AS (SELECT run_id, xc AS px FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sm DESC, bin) AS r FROM fy_sm) WHERE r = 1),
    pkf AS (SELECT run_id, CASE WHEN integral > 0 THEN px END AS px FROM pk JOIN fy_x80 USING (run_id)),
    h AS (SELECT run_id, max(CASE WHEN half = 1 THEN peak_x END) AS p1, max(CASE WHEN half = 2 THEN peak_x END) AS p2 FROM fy_half_pk GROUP BY run_id),
    h1 AS (SELECT run_id, sum(f)*576 AS int1 FROM fmap_half WHERE half = 1 GROUP BY run_id),
    cur AS (SELECT run_id, 'peak_x' AS metric, px::DOUBLE AS now FROM pkf UNION ALL SELECT run_id, 'integral', integral FROM map_metrics_sql UNION ALL SELECT run_id, 'overlap', overlap FROM kl_overlap
      UNION ALL SELECT run_id, 'area80_ha', area80_ha FROM map_metrics_sql),
    bas AS (SELECT run_id, 'peak_x' AS metric, p1::DOUBLE AS was FROM h UNION ALL SELECT run_id, 'integral', int1 FROM h1 UNION ALL SELECT run_id, 'overlap', overlap FROM half_overlap
      UNION ALL SELECT run_id, 'area80_ha', n80*576.0::DOUBLE/1e4 FROM h1 LEFT JOIN (SELECT run_id, count(*) AS n80 FROM h1_area GROUP BY run_id) USING (run_id)),
    j AS (SELECT run_id, metric, was, now, CASE metric WHEN 'peak_x' THEN greatest(2.5*abs(coalesce(p1 - p2, 0)), 48.0) WHEN 'integral' THEN 0.08 WHEN 'area80_ha' THEN greatest(0.35*was, 5) ELSE 0.15 END::DOUBLE AS tol
      FROM bas FULL OUTER JOIN cur USING (run_id, metric) JOIN h USING (run_id))
    SELECT run_id, metric, was, now, now - was AS diff, tol, CASE WHEN coalesce(abs(now - was) <= tol, false) THEN 'ok' ELSE 'CHANGED' END AS status FROM j""",
    {"was": 6, "now": 6, "diff": 6, "tol": 6},
)
def _(t):
    from ..plans import reports

    return reports.regression(t.touchdowns, t.releases, params(t), DOM)
