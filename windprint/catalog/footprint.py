"""Footprint family."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import footprint as fp
from .registry import cte, query
from .shared import DOM, RUN, frames, half, half_maps, static_map, surface, weighted

SUBS, SUB_SECONDS, T_FIRST = 18, 100.0, 900.0
WX, WY, WRES, WNX, WNY = -600.0, -1500.0, 60.0, 85, 50
VARIANTS = (0.01, 0.02, 0.05)


@query(
    "touchdown_weights",
    "SELECT run_id, particle, td_x, td_y, td_age, wt_c, wt_f, x_up, y_cross FROM wt",
    {"wt_c": 6, "wt_f": 6, "x_up": 5, "y_cross": 5},
)
def _(t):
    return weighted(t).select("run_id", "particle", "td_x", "td_y", "td_age", "wt_c", "wt_f", "x_up", "y_cross")


@query(
    "fold_cells",
    """SELECT run_id, jj, ii, wrapped, count(*) AS n, sum(xm) AS sum_xm, sum(ym) AS sum_ym, min(fi) AS min_fi, max(fj) AS max_fj
    FROM wt GROUP BY run_id, jj, ii, wrapped""",
    {"sum_xm": 4, "sum_ym": 4, "min_fi": 6, "max_fj": 6},
)
def _(t):
    return weighted(t).groupBy("run_id", "jj", "ii", "wrapped").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("xm").alias("sum_xm"),
        F.sum("ym").alias("sum_ym"),
        F.min("fi").alias("min_fi"),
        F.max("fj").alias("max_fj"),
    )


@query("deposit_cic", "SELECT * FROM cells_static", {"flux": 6, "conc": 8})
def _(t):
    return fp.deposit_static(weighted(t), DOM)


@query(
    "deposit_ngp",
    """SELECT run_id, j, i, sum(wt_f) AS flux, sum(wt_c) AS conc FROM (
      SELECT run_id, wt_f, wt_c, CASE WHEN ym = 756 THEN 63 ELSE CAST(floor((ym + 780)/24) AS BIGINT) END AS j,
        CASE WHEN xm = 756 THEN 63 ELSE CAST(floor((xm + 780)/24) AS BIGINT) END AS i FROM wt)
    WHERE j BETWEEN 0 AND 63 AND i BETWEEN 0 AND 63 GROUP BY ALL""",
    {"flux": 6, "conc": 6},
)
def _(t):
    e = (-0.5 - DOM.i_r) * DOM.dx
    return fp.deposit_nearest(weighted(t), RUN, F.col("xm"), F.col("ym"), e, e, DOM.dx, DOM.nx, DOM.ny)


@query("footprint_density", "SELECT run_id, j, i, f FROM fmap", {"f": 12})
def _(t):
    return static_map(t)


def _area_sql(frac):
    return f"""SELECT run_id, j, i, f FROM (
      SELECT *, min(CASE WHEN c >= {frac}*tot THEN ord END) OVER (PARTITION BY run_id) AS hit FROM (
        SELECT *, sum(f) OVER (PARTITION BY run_id ORDER BY f DESC RANGE UNBOUNDED PRECEDING) AS c,
          dense_rank() OVER (PARTITION BY run_id ORDER BY f DESC) AS ord,
          sum(f) OVER (PARTITION BY run_id) AS tot FROM fmap))
    WHERE ord <= hit AND tot > 0"""


for _name, _frac in (("source_area_80", 0.8), ("source_area_50", 0.5)):
    query(_name, _area_sql(_frac), {"f": 12})(
        lambda t, frac=_frac: fp.source_area(static_map(t), RUN, frac).select("run_id", "j", "i", "f")
    )

cte("area80", _area_sql(0.8))
cte("area50", _area_sql(0.5))
cte("map_base", """
SELECT run_id, sum(f) AS tot, sum(f*(i-32)*24) AS fe, sum(f*(j-32)*24) AS fn FROM fmap GROUP BY run_id""")
cte("map_peak", """
SELECT run_id, f AS peak_value, (i-32)*24.0 AS peak_e, (j-32)*24.0 AS peak_n FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f DESC, j, i) AS r FROM fmap) WHERE r = 1""")
cte("map_metrics_sql", """
SELECT run_id, fe/tp AS centroid_e, fn/tp AS centroid_n, sqrt((fe/tp)*(fe/tp) + (fn/tp)*(fn/tp)) AS centroid_dist,
  (degrees(atan2(fe/tp, fn/tp)) + 360) % 360 AS centroid_bearing,
  coalesce(n80, 0) AS area80_cells, n80*576.0::DOUBLE/1e4 AS area80_ha, n50*576.0::DOUBLE/1e4 AS area50_ha,
  CASE WHEN tot > 0 THEN peak_e END::DOUBLE AS peak_e, CASE WHEN tot > 0 THEN peak_n END::DOUBLE AS peak_n, CASE WHEN tot > 0 THEN peak_value END AS peak_value,
  tot*576.0::DOUBLE AS integral
FROM (SELECT *, CASE WHEN tot > 0 THEN tot END AS tp FROM map_base) JOIN map_peak USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n80 FROM area80 GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n50 FROM area50 GROUP BY 1) USING (run_id)""")
MAP_DIGITS = {
    "centroid_e": 4,
    "centroid_n": 4,
    "centroid_dist": 4,
    "centroid_bearing": 4,
    "area80_ha": 4,
    "area50_ha": 4,
    "peak_value": 12,
    "integral": 6,
}


@query("map_metrics", "SELECT * FROM map_metrics_sql", MAP_DIGITS)
def _(t):
    return fp.map_metrics(static_map(t), RUN, DOM)


# ---- wind-frame map ---------------------------------------------------------
cte("wcic0", """
SELECT run_id, t_release, wt_f, (x_up + 600)/60.0 - 0.5 AS cu, (y_cross + 1500)/60.0 - 0.5 AS cv FROM wt""")
cte("wcic", """
SELECT run_id, t_release, ((CAST(floor(cv) AS BIGINT) + dj) % 50 + 50) % 50 AS j,
  ((CAST(floor(cu) AS BIGINT) + di) % 85 + 85) % 85 AS i,
  wt_f * CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END
       * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END AS f
FROM wcic0, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)""")
cte("wmap", """
SELECT run_id, j, i, sum(f)/any_value(n_particles)/3600.0 AS f FROM wcic JOIN frames USING (run_id) GROUP BY ALL""")


def wind_map(t, keys=RUN, totals=None, w=None):
    cells = fp.deposit_cic(w if w is not None else weighted(t), keys, F.col("x_up"), F.col("y_cross"), WX, WY, WRES, WNX, WNY)
    return fp.density(cells, totals if totals is not None else frames(t), keys, WRES * WRES)


@query(
    "wind_metrics",
    """WITH cum AS (
      SELECT *, sum(f) OVER (PARTITION BY run_id ORDER BY f DESC RANGE UNBOUNDED PRECEDING) AS c,
        dense_rank() OVER (PARTITION BY run_id ORDER BY f DESC) AS ord, sum(f) OVER (PARTITION BY run_id) AS tot FROM wmap),
    msk AS (SELECT * FROM (SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id) AS hit FROM cum) WHERE ord <= hit),
    ar AS (SELECT run_id, min(-570.0 + i*60) AS x80_near, max(-570.0 + i*60) AS x80_far, count(*) AS area80_cells, min(f) AS thr80
      FROM msk GROUP BY 1),
    col AS (SELECT run_id, i, sum(f) AS fy FROM wmap GROUP BY ALL),
    pk AS (SELECT run_id, -570.0 + i*60 AS peak_x FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fy DESC, i) AS r FROM col) WHERE r = 1),
    mo AS (SELECT run_id, sum(f*(-570.0 + i*60))/sum(f) AS centroid_x, sum(f*(-1470.0 + j*60))/sum(f) AS centroid_y FROM wmap GROUP BY 1)
    SELECT run_id, CASE WHEN t > 0 THEN peak_x END::DOUBLE AS peak_x, CASE WHEN t > 0 THEN centroid_x END AS centroid_x, CASE WHEN t > 0 THEN centroid_y END AS centroid_y,
      CASE WHEN t > 0 THEN x80_near END::DOUBLE AS x80_near, CASE WHEN t > 0 THEN x80_far END::DOUBLE AS x80_far, CASE WHEN t > 0 THEN area80_cells ELSE 0 END AS area80_cells,
      CASE WHEN t > 0 THEN thr80 END AS thr80
    FROM pk JOIN mo USING (run_id) LEFT JOIN ar USING (run_id) JOIN (SELECT run_id, sum(f) AS t FROM wmap GROUP BY run_id) USING (run_id)""",
    {"centroid_x": 4, "centroid_y": 4, "thr80": 12},
)
def _(t):
    return fp.wind_metrics(wind_map(t), RUN, WX, WY, WRES)


# ---- f_y --------------------------------------------------------------------
def fy(t):
    return fp.fy_histogram(weighted(t), frames(t), RUN, DOM)


cte("bins", "SELECT unnest(range(0, 128)) AS bin")
cte("fy0", """
SELECT run_id, CAST(floor(x_up/24.0 - 0.5) AS BIGINT) + 64 AS bin, td_age, wt_f FROM wt""")
cte("fy", """
SELECT run_id, bin, (bin - 63)*24.0 AS xc, coalesce(s, 0)/n_particles/24.0 AS f
FROM (SELECT run_id, n_particles, bin FROM frames CROSS JOIN bins)
LEFT JOIN (SELECT run_id, bin, sum(wt_f) AS s FROM fy0 GROUP BY ALL) USING (run_id, bin)""")
cte("fy_sm", """
SELECT *, sum(f) OVER (PARTITION BY run_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5.0 AS sm FROM fy""")
cte("fy_cum", """
SELECT *, lead(c) OVER (PARTITION BY run_id ORDER BY bin) AS c1, lead(xc) OVER (PARTITION BY run_id ORDER BY bin) AS x1 FROM (
  SELECT *, sum(greatest(f, 0)) OVER (PARTITION BY run_id ORDER BY bin) / sum(greatest(f, 0)) OVER (PARTITION BY run_id) AS c FROM fy)""")
cte("fy_x80", """
SELECT run_id, coalesce(max(CASE WHEN c <= 0.8 AND c1 > 0.8 THEN xc + (x1 - xc)*(0.8 - c)/(c1 - c) END), min(xc)) AS x80,
  sum(greatest(f, 0)*xc)/sum(greatest(f, 0)) AS mean_x, sum(f)*24.0 AS integral FROM fy_cum GROUP BY run_id""")


@query("fy_hist", "SELECT run_id, bin, xc::DOUBLE AS xc, f FROM fy", {"f": 9})
def _(t):
    return fy(t)


@query("fy_smooth_peak", """
SELECT run_id, arg_max(xc, ord)::DOUBLE AS peak_x, max(sm) AS peak_f FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sm, bin DESC) AS ord FROM fy_sm) GROUP BY run_id""", {"peak_f": 9})
def _(t):
    s = fp.fy_smooth(fy(t), RUN)
    return s.groupBy("run_id").agg(
        F.min(F.struct((-F.col("sm")).alias("s"), "bin", "xc"))["xc"].alias("peak_x"), F.max("sm").alias("peak_f")
    )


@query("fy_x80", "SELECT run_id, CASE WHEN integral > 0 THEN mean_x END AS mean_x, CASE WHEN integral > 0 THEN x80 END AS x80, greatest(integral, 0) AS integral FROM fy_x80", {"mean_x": 4, "x80": 4, "integral": 6})
def _(t):
    return fp.fy_metrics(fy(t), RUN, DOM.dx).select("run_id", "mean_x", "x80", "integral")


@query(
    "capture_curve",
    """WITH m AS (SELECT unnest([300.0, 450.0, 600.0, 750.0, 900.0])::DOUBLE AS mark),
    sp AS (SELECT run_id, n_particles, mark, bin FROM frames CROSS JOIN m CROSS JOIN bins),
    s AS (SELECT run_id, mark, bin, sum(wt_f) AS s FROM fy0 JOIN m ON td_age <= mark GROUP BY ALL),
    g AS (SELECT run_id, mark, bin, (bin - 63)*24.0 AS xc, coalesce(s, 0)/n_particles/24.0 AS f FROM sp LEFT JOIN s USING (run_id, mark, bin)),
    sm AS (SELECT *, sum(f) OVER (PARTITION BY run_id, mark ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5 AS sm,
       sum(greatest(f, 0)) OVER (PARTITION BY run_id, mark ORDER BY bin)/sum(greatest(f, 0)) OVER (PARTITION BY run_id, mark) AS c FROM g),
    l AS (SELECT *, lead(c) OVER w AS c1, lead(xc) OVER w AS x1 FROM sm WINDOW w AS (PARTITION BY run_id, mark ORDER BY bin)),
    k AS (SELECT run_id, mark, sum(f) > 0 AS ok, coalesce(max(CASE WHEN c <= 0.8 AND c1 > 0.8 THEN xc + (x1-xc)*(0.8-c)/(c1-c) END), min(xc)) AS x80
       FROM l GROUP BY ALL),
    p AS (SELECT run_id, mark, xc AS peak_x FROM (SELECT *, row_number() OVER (PARTITION BY run_id, mark ORDER BY sm DESC, bin) AS r FROM sm) WHERE r = 1),
    i AS (SELECT run_id, mark, sum(CASE WHEN td_age <= mark THEN wt_f ELSE 0 END) / any_value(n_particles) AS integral
       FROM wt JOIN frames USING (run_id), m GROUP BY ALL)
    SELECT run_id, mark, integral, integral / greatest(max(CASE WHEN mark = 900 THEN integral END) OVER (PARTITION BY run_id), 1e-12) AS frac,
      CASE WHEN ok THEN peak_x END::DOUBLE AS peak_x, CASE WHEN ok THEN x80 END AS x80
    FROM i JOIN k USING (run_id, mark) JOIN p USING (run_id, mark)""",
    {"integral": 6, "frac": 6, "x80": 4},
)
def _(t):
    return fp.capture_curve(weighted(t), frames(t), DOM)


@query(
    "by_displacement",
    """SELECT run_id, 1536.0::DOUBLE*fr AS max_disp, fr AS frac_of_lx,
      sum(CASE WHEN disp <= fr*1536.0 THEN wt_f ELSE 0 END)/any_value(n_particles) AS integral
    FROM wt JOIN frames USING (run_id), (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0])::DOUBLE AS fr) GROUP BY ALL""",
    {"integral": 6},
)
def _(t):
    return fp.by_displacement(weighted(t), frames(t), DOM)


cte("cover_hits", """
SELECT run_id, wt_f, wrapped, unnest(list_filter([CASE WHEN water THEN 'water' END, CASE WHEN "array" THEN 'solar array' END,
  CASE WHEN NOT "array" THEN 'class ' || lcclass END], lambda x: x IS NOT NULL)) AS cover
FROM wt JOIN srf ON srf.site = wt.site AND srf.j = wt.jj AND srf.i = wt.ii""")
cte("cover_shares", """
SELECT run_id, cover, any_value(s)/any_value(t) AS share, any_value(s_nw)/any_value(t_nw) AS share_nowrap FROM (
  SELECT run_id, cover, sum(wt_f) AS s, sum(CASE WHEN NOT wrapped THEN wt_f ELSE 0 END) AS s_nw FROM cover_hits GROUP BY ALL)
JOIN (SELECT run_id, sum(wt_f) AS t, sum(CASE WHEN NOT wrapped THEN wt_f ELSE 0 END) AS t_nw FROM wt GROUP BY ALL) USING (run_id)
GROUP BY ALL""")


@query("cover_share", "SELECT * FROM cover_shares", {"share": 8, "share_nowrap": 8})
def _(t):
    return fp.cover_share(weighted(t), surface(t), frames(t))


@query(
    "wrapped_fraction",
    """SELECT run_id, sum(CASE WHEN wrapped THEN wt_f ELSE 0 END)/greatest(sum(wt_f), 1e-30) AS wrapped_fraction, count(*) AS n_touchdown
    FROM wt GROUP BY run_id""",
    {"wrapped_fraction": 8},
)
def _(t):
    return fp.wrapped_fraction(weighted(t), frames(t))


@query("split_halves", "SELECT run_id, half, j, i, f FROM fmap_half", {"f": 12})
def _(t):
    return half_maps(t)


cte("half_mask", """
SELECT run_id, half, j, i FROM (
  SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id, half) AS hit FROM (
    SELECT *, sum(greatest(f,0)) OVER (PARTITION BY run_id, half ORDER BY greatest(f,0) DESC RANGE UNBOUNDED PRECEDING) AS c,
      dense_rank() OVER (PARTITION BY run_id, half ORDER BY greatest(f,0) DESC) AS ord,
      sum(greatest(f,0)) OVER (PARTITION BY run_id, half) AS tot FROM fmap_half))
WHERE ord <= hit AND tot > 0""")
cte("half_overlap", """
SELECT run_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)/count(*) AS overlap FROM (
  SELECT run_id, j, i, count(*) AS n FROM half_mask GROUP BY ALL) GROUP BY run_id""")


@query("overlap_jaccard", "SELECT * FROM half_overlap", {"overlap": 9})
def _(t):
    maps = half_maps(t)
    return fp.overlap(half(maps, 1), half(maps, 2), RUN)


@query(
    "l1_shape",
    """WITH u AS (SELECT run_id, half, j, i, f/sum(f) OVER (PARTITION BY run_id, half) AS f FROM fmap_half),
    b AS (SELECT run_id, coalesce(a.f, 0) AS fa, coalesce(b.f, 0) AS fb FROM (SELECT * FROM u WHERE half = 1) a
      FULL OUTER JOIN (SELECT * FROM u WHERE half = 2) b USING (run_id, j, i))
    SELECT run_id, sum(abs(fa-fb))/(0.5*(sum(abs(fa)) + sum(abs(fb)))) AS l1, sum(abs(fa-fb))/sum(abs(fa)) AS l1_first FROM b GROUP BY run_id""",
    {"l1": 8, "l1_first": 8},
)
def _(t):
    maps = half_maps(t)
    return fp.shape_l1(half(maps, 1), half(maps, 2), RUN, unit=True)


@query(
    "tail_share",
    """WITH r AS (SELECT run_id, wt_f, row_number() OVER (PARTITION BY run_id ORDER BY wt_f DESC) AS r,
        count(*) OVER (PARTITION BY run_id) AS n FROM wt),
    tp AS (SELECT run_id, n, max(abs(wt_f)) AS max_weight, sum(abs(wt_f)) AS top FROM r
        WHERE r <= greatest(CAST(floor(n*0.001) AS BIGINT), 1) GROUP BY ALL)
    SELECT run_id, max_weight, top/(SELECT sum(abs(flux)) FROM cells_static c WHERE c.run_id = tp.run_id) AS top0p1pct_share, n AS n_touchdown FROM tp""",
    {"max_weight": 6, "top0p1pct_share": 8},
)
def _(t):
    w = weighted(t)
    return fp.tail_share(w, fp.deposit_static(w, DOM), totals=frames(t))


# ---- sub-windows --------------------------------------------------------------
def sub_releases(t):
    idx = fp.subwindow_index(F.col("t_release"), T_FIRST, SUB_SECONDS, SUBS)
    return t.releases.groupBy("run_id", idx.alias("sub")).agg(F.count(F.lit(1)).alias("n_particles"))


def sub_maps(t):
    idx = fp.subwindow_index(F.col("t_release"), T_FIRST, SUB_SECONDS, SUBS)
    return wind_map(t, ["run_id", "sub"], sub_releases(t), weighted(t).withColumn("sub", idx))


cte("sub_n", """
SELECT run_id, least(greatest(CAST(floor((t_release - 900)/100) AS BIGINT), 0), 17) AS sub, count(*) AS n FROM fx_releases GROUP BY ALL""")
cte("sub_map", """
SELECT run_id, sub, j, i, sum(f)/any_value(n)/3600.0 AS f FROM (
  SELECT *, least(greatest(CAST(floor((t_release - 900)/100) AS BIGINT), 0), 17) AS sub FROM wcic)
JOIN sub_n USING (run_id, sub) GROUP BY ALL""")


@query("subwindow_footprints", "SELECT * FROM sub_map", {"f": 12})
def _(t):
    return sub_maps(t)


@query(
    "frame_sweep",
    """WITH m AS (SELECT unnest([900.0, 1200.0, 1500.0])::DOUBLE AS t_back),
    fr AS (SELECT run_id, t_back, avg(rel_u) AS u, avg(rel_v) AS v, avg(rel_w) AS w, count(*) AS n
      FROM fx_releases JOIN m ON t_release >= t_back GROUP BY ALL),
    ag AS (SELECT *, atan2(v, u) AS th, atan2(w, sqrt(u*u + v*v)) AS ph FROM fr),
    td AS (SELECT t.run_id, t_back, 2.0/greatest(td_w, 0.02) AS s, rel_u, rel_v, rel_w, abs(td_x - 768) > 1536 AS far
      FROM fx_touchdowns t JOIN fx_releases r USING (run_id, particle) JOIN m ON t_release >= t_back AND td_age <= t_back)
    SELECT run_id, t_back, n AS n_particles, sum(s*rel_w)/n AS raw, sum(s*(rel_w - w))/n AS mean_removed,
      sum(s*(rel_w*cos(ph) - (rel_u*cos(th) + rel_v*sin(th))*sin(ph)))/n AS streamline, sum(s)/n AS conc, -any_value(w)*sum(s)/n AS w_bar_c,
      avg(CASE WHEN far THEN 1.0 ELSE 0.0 END) AS wrapped_share
    FROM td JOIN ag USING (run_id, t_back) GROUP BY run_id, t_back, n""",
    {"raw": 6, "mean_removed": 6, "streamline": 6, "conc": 6, "w_bar_c": 6, "wrapped_share": 8},
)
def _(t):
    return fp.frame_sweep(t.touchdowns, t.releases, DOM, (900.0, 1200.0, 1500.0))


@query(
    "release_plan",
    """WITH w AS (SELECT run_id, min(step)*5.0 AS t0, max(step)*5.0 AS t1 FROM fx_cells GROUP BY run_id),
    f AS (SELECT run_id, t1, greatest(t0 + 20, t1 - 40) AS tf FROM w WHERE t1 > greatest(t0 + 20, t1 - 40)),
    s AS (SELECT run_id, tf, unnest(range(0, CAST(floor((t1 - tf + 1e-9)/4) AS BIGINT) + 1)) AS n FROM f)
    SELECT run_id, n*5 + m AS particle, (tf + n*4)::DOUBLE AS t_release FROM s, (SELECT unnest(range(0, 5)) AS m)""",
    {"t_release": 6},
)
def _(t):
    from ..sources.fixtures import DUMP_SECONDS

    win = t.cells.groupBy("run_id").agg((F.min("step") * DUMP_SECONDS).alias("t_start"), (F.max("step") * DUMP_SECONDS).alias("t_end"))
    return fp.release_plan(win, 5, 4.0, 20.0, 40.0)


def variant_maps(t):
    """One scan serves every weight floor: a touchdown is one row with the flux of each variant."""
    flux = {f"flux{n}": F.col("w_release") * fp.contact_weight(F.col("td_w"), F.lit(v)) for n, v in enumerate(VARIANTS)}
    e = (-0.5 - DOM.i_r) * DOM.dx, (-0.5 - DOM.j_r) * DOM.dx
    cells = fp.deposit_values(weighted(t), RUN, flux, F.col("xm"), F.col("ym"), *e, DOM.dx, DOM.nx, DOM.ny)
    rows = F.array(*[F.struct(F.lit(v).alias("w_floor"), F.col(f"flux{n}").alias("flux")) for n, v in enumerate(VARIANTS)])
    cells = cells.select("run_id", "j", "i", F.explode(rows).alias("r")).select("run_id", "j", "i", "r.w_floor", "r.flux")
    keys = ["run_id", "w_floor"]
    totals = frames(t).select("run_id", "n_particles", F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("w_floor"))
    return fp.density(cells, totals, keys, DOM.area)


@query(
    "variant_table",
    """WITH v AS (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS w_floor),
    q AS (SELECT run_id, w_floor, xm/24.0 + 32.0 AS cu, ym/24.0 + 32.0 AS cv, w_release*2.0/greatest(td_w, w_floor) AS x FROM wt, v),
    c AS (SELECT run_id, w_floor, (CAST(floor(cv) AS BIGINT) + dj + 64) % 64 AS j, (CAST(floor(cu) AS BIGINT) + di + 64) % 64 AS i,
      sum(x * CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END
            * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END) AS s
      FROM q, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj) GROUP BY ALL),
    f AS (SELECT c.*, s/n_particles/576.0 AS f FROM c JOIN frames USING (run_id)),
    p AS (SELECT run_id, w_floor, (i-32)*24.0 AS peak_e, (j-32)*24.0 AS peak_n FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, w_floor ORDER BY f DESC, j, i) AS r FROM f) WHERE r = 1),
    a AS (SELECT run_id, w_floor, count(*)*0.0576 AS area80_ha FROM (
      SELECT *, min(CASE WHEN cc >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id, w_floor) AS hit FROM (
        SELECT *, sum(f) OVER (PARTITION BY run_id, w_floor ORDER BY f DESC RANGE UNBOUNDED PRECEDING) AS cc,
          dense_rank() OVER (PARTITION BY run_id, w_floor ORDER BY f DESC) AS ord, sum(f) OVER (PARTITION BY run_id, w_floor) AS tot FROM f))
      WHERE ord <= hit GROUP BY ALL)
    SELECT run_id, w_floor, CASE WHEN sum(f) > 0 THEN sum(f*(i-32)*24)/sum(f) END AS centroid_e,
      CASE WHEN sum(f) > 0 THEN sum(f*(j-32)*24)/sum(f) END AS centroid_n, CASE WHEN sum(f) > 0 THEN any_value(area80_ha)::DOUBLE END AS area80_ha,
      CASE WHEN sum(f) > 0 THEN any_value(peak_e)::DOUBLE END AS peak_e, CASE WHEN sum(f) > 0 THEN any_value(peak_n)::DOUBLE END AS peak_n,
      sum(f)*576.0 AS integral
    FROM f JOIN p USING (run_id, w_floor) JOIN a USING (run_id, w_floor) GROUP BY run_id, w_floor""",
    {"centroid_e": 2, "centroid_n": 2, "area80_ha": 4, "integral": 6},
)
def _(t):
    m = fp.map_metrics(variant_maps(t), ["run_id", "w_floor"], DOM)
    return m.select("run_id", "w_floor", "centroid_e", "centroid_n", "area80_ha", "peak_e", "peak_n", "integral")


@query(
    "double_rotation",
    """WITH m AS (SELECT station, avg(u) AS u_bar, avg(v) AS v_bar, avg(w) AS w_bar, count(*) AS n FROM fx_tower GROUP BY station),
    a AS (SELECT *, atan2(v_bar, u_bar) AS yaw, atan2(w_bar, sqrt(u_bar*u_bar + v_bar*v_bar)) AS pitch FROM m)
    SELECT station, n, any_value(u_bar) AS u_bar, any_value(v_bar) AS v_bar, any_value(w_bar) AS w_bar, any_value(degrees(yaw)) AS yaw_deg,
      any_value(degrees(pitch)) AS pitch_deg, avg(w*cos(pitch) - (u*cos(yaw) + v*sin(yaw))*sin(pitch)) AS w_sf_mean,
      100*(1 - abs(avg(w*cos(pitch) - (u*cos(yaw) + v*sin(yaw))*sin(pitch)))/greatest(abs(any_value(w_bar)), 1e-12)) AS removed_pct
    FROM fx_tower JOIN a USING (station) GROUP BY station, n""",
    {"u_bar": 6, "v_bar": 6, "w_bar": 6, "yaw_deg": 6, "pitch_deg": 6, "w_sf_mean": 6, "removed_pct": 4},
)
def _(t):
    return double_rotation(t.tower)


def double_rotation(series, keys=("station",)):
    """Receptor means, yaw and pitch, and what the rotation leaves of mean w."""
    m = series.groupBy(*keys).agg(F.avg("u").alias("u_bar"), F.avg("v").alias("v_bar"), F.avg("w").alias("w_bar"), F.count(F.lit(1)).alias("n"))
    yaw, pitch = geo.yaw_pitch(F.col("u_bar"), F.col("v_bar"), F.col("w_bar"))
    a = m.withColumn("yaw", yaw).withColumn("pitch", pitch)
    # the rotation is linear, so the mean rotated w comes from the means
    wsf = geo.streamline_w(F.col("u_bar"), F.col("v_bar"), F.col("w_bar"), F.col("yaw"), F.col("pitch"))
    return a.select(
        *keys,
        "n",
        "u_bar",
        "v_bar",
        "w_bar",
        F.degrees("yaw").alias("yaw_deg"),
        F.degrees("pitch").alias("pitch_deg"),
        wsf.alias("w_sf_mean"),
        (100 * (1 - F.abs(wsf) / F.greatest(F.abs("w_bar"), F.lit(1e-12)))).alias("removed_pct"),
    )


