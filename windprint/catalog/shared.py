"""Tables and parameters shared by several registered queries."""

from pyspark.sql import functions as F

from ..operators import footprint as fp
from ..operators import rasters
from ..sources.fixtures import DOMAIN as DOM
from .registry import cte

RUN = ["run_id"]


def frames(t):
    return fp.release_frames(t.releases)


def framed(t):
    return fp.framed_releases(t.releases, frames(t))


def weighted(t):
    return fp.weigh(t.touchdowns, framed(t), DOM)


def static_map(t):
    return fp.density(fp.deposit_static(weighted(t), DOM), frames(t), RUN, DOM.area)


def half_maps(t):
    keys = ["run_id", "half"]
    return fp.density(fp.deposit_static(weighted(t), DOM, keys), fp.half_totals(framed(t)), keys, DOM.area)


def surface(t):
    return rasters.build_surface(t.pixels, DOM)


def half(maps, n):
    return maps.where(F.col("half") == n).drop("half")


cte("frames0", """
SELECT run_id, avg(rel_u) AS u_bar, avg(rel_v) AS v_bar, avg(rel_w) AS w_bar, count(*) AS n_particles,
  min(t_release) AS t_first, max(t_release) AS t_last FROM fx_releases GROUP BY run_id""")
cte("frames", """
SELECT *, atan2(v_bar, u_bar) AS yaw, atan2(w_bar, sqrt(u_bar*u_bar + v_bar*v_bar)) AS pitch,
  (t_first + t_last)/2 AS t_mid FROM frames0""")
cte("framed", """
SELECT r.run_id, r.particle, t_release, yaw, n_particles,
  rel_w*cos(pitch) - (rel_u*cos(yaw) + rel_v*sin(yaw))*sin(pitch) AS w_release,
  CASE WHEN t_release <= t_mid THEN 1 ELSE 2 END AS half
FROM fx_releases r JOIN frames USING (run_id)""")
cte("wt0", """
SELECT t.*, f.t_release, f.half, f.w_release, f.yaw, td_x - 768.0 AS ddx, td_y - 768.0 AS ddy,
  2.0/greatest(td_w, 0.02) AS wt_c,
  ((td_x/24.0) % 64.0 + 64.0) % 64.0 AS fi, ((td_y/24.0) % 64.0 + 64.0) % 64.0 AS fj
FROM fx_touchdowns t JOIN framed f USING (run_id, particle)""")
cte("wt", """
SELECT *, w_release*wt_c AS wt_f, -(ddx*cos(yaw) + ddy*sin(yaw)) AS x_up, ddy*cos(yaw) - ddx*sin(yaw) AS y_cross,
  sqrt(ddx*ddx + ddy*ddy) AS disp, (abs(ddx) > 768.0 OR abs(ddy) > 768.0) AS wrapped,
  CAST(round_even(fj, 0) AS BIGINT) % 64 AS jj, CAST(round_even(fi, 0) AS BIGINT) % 64 AS ii,
  ((fi + 0.5) % 64.0 - 0.5 - 32)*24.0 AS xm, ((fj + 0.5) % 64.0 - 0.5 - 32)*24.0 AS ym
FROM wt0""")
cte("cic0", """
SELECT run_id, half, wt_f, wt_c, xm/24.0 + 32.0 AS cu, ym/24.0 + 32.0 AS cv FROM wt""")
cte("cic", """
SELECT run_id, half, (CAST(floor(cv) AS BIGINT) + dj + 64) % 64 AS j, (CAST(floor(cu) AS BIGINT) + di + 64) % 64 AS i,
  wt_f*p AS f, wt_c*p AS c FROM (
  SELECT *, CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END
          * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END AS p
  FROM cic0, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj))""")
cte("cells_static", """
SELECT run_id, j, i, sum(f) AS flux, sum(c) AS conc FROM cic GROUP BY ALL""")
cte("fmap", """
SELECT run_id, j, i, flux/n_particles/576.0 AS f FROM cells_static JOIN frames USING (run_id)""")
cte("half_n", """
SELECT run_id, half, count(*) AS n FROM framed GROUP BY ALL""")
cte("fmap_half", """
SELECT run_id, half, j, i, sum(f)/any_value(n)/576.0 AS f FROM cic JOIN half_n USING (run_id, half) GROUP BY ALL""")

# surface build
cte("lc_count", """
SELECT site, j, i, lcclass, count(*) AS n FROM fx_pixels GROUP BY ALL""")
cte("lc_mode", """
SELECT site, j, i, lcclass FROM (SELECT *, row_number() OVER (PARTITION BY site, j, i ORDER BY n DESC, lcclass) AS r FROM lc_count)
WHERE r = 1""")
cte("elev", """
SELECT site, j, i, avg(elevation) AS mean, stddev_pop(elevation) AS spread, count(*) AS n_pixels FROM fx_pixels GROUP BY ALL""")
cte("ring", """
SELECT site, mean FROM elev WHERE j = 0 UNION ALL SELECT site, mean FROM elev WHERE j = 63
UNION ALL SELECT site, mean FROM elev WHERE i = 0 UNION ALL SELECT site, mean FROM elev WHERE i = 63""")
cte("datum", """
SELECT site, median(mean) AS datum FROM ring GROUP BY site""")
cte("tapered", """
SELECT site, j, i, mean AS elevation, datum,
  (mean - datum)
  * CASE WHEN least(j, 63-j) < 8 THEN 0.5*(1 - cos(pi()*(least(j, 63-j) + 0.5)/8)) ELSE 1 END
  * CASE WHEN least(i, 63-i) < 8 THEN 0.5*(1 - cos(pi()*(least(i, 63-i) + 0.5)/8)) ELSE 1 END AS topo
FROM elev JOIN datum USING (site)""")
cte("smooth_j", """
SELECT site, j, i, elevation, datum, CASE WHEN a IS NULL OR b IS NULL THEN topo ELSE 0.25*a + 0.5*topo + 0.25*b END AS topo
FROM (SELECT *, lag(topo) OVER w AS a, lead(topo) OVER w AS b FROM tapered WINDOW w AS (PARTITION BY site, i ORDER BY j))""")
cte("smooth_i", """
SELECT site, j, i, elevation, datum, CASE WHEN a IS NULL OR b IS NULL THEN topo ELSE 0.25*a + 0.5*topo + 0.25*b END AS topo
FROM (SELECT *, lag(topo) OVER w AS a, lead(topo) OVER w AS b FROM smooth_j WINDOW w AS (PARTITION BY site, j ORDER BY i))""")
cte("arr", """
SELECT *, ((i-32)*24.0 BETWEEN -60 AND 60) AND ((j-32)*24.0 BETWEEN -100 AND 250) AS "array"
FROM smooth_i JOIN lc_mode USING (site, j, i)""")
cte("srf", """
SELECT *, CASE WHEN "array" THEN 0.20 ELSE CASE lcclass WHEN 10 THEN 1.0 WHEN 20 THEN 0.2 WHEN 30 THEN 0.03 WHEN 40 THEN 0.1
    WHEN 50 THEN 0.5 WHEN 60 THEN 0.01 WHEN 70 THEN 0.001 WHEN 80 THEN 0.0001 WHEN 90 THEN 0.05 WHEN 95 THEN 0.2
    WHEN 100 THEN 0.02 ELSE 0.05 END END::DOUBLE AS z0m,
  0.1::DOUBLE*CASE WHEN "array" THEN 1.6 ELSE CASE lcclass WHEN 10 THEN 1.1 WHEN 20 THEN 1.1 WHEN 30 THEN 1.1 WHEN 40 THEN 1.0
    WHEN 50 THEN 1.5 WHEN 60 THEN 1.4 WHEN 70 THEN 0.3 WHEN 80 THEN 0.12 WHEN 90 THEN 0.6 WHEN 95 THEN 0.6
    WHEN 100 THEN 1.0 ELSE 1.0 END END::DOUBLE AS ht_flux,
  lcclass = 80 AND NOT "array" AS water
FROM arr""")
