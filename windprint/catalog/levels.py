"""Profiles, window statistics and gates."""

from pyspark.sql import functions as F

from ..functions import boundary_layer as bl
from ..operators import interp, levels as lv
from ..sources.fixtures import DUMP_SECONDS
from .registry import cte, query

DX = 24.0

cte("lv_z", "SELECT run_id, k, arg_min(z_pos, step) AS z FROM fx_cells WHERE z_pos IS NOT NULL GROUP BY ALL")
cte("lvl", """
SELECT run_id, k, z, CASE WHEN a IS NULL THEN b - z WHEN b IS NULL THEN z - a ELSE (b - a)/2 END AS dz FROM (
  SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b FROM lv_z WINDOW w AS (PARTITION BY run_id ORDER BY k))""")
cte("prof0", """
SELECT run_id, step, k, avg(u) AS U, avg(v) AS V, avg(theta) AS TH, avg(greatest(tke, 0)) AS E, var_pop(u) AS uu, var_pop(v) AS vv,
  var_pop(w) AS ww, covar_pop(u, v) AS uv, covar_pop(u, w) AS uw, covar_pop(v, w) AS vw, covar_pop(w, theta) AS wt
FROM fx_cells GROUP BY run_id, step, k""".replace(" AS U", ' AS "mU"').replace(" AS V", ' AS "mV"').replace(" AS E", ' AS "mE"'))
cte("prof", "SELECT *, 0.5*(uu + vv + ww) AS tke FROM prof0")
cte("mprof", """
SELECT run_id, k, avg(mU) AS mU, avg(mV) AS mV, avg(TH) AS TH, avg(mE) AS mE, avg(uu) AS uu, avg(vv) AS vv, avg(ww) AS ww, avg(uv) AS uv,
  avg(wt) AS wt, avg(tke) AS tke FROM prof GROUP BY run_id, k""")
cte("sfc", "SELECT run_id, step, avg(ustar) AS us, avg(ht_flux) AS hf, avg(inv_l) AS il FROM fx_surface_dumps GROUP BY ALL")
cte("scal", """
SELECT run_id, avg(us) AS ustar, avg(coalesce(hf, CASE WHEN abs(il) > 1e-12 THEN -(us*us*us)*TH*il/(0.4*9.81) ELSE 0 END)) AS ht_flux,
  avg(TH) AS theta0, count(*) AS n_dumps FROM sfc JOIN (SELECT * FROM prof WHERE k = 0) USING (run_id, step) GROUP BY run_id""")
cte("blh", """
SELECT run_id, coalesce(min(CASE WHEN k >= k_max AND tke < 0.05*tke_max THEN z END), max(z)) AS h, any_value(k_max) AS k_max FROM (
  SELECT *, first_value(k) OVER w AS k_max, first_value(tke) OVER w AS tke_max FROM mprof JOIN lvl USING (run_id, k)
  WINDOW w AS (PARTITION BY run_id ORDER BY tke DESC, k)) GROUP BY run_id""")
cte("rec", """
SELECT run_id, k AS k_r, z AS z_r FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(z - 30), k) AS r FROM lvl) WHERE r = 1""")
cte("ws0", """
SELECT run_id, n_dumps, k_r, z_r, mU, mV, uu, ww, mE, 2.0/3.0*mE AS sgs, ustar, ht_flux, theta0, h,
  greatest(pow(sin(atan2(mV, mU)), 2)*uu - 2*sin(atan2(mV, mU))*cos(atan2(mV, mU))*uv + pow(cos(atan2(mV, mU)), 2)*vv, 0) AS svr
FROM mprof JOIN rec ON rec.run_id = mprof.run_id AND k = k_r JOIN scal USING (run_id) JOIN blh USING (run_id)""".replace("SELECT run_id,", "SELECT mprof.run_id,").replace("JOIN scal USING (run_id) JOIN blh USING (run_id)", "JOIN scal ON scal.run_id = mprof.run_id JOIN blh ON blh.run_id = mprof.run_id"))
cte("wstats", """
SELECT run_id, n_dumps, k_r, z_r, mU AS "U", mV AS "V", sqrt(mU*mU + mV*mV) AS u_mean,
  ((270 - degrees(atan2(mV, mU))) % 360 + 360) % 360 AS wdir, sqrt(uu + sgs) AS sigma_u, sqrt(svr + sgs) AS sigma_v, sqrt(ww + sgs) AS sigma_w,
  sqrt(svr) AS sigma_v_resolved, sqrt(ww) AS sigma_w_resolved, mE AS e_sgs, ustar, ht_flux, theta0,
  CASE WHEN abs(ht_flux) > 1e-6 THEN -(ustar*ustar*ustar)*theta0/(0.4*9.81*ht_flux) ELSE 'inf'::DOUBLE END AS "L", h
FROM ws0""")
WS_DIGITS = {c: 6 for c in "U V u_mean wdir sigma_u sigma_v sigma_w sigma_v_resolved sigma_w_resolved e_sgs ustar ht_flux theta0".split()} | {"L": 4}


def stats(t):
    return lv.window_stats(t.cells, t.surface_dumps)


@query("window_stats", "SELECT * FROM wstats", WS_DIGITS)
def _(t):
    return stats(t)


@query("bl_height", "SELECT run_id, h, k_max FROM blh", {"h": 6})
def _(t):
    return lv.boundary_height(lv.mean_profiles(lv.dump_profiles(t.cells)), lv.levels_table(t.cells))


@query("obukhov", 'SELECT run_id, n_dumps, ustar, ht_flux, theta0, "L", 30/"L" AS z_over_l FROM wstats', {"ustar": 6, "ht_flux": 6, "theta0": 6, "L": 4, "z_over_l": 6})
def _(t):
    s = lv.surface_scalars(lv.dump_profiles(t.cells), t.surface_dumps)
    s = s.withColumn("L", bl.obukhov(F.col("ustar"), F.col("theta0"), F.col("ht_flux")))
    return s.select("run_id", "n_dumps", "ustar", "ht_flux", "theta0", "L", F.try_divide(F.lit(30.0), F.col("L")).alias("z_over_l"))


@query(
    "profiles",
    """SELECT run_id, step, k, sqrt(mU*mU + mV*mV) AS speed, ((270 - degrees(atan2(mV, mU))) % 360 + 360) % 360 AS wdir, TH AS theta, mE AS e, ww, wt, tke,
      CASE WHEN k = 0 THEN pow(uw*uw + vw*vw, 0.25) END AS ustar_flux FROM prof""",
    {c: 7 for c in ("speed", "wdir", "theta", "e", "ww", "wt", "tke", "ustar_flux")},
)
def _(t):
    from ..functions import geometry as geo

    p = lv.dump_profiles(t.cells)
    q = F.pow(F.pow("uw", F.lit(2.0)) + F.pow("vw", F.lit(2.0)), F.lit(0.25))
    return p.select(
        "run_id",
        "step",
        "k",
        F.hypot("U", "V").alias("speed"),
        geo.met_direction(F.col("U"), F.col("V")).alias("wdir"),
        F.col("TH").alias("theta"),
        F.col("E").alias("e"),
        "ww",
        "wt",
        "tke",
        F.when(F.col("k") == 0, q).alias("ustar_flux"),
    )


cte("sgf", """
SELECT run_id, k, z, dz, cbrt(576.0*dz) AS delta, z/cbrt(576.0*dz) AS z_over_delta, ww AS resolved, 2.0/3.0*mE AS subgrid,
  2.0/3.0*mE/greatest(ww + 2.0/3.0*mE, 1e-30) AS fraction FROM mprof JOIN lvl USING (run_id, k)""")


@query("subgrid_fraction", "SELECT * FROM sgf", {c: 7 for c in ("delta", "z_over_delta", "resolved", "subgrid", "fraction")})
def _(t):
    return lv.subgrid_fraction(t.cells, DX)


@query(
    "subgrid_gate",
    """WITH r AS (SELECT run_id, k AS k_r, fraction FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(z-30), k) AS n FROM sgf) WHERE n = 1),
    a AS (SELECT run_id, list(fraction ORDER BY z_over_delta DESC) AS x, list(z_over_delta ORDER BY z_over_delta DESC) AS y FROM sgf WHERE z > 0 GROUP BY 1),
    b AS (SELECT *, least(greatest(len(list_filter(x, lambda v: v <= 0.4)), 1), len(x) - 1) AS lo FROM a)
    SELECT run_id, k_r, fraction, CASE WHEN fraction < 0.4 THEN 'PASS' ELSE 'FAIL' END AS gate,
      y[lo] + (y[lo+1] - y[lo])*least(greatest((0.4 - x[lo])/(x[lo+1] - x[lo]), 0), 1) AS crossing FROM r JOIN b USING (run_id)""",
    {"fraction": 7, "crossing": 6},
)
def _(t):
    return lv.subgrid_gate(lv.subgrid_fraction(t.cells, DX))


cte("k0k1", """
SELECT run_id, step, ww0, ww1, n_bad, n_cells, ww0/greatest(ww1, 1e-30) AS ratio,
  CASE WHEN n_bad > 0 OR ww0 IS NULL OR ww1 IS NULL OR NOT isfinite(ww0/greatest(ww1, 1e-30)) THEN 'FAIL' WHEN ww1 < 1e-5 THEN 'SKIP'
       WHEN ww0/greatest(ww1, 1e-30) >= 1.0 THEN 'FAIL' ELSE 'OK' END AS status
FROM (SELECT run_id, step, var_pop(w) FILTER (WHERE k = 0 AND isfinite(w)) AS ww0, var_pop(w) FILTER (WHERE k = 1 AND isfinite(w)) AS ww1,
  count(*) FILTER (WHERE NOT isfinite(w)) AS n_bad, count(*) AS n_cells FROM fx_cells GROUP BY run_id, step)""")


@query("k0k1_gate", "SELECT * FROM k0k1", {"ww0": 8, "ww1": 8, "ratio": 6})
def _(t):
    return lv.k0k1_gate(t.cells).select("run_id", "step", "ww0", "ww1", "n_bad", "n_cells", "ratio", "status")


@query(
    "field_qa",
    """SELECT run_id, step, var, min(x) AS lo, max(x) AS hi, avg(x) AS mean, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf,
      count(x) > 0 AS present, CASE WHEN count(x) = 0 THEN 'FAIL' ELSE 'ok' END AS status FROM (
      SELECT run_id, step, 'u' AS var, u AS x FROM fx_cells UNION ALL SELECT run_id, step, 'v', v FROM fx_cells UNION ALL SELECT run_id, step, 'w', w FROM fx_cells
      UNION ALL SELECT run_id, step, 'theta', theta FROM fx_cells UNION ALL SELECT run_id, step, 'rho', NULL FROM fx_cells) GROUP BY ALL""",
    {"lo": 6, "hi": 6, "mean": 6},
)
def _(t):
    return lv.field_qa(t.cells)


@query("theta_delta", "SELECT run_id, step, arg_max(TH, k) - arg_min(TH, k) AS theta_delta FROM prof GROUP BY ALL", {"theta_delta": 6})
def _(t):
    return lv.theta_delta(lv.dump_profiles(t.cells))


_VR = ", ".join(f"var_pop({v}) FILTER (WHERE k = 0)/greatest(var_pop({v}) FILTER (WHERE k = 1), 1e-30) AS ratio_{v}" for v in ("u", "v", "w", "theta"))


@query("variance_ratio", f"SELECT run_id, step, {_VR} FROM fx_cells GROUP BY ALL", {f"ratio_{v}": 6 for v in ("u", "v", "w", "theta")})
def _(t):
    # a dump cut off inside level 0 has no level-1 variance: greatest() skips the null on both sides
    return lv.variance_ratio(t.cells)


cte("hist0", """
SELECT run_id, step, avg(tke) AS tke_col, avg(mE) AS sgs_col FROM prof GROUP BY ALL""")
cte("hist", """
SELECT run_id, step, tke_col, sgs_col, us, step*5.0/60.0 AS t_min, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back,
  count(*) OVER (PARTITION BY run_id) AS size FROM hist0 JOIN sfc USING (run_id, step)""")


def history(t):
    return lv.dump_history(t.cells, t.surface_dumps, DUMP_SECONDS)


def _trend_sql(y, tag):
    se = f"sqrt(greatest(regr_syy({y}, t_min) - regr_sxy({y}, t_min)*regr_sxy({y}, t_min)/regr_sxx({y}, t_min), 0)/(count(*) - 2)/regr_sxx({y}, t_min))"
    return f"regr_slope({y}, t_min) AS slope_{tag}, {se} AS se_{tag}, CASE WHEN {se} > 0 THEN regr_slope({y}, t_min)/{se} ELSE 0 END AS sig_{tag}"


cte("trend", f"""
SELECT *, abs(sig_tke) < 2 AND abs(sig_us) < 2 AS stationary FROM (
  SELECT run_id, count(*) AS n, {_trend_sql('tke_col', 'tke')}, {_trend_sql('us', 'us')} FROM hist WHERE size >= 5 AND back <= 6 GROUP BY run_id)""")


@query("trend_gate", "SELECT * FROM trend", {c: 6 for c in ("slope_tke", "se_tke", "sig_tke", "slope_us", "se_us", "sig_us")})
def _(t):
    return lv.trend_gate(history(t))


@query(
    "plateau",
    """SELECT run_id, (arg_max(tke_col, step) - arg_min(tke_col, step))/greatest(abs(avg(tke_col)), 1e-30) AS drift,
      abs((arg_max(tke_col, step) - arg_min(tke_col, step))/greatest(abs(avg(tke_col)), 1e-30)) < 0.05 AS plateau
    FROM hist WHERE back <= 4 GROUP BY run_id HAVING count(*) >= 4""",
    {"drift": 7},
)
def _(t):
    return lv.plateau(history(t))


cte("conv", """
SELECT run_id, step, step*5.0::DOUBLE AS t, z_i, cbrt(9.81/th*greatest(wth_s, 1e-9)*z_i) AS w_star, us AS ustar, wth_s, -wt_min/greatest(wth_s, 1e-9) AS entrainment,
  tke_int, -(us*us*us)*th/(0.4*9.81*greatest(wth_s, 1e-9)) AS "L" FROM (
  SELECT run_id, step, z_i, wt_min, th, tke_int, us, coalesce(hf, wt0) AS wth_s FROM (
    SELECT run_id, step, arg_min(z, wt) AS z_i, min(wt) AS wt_min, arg_min(wt, k) AS wt0, arg_min(TH, k) AS th, coalesce(sum(area), 0) AS tke_int FROM (
      SELECT *, 0.5*(tke + lag(tke) OVER w)*(z - lag(z) OVER w) AS area FROM prof JOIN lvl USING (run_id, k) WINDOW w AS (PARTITION BY run_id, step ORDER BY k))
    GROUP BY ALL) JOIN sfc USING (run_id, step))""")
cte("conv_r", "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back FROM conv")


def conv(t):
    return lv.convective_state(t.cells, t.surface_dumps, DUMP_SECONDS)


@query("growth_rate", "SELECT run_id, regr_slope(z_i, t/3600) AS growth FROM conv_r WHERE back <= 3 GROUP BY run_id HAVING count(*) > 2", {"growth": 3})
def _(t):
    return lv.growth_rate(conv(t))


@query(
    "entrainment",
    "SELECT run_id, step, z_i, wth_s, entrainment, CASE WHEN entrainment BETWEEN 0.1 AND 0.35 THEN 'OK' ELSE 'OUTSIDE' END AS gate FROM conv_r WHERE back = 1",
    {"wth_s": 7, "entrainment": 6},
)
def _(t):
    return lv.entrainment_gate(conv(t))


@query("tke_integral", "SELECT run_id, step, tke_int FROM conv", {"tke_int": 6})
def _(t):
    return conv(t).select("run_id", "step", "tke_int")


@query("convective_scale", 'SELECT run_id, step, t, z_i, w_star, ustar, z_i/w_star AS t_star, "L" FROM conv', {"t": 3, "w_star": 6, "ustar": 6, "t_star": 4, "L": 4})
def _(t):
    return conv(t).select("run_id", "step", "t", "z_i", "w_star", "ustar", F.try_divide("z_i", "w_star").alias("t_star"), "L")


@query(
    "lenschow",
    """SELECT run_id, k, zeta, sw AS sw_over_ws, ref AS lenschow, sw/greatest(ref, 1e-9) AS ratio FROM (
      SELECT run_id, k, z/z_i AS zeta, sqrt(ww + 2.0/3.0*mE)/w_star AS sw,
        1.34*cbrt(greatest(z/z_i, 1e-6))*greatest(1 - 0.8*z/z_i, 0) AS ref
      FROM (SELECT * FROM conv_r WHERE back = 1) JOIN prof USING (run_id, step) JOIN lvl USING (run_id, k))""",
    {"zeta": 6, "sw_over_ws": 6, "lenschow": 6, "ratio": 3},
)
def _(t):
    return lv.lenschow_table(t.cells, t.surface_dumps, DUMP_SECONDS)


@query(
    "profile_peak",
    """WITH n AS (SELECT run_id, max(step) AS step FROM prof GROUP BY 1),
    p AS (SELECT *, ww/greatest(us*us, 1e-30) AS nr FROM prof JOIN n USING (run_id, step) JOIN lvl USING (run_id, k) JOIN sfc USING (run_id, step)),
    m AS (SELECT run_id, z AS z_peak, nr AS peak_ratio, ww AS ww_max FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ww DESC, k) AS r FROM p) WHERE r = 1)
    SELECT run_id, max(step) AS step, any_value(z_peak) AS z_peak, any_value(peak_ratio) AS peak_ratio, max(CASE WHEN ww > 0.05*ww_max THEN z END) AS z_zero,
      max(CASE WHEN nr > 0.1 THEN z END) AS z_proxy FROM p JOIN m USING (run_id) GROUP BY run_id""",
    {"peak_ratio": 6},
)
def _(t):
    return lv.profile_peak(t.cells, t.surface_dumps)


cte("modes", "SELECT unnest(['surface', 'mixed', 'blend']) AS mode")
cte("floor0", """
SELECT run_id, k, z, mode, ww, mE, ustar, h, greatest(h, 1.0) AS oh, CASE WHEN isfinite("L") AND abs("L") > 1e-6 THEN z/"L" ELSE 0 END AS zeta,
  cbrt(9.81/theta0*greatest(ht_flux, 0)*greatest(h, 1.0)) AS ws, least(greatest(z/greatest(h, 1.0), 1e-4), 1.5) AS zz
FROM mprof JOIN lvl USING (run_id, k) JOIN wstats USING (run_id) CROSS JOIN modes""")
cte("floor1", """
SELECT *, CASE WHEN zeta < 0 THEN cbrt(greatest(1 - 3*zeta, 1)) ELSE 1 + 0.2*least(zeta, 2) END AS phi_w FROM floor0""")
cte("floor2", """
SELECT *, 1.25*phi_w*ustar*pow(greatest(1 - z/oh, 0), 0.75) AS ts, 1.34*ws*cbrt(zz)*greatest(1 - 0.8*zz, 0) AS tm FROM floor1""")
cte("sgs_floor_sql", """
SELECT run_id, k, z, mode, phi_w, target, 1 + least(greatest((0.2*h - z)/(0.1*h), 0), 1)
  * greatest(greatest(target*target - ww, 0)/greatest(2.0/3.0*mE, 1e-9) - 1, 0) AS factor
FROM (SELECT *, CASE WHEN mode = 'surface' OR ws <= 0 THEN ts WHEN mode = 'mixed' THEN tm ELSE least(ts, tm) END AS target FROM floor2)""")


def floors(t):
    return lv.variance_floor_table(lv.mean_profiles(lv.dump_profiles(t.cells)), lv.levels_table(t.cells), stats(t))


@query("sgs_floor", "SELECT * FROM sgs_floor_sql", {"phi_w": 6, "target": 6, "factor": 6})
def _(t):
    return floors(t)


def _grad(f):
    return (
        f"CASE WHEN zm IS NULL THEN ({f}p - {f})/nullif(zp - z, 0) WHEN zp IS NULL THEN ({f} - {f}m)/nullif(z - zm, 0) ELSE "
        f"((z-zm)*(z-zm)*{f}p + ((zp-z)*(zp-z) - (z-zm)*(z-zm))*{f} - (zp-z)*(zp-z)*{f}m)/((z-zm)*(zp-z)*(zp-zm)) END"
    )


cte("grad0", """
SELECT *, lag(z) OVER q AS zm, lead(z) OVER q AS zp, lag(theta) OVER q AS thetam, lead(theta) OVER q AS thetap, lag(sig2) OVER q AS sig2m, lead(sig2) OVER q AS sig2p,
  lag(u) OVER q AS um, lead(u) OVER q AS up
FROM (SELECT *, greatest(tke, 0) AS e, 2.0/3.0*greatest(tke, 0) AS sig2 FROM fx_cells JOIN lvl USING (run_id, k))
WINDOW q AS (PARTITION BY run_id, step, j, i ORDER BY k)""")
cte("grad1", f"SELECT *, {_grad('theta')} AS dth, {_grad('sig2')} AS dsig2, {_grad('u')} AS du, cbrt(576.0*dz) AS delta FROM grad0")
cte("sgs_eps_sql", """
SELECT run_id, step, k, j, i, 0.93*pow(sqrt(e), 3)/greatest(CASE WHEN 9.81/theta*dth > 0
    THEN greatest(least(0.76*sqrt(e)/sqrt(greatest(9.81/theta*dth, 1e-12)), delta), 1e-2) ELSE delta END, 1e-2) AS eps, dsig2 AS dsig2_dz
FROM grad1""")


@query("sgs_eps", "SELECT * FROM sgs_eps_sql", {"eps": 8, "dsig2_dz": 8})
def _(t):
    return lv.subgrid_terms(t.cells, DX).select("run_id", "step", "k", "j", "i", "eps", F.col("dsig2_dz"))


@query("vertical_gradient", "SELECT run_id, step, k, j, i, dth AS dtheta_dz, du AS du_dz FROM grad1", {"dtheta_dz": 7, "du_dz": 7})
def _(t):
    g = lv.vertical_gradient(t.cells, lv.levels_table(t.cells), ["theta", "u"])
    return g.select("run_id", "step", "k", "j", "i", "dtheta_dz", "du_dz")


@query(
    "lag1_autocorr",
    """WITH m AS (SELECT run_id, step, k, avg(w) AS m, var_pop(w) AS va, stddev_pop(w) AS sd FROM fx_cells GROUP BY ALL),
    c AS (SELECT run_id, step, k, j, i, w - m AS f, va, sd FROM fx_cells JOIN m USING (run_id, step, k)),
    l AS (SELECT *, lag(f) OVER (PARTITION BY run_id, step, k, j ORDER BY i) AS fx, lag(f) OVER (PARTITION BY run_id, step, k, i ORDER BY j) AS fy FROM c)
    SELECT run_id, step, k, any_value(sd) AS std, avg(f*fx)/greatest(any_value(va), 1e-30) AS corr_x, avg(f*fy)/greatest(any_value(va), 1e-30) AS corr_y FROM l GROUP BY ALL""",
    {"std": 7, "corr_x": 6, "corr_y": 6},
)
def _(t):
    return lv.lag1_autocorr(t.cells)


@query(
    "strided_dumps",
    """SELECT run_id, step, count(*) AS n_cells, avg(u) AS mean_u FROM fx_cells JOIN (
      SELECT run_id, step FROM (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) AS r FROM fx_cells GROUP BY run_id, step) WHERE (r - 1) % 3 = 0)
    USING (run_id, step) GROUP BY ALL""",
    {"mean_u": 6},
)
def _(t):
    picked = t.cells.join(lv.strided_steps(t.cells, 3), ["run_id", "step"], "left_semi")
    return picked.groupBy("run_id", "step").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("u").alias("mean_u"))


@query(
    "closure_sweep",
    """SELECT run_id, factor, sqrt(sigma_w_resolved*sigma_w_resolved + factor*2.0/3.0*e_sgs)/ustar AS sw_over_us,
      sqrt(sigma_w_resolved*sigma_w_resolved + factor*2.0/3.0*e_sgs)/ustar - 1.25 AS vs_target
    FROM wstats, (SELECT unnest([0.5, 1.0, 1.5, 2.0])::DOUBLE AS factor)""",
    {"sw_over_us": 6, "vs_target": 6},
)
def _(t):
    return lv.closure_sweep(stats(t), (0.5, 1.0, 1.5, 2.0))


# ---- sub-layer continuation on every cell, at a height derived from its indices
cte("sl_fac", "SELECT run_id, list(z ORDER BY z) AS zs, list(factor ORDER BY z) AS fs FROM sgs_floor_sql WHERE mode = 'surface' GROUP BY run_id")
cte("sl_g", f"""
SELECT run_id, list(d ORDER BY z) AS ds FROM (SELECT run_id, z, {_grad('f')} AS d FROM (
  SELECT run_id, z, factor AS f, lag(z) OVER q AS zm, lead(z) OVER q AS zp, lag(factor) OVER q AS fm, lead(factor) OVER q AS fp
  FROM sgs_floor_sql WHERE mode = 'surface' WINDOW q AS (PARTITION BY run_id ORDER BY z))) GROUP BY run_id""")
cte("sl0", """
SELECT g.run_id, g.step, g.k, g.j, g.i, greatest((g.j*8 + g.i + g.step*64)::DOUBLE/100, 1) AS zagl, u, v, w, e, eps, dsig2_dz AS ds2, greatest(z0m, 1e-4) AS z0, zs, fs, ds
FROM grad1 g JOIN sgs_eps_sql USING (run_id, step, k, j, i) JOIN fx_surface_dumps s ON s.run_id = g.run_id AND s.step = g.step AND s.j = g.j AND s.i = g.i
JOIN sl_fac f ON f.run_id = g.run_id JOIN sl_g d ON d.run_id = g.run_id""")
cte("sl1", """
SELECT *, zagl < 4 AS below, least(greatest(ln(greatest(zagl, 1.001*z0)/z0)/ln(4/z0), 0), 1) AS lg,
  least(greatest(len(list_filter(zs, lambda q: q <= zagl)), 1), len(zs) - 1) AS lo FROM sl0""")
cte("sl2", """
SELECT *, fs[lo] + (fs[lo+1] - fs[lo])*least(greatest((zagl - zs[lo])/(zs[lo+1] - zs[lo]), 0), 1) AS sc,
  ds[lo] + (ds[lo+1] - ds[lo])*least(greatest((zagl - zs[lo])/(zs[lo+1] - zs[lo]), 0), 1) AS dsc FROM sl1""")


@query(
    "sublayer",
    """SELECT run_id, step, k, j, i, CASE WHEN below THEN u*lg ELSE u END AS u, CASE WHEN below THEN v*lg ELSE v END AS v, CASE WHEN below THEN w*zagl/4 ELSE w END AS w,
      greatest(CASE WHEN below THEN eps*4/zagl ELSE eps END, 1e-8) AS eps, greatest(sc*2/3*e, 1e-6) AS sig2,
      CASE WHEN below THEN 0 ELSE sc*ds2 + 2.0/3.0*e*dsc END AS ds2, greatest(sc*2/3*e, 1e-6)*1.5625*3/11.4225 AS sig2_w,
      CASE WHEN below THEN w*zagl/4 ELSE w END - CASE WHEN below THEN u*lg ELSE u END*0.01 + CASE WHEN below THEN v*lg ELSE v END*0.02 AS approach
    FROM sl2""",
    {c: 6 for c in ("u", "v", "w", "eps", "sig2", "ds2", "sig2_w", "approach")},
)
def _(t):
    fac = floors(t).where(F.col("mode") == "surface")
    from pyspark.sql import Window

    from ..functions import geometry as geo

    w = Window.partitionBy("run_id").orderBy("z")
    grad = geo.level_gradient(F.col("factor"), F.lag("factor").over(w), F.lead("factor").over(w), F.col("z"), F.lag("z").over(w), F.lead("z").over(w))
    arr = interp.level_arrays(fac.withColumn("dfac", grad), ["run_id"], "z", ["factor", "dfac"])
    zagl = F.greatest((F.col("j") * 8 + F.col("i") + F.col("step") * 64).cast("double") / 100.0, F.lit(1.0))
    cells = lv.subgrid_terms(t.cells, DX).drop("z", "dz").withColumn("zagl", zagl)
    p = cells.join(t.surface_dumps.select("run_id", "step", "j", "i", F.col("z0m").alias("z0")), ["run_id", "step", "j", "i"])
    p = interp.at_height(p, arr, ["run_id"], "zagl", "z_arr", ["factor_arr", "dfac_arr"])
    p = p.withColumnsRenamed({"factor_arr_at": "sc", "dfac_arr_at": "dsc", "dsig2_dz": "ds2"})
    s = lv.sublayer(p, F.lit(4.0))
    sw = lv.split_variance(F.col("sig2"), bl.anisotropy())[2]
    rate = lv.approach_rate(F.col("u"), F.col("v"), F.col("w"), F.lit(0.01), F.lit(-0.02))
    return s.select("run_id", "step", "k", "j", "i", "u", "v", "w", "eps", "sig2", "ds2", sw.alias("sig2_w"), rate.alias("approach"))


# ---- composites ---------------------------------------------------------------
@query(
    "spinup_gate",
    """SELECT t.run_id, n, sig_tke, sig_us, stationary, p.ww/greatest(us*us, 1e-30) AS sw2_over_us2, p.z AS z_peak, us AS ustar FROM trend t JOIN (
      SELECT run_id, step, ww, z, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, ww DESC, k) AS r FROM prof JOIN lvl USING (run_id, k)) p
      ON p.run_id = t.run_id AND r = 1 JOIN sfc ON sfc.run_id = t.run_id AND sfc.step = p.step""",
    {"sig_tke": 6, "sig_us": 6, "sw2_over_us2": 6, "ustar": 6},
)
def _(t):
    from ..plans import reports

    return reports.spinup_gate(t.cells, t.surface_dumps, DUMP_SECONDS)


@query(
    "cbl_report",
    """SELECT c.run_id, step, z_i, w_star, ustar, wth_s, entrainment, tke_int, "L", z_i/"L" AS zi_over_l, growth,
      CASE WHEN entrainment BETWEEN 0.1 AND 0.35 THEN 'OK' ELSE 'OUTSIDE' END AS gate
    FROM conv_r c LEFT JOIN (SELECT run_id, regr_slope(z_i, t/3600) AS growth FROM conv_r WHERE back <= 3 GROUP BY run_id HAVING count(*) > 2) g ON g.run_id = c.run_id
    WHERE back = 1""",
    {"w_star": 6, "ustar": 6, "wth_s": 7, "entrainment": 6, "tke_int": 6, "L": 4, "zi_over_l": 5, "growth": 3},
)
def _(t):
    from ..plans import reports

    return reports.cbl_report(t.cells, t.surface_dumps, DUMP_SECONDS)


@query(
    "near_surface",
    f"""WITH m AS (SELECT run_id, step, k, avg(w) AS m, var_pop(w) AS va FROM fx_cells GROUP BY ALL),
    c AS (SELECT run_id, step, k, j, i, w - m AS f, va FROM fx_cells JOIN m USING (run_id, step, k)),
    l AS (SELECT *, lag(f) OVER (PARTITION BY run_id, step, k, j ORDER BY i) AS fx, lag(f) OVER (PARTITION BY run_id, step, k, i ORDER BY j) AS fy FROM c),
    a AS (SELECT run_id, step, k, avg(f*fx)/greatest(any_value(va), 1e-30) AS corr_x, avg(f*fy)/greatest(any_value(va), 1e-30) AS corr_y FROM l GROUP BY ALL),
    r AS (SELECT run_id, step, {_VR} FROM fx_cells GROUP BY ALL)
    SELECT run_id, step, k, corr_x, corr_y, ratio_u, ratio_v, ratio_w, ratio_theta, us AS ustar FROM a JOIN r USING (run_id, step) JOIN sfc USING (run_id, step)""",
    {c: 6 for c in ("corr_x", "corr_y", "ratio_u", "ratio_v", "ratio_w", "ratio_theta", "ustar")},
)
def _(t):
    from ..plans import reports

    return reports.near_surface(t.cells, t.surface_dumps)
