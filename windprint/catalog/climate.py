"""Climatology family."""

from pyspark.sql import functions as F

from ..operators import climate as cl
from .model import psi_sql
from .registry import cte, query

cte("cl0", """
SELECT *, u10*cos(site*0.05) - v10*sin(site*0.05) AS ue, v10*cos(site*0.05) + u10*sin(site*0.05) AS ve, acshflsm*1000/3600 AS hfx FROM fx_hourly WHERE time_hours >= 0""")
cte("cl1", """
SELECT *, sqrt(ue*ue + ve*ve) AS u10m, ((270 - degrees(atan2(ve, ue))) % 360 + 360) % 360 AS wdir, hfx/(psfc/(287.05*tk)*1004.5) AS wth,
  TIMESTAMP '1979-10-01' + to_hours(time_hours) AS valid FROM cl0""")
cte("it0", "SELECT *, 0.4*u10m/ln(10/0.05) AS us, 1e9::DOUBLE AS ll, 0.0::DOUBLE AS zq FROM cl1")
for _n in range(1, 13):
    cte(f"it{_n}a", f"""
SELECT * REPLACE (greatest(us, 1e-3) AS us, CASE WHEN abs(wth) > 1e-6 THEN -(greatest(us, 1e-3)*greatest(us, 1e-3)*greatest(us, 1e-3))*tk/(0.4*9.81*wth) ELSE 1e9 END AS ll) FROM it{_n - 1}""")
    cte(f"it{_n}b", f"SELECT * REPLACE (least(greatest(10/ll, -2), 1) AS zq) FROM it{_n}a")
    cte(f"it{_n}", f"SELECT * REPLACE (0.4*u10m/greatest(ln(10/0.05) - {psi_sql('zq')}, 0.5) AS us) FROM it{_n}b")
cte("cl2", "SELECT *, least(greatest(30/ll, -2), 1) AS z30, 30/ll AS zl, pblh/ll AS zil FROM it12")
cte("cl3", f"""
SELECT *, us/0.4*greatest(ln(30/0.05) - {psi_sql('z30')}, 0.5) AS u30,
  CASE WHEN zl <= -0.5 THEN 'very unstable' WHEN zl <= -0.05 THEN 'unstable' WHEN zl <= 0.05 THEN 'near-neutral' WHEN zl <= 0.5 THEN 'stable' ELSE 'very stable' END AS cls,
  CAST(floor(((wdir + 22.5) % 360)/45) AS BIGINT) AS oct, us >= 0.15 AND pblh > 20 AS qc, month(valid) AS mon, (hour(valid) - 6 + 24) % 24 AS local_hour FROM cl2""")


def derived(t):
    a = F.col("site") * 0.05
    return cl.derive(t.hourly, F.cos(a), F.sin(a))


@query("heat_flux", "SELECT site, rec, hfx, psfc/(287.05*tk) AS rho, wth FROM cl1", {"hfx": 6, "rho": 8, "wth": 8})
def _(t):
    return derived(t).select("site", "rec", "hfx", (F.col("psfc") / (287.05 * F.col("tk"))).alias("rho"), "wth")


@query("wind_rotation", "SELECT site, rec, ue, ve, u10m, wdir FROM cl1", {"ue": 7, "ve": 7, "u10m": 7, "wdir": 5})
def _(t):
    return derived(t).select("site", "rec", "ue", "ve", "u10m", "wdir")


@query("solve_ustar", 'SELECT site, rec, us, 1/ll AS inv_l FROM it12', {"us": 7, "inv_l": 5})
def _(t):
    return derived(t).select("site", "rec", "us", (1.0 / F.col("L")).alias("inv_l"))


@query("most_wind", "SELECT site, rec, u30, zl, zil FROM cl3", {"u30": 6, "zl": 4, "zil": 2})
def _(t):
    return derived(t).select("site", "rec", "u30", "zl", "zil")


@query("stability_class", "SELECT site, cls, qc, count(*) AS n FROM cl3 GROUP BY ALL")
def _(t):
    return derived(t).groupBy("site", "cls", "qc").agg(F.count(F.lit(1)).alias("n"))


@query("octant", "SELECT site, oct, count(*) AS n, avg(u10m) AS speed FROM cl3 GROUP BY ALL", {"speed": 6})
def _(t):
    return derived(t).groupBy("site", "oct").agg(F.count(F.lit(1)).alias("n"), F.avg("u10m").alias("speed"))


@query(
    "hour_parts",
    "SELECT site, mon::INTEGER AS month, hour(valid)::INTEGER AS hour, local_hour::INTEGER AS local_hour, count(*) AS n, min(time_hours) AS first_hour, max(valid) AS last_valid FROM cl3 GROUP BY ALL",
)
def _(t):
    d = t.hourly.select("site", "time_hours").withColumns(cl.hour_parts(F.col("time_hours")))
    return d.groupBy("site", "month", "hour", "local_hour").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_hours").alias("first_hour"), F.max("valid").alias("last_valid")
    )


@query("block_sample", "SELECT site, rec, time_hours, pblh FROM fx_hourly WHERE time_hours >= 0 AND (time_hours // 144) % 3 = 0")
def _(t):
    return cl.block_sample(t.hourly, 3).select("site", "rec", "time_hours", "pblh")


_VARS = ("pblh", "wth", "hfx", "u10m", "us", "u30", "zil")
_PQ = ", ".join(f"quantile_cont(x, {p}) AS p{round(100 * p)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
_PD = {"mean": 4, **{f"p{q}": 5 for q in (5, 25, 50, 75, 95, 99)}}
cte("cl_long", " UNION ALL ".join(f"SELECT site, qc, local_hour, mon, '{v}' AS var, {v} AS x FROM cl3" for v in _VARS))
cte("cl_pct", f"""
SELECT site, grp, var, count(*) AS n, avg(x) AS mean, {_PQ} FROM (
  SELECT site, 'all' AS grp, var, x FROM cl_long UNION ALL SELECT site, 'qc', var, x FROM cl_long WHERE qc) GROUP BY site, grp, var""")


@query("qc_percentiles", "SELECT * FROM cl_pct", {**_PD})
def _(t):
    return cl.percentiles(cl.with_groups(derived(t)), ["site", "grp"], _VARS)


cte("stab", """
SELECT site, cls, count(*) AS n, 100.0*count(*)/any_value(total) AS pct, median(pblh) AS pblh_p50, median(us) AS us_p50, median(wth) AS wth_p50
FROM cl3 JOIN (SELECT site, count(*) AS total FROM cl3 WHERE qc GROUP BY site) USING (site) WHERE qc GROUP BY site, cls""")


@query("stability_table", "SELECT * FROM stab", {"pct": 6, "pblh_p50": 5, "us_p50": 6, "wth_p50": 7})
def _(t):
    return cl.stability_table(derived(t))


cte("rose", """
SELECT site, coalesce(cls, 'all') AS cls, coalesce(CAST(oct AS VARCHAR), 'all') AS oct, count(*) AS n, 100.0*count(*)/any_value(total) AS pct
FROM cl3 JOIN (SELECT site, count(*) AS total FROM cl3 WHERE qc GROUP BY site) USING (site) WHERE qc
GROUP BY GROUPING SETS ((site, cls, oct), (site, cls), (site, oct), (site))""")


@query("wind_rose_cube", "SELECT * FROM rose", {"pct": 6})
def _(t):
    return cl.wind_rose(derived(t))


@query(
    "midday",
    "SELECT site, var, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75 FROM ("
    + " UNION ALL ".join(f"SELECT site, '{v}' AS var, {v} AS x FROM cl3 WHERE qc AND local_hour BETWEEN 10 AND 16 AND wth > 0.05" for v in ("pblh", "wth", "us", "u30", "zil"))
    + ") GROUP BY site, var",
    {"mean": 4, "p25": 5, "p50": 5, "p75": 5},
)
def _(t):
    return cl.percentiles(cl.midday(derived(t)), ["site"], ["pblh", "wth", "us", "u30", "zil"], (0.25, 0.5, 0.75))


@query(
    "midday_season",
    """SELECT site, mon IN (6, 7, 8) AS jja, mon::INTEGER AS month, count(*) AS n, avg(pblh) AS pblh, avg(wth) AS wth FROM cl3
    WHERE qc AND local_hour BETWEEN 10 AND 16 AND wth > 0.05 GROUP BY ALL""",
    {"pblh": 4, "wth": 7},
)
def _(t):
    return cl.midday(derived(t)).groupBy("site", F.col("month").isin(6, 7, 8).alias("jja"), "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pblh").alias("pblh"), F.avg("wth").alias("wth")
    )


@query(
    "sweep_ranges",
    "SELECT site, var, n, p5, p25, p50, p75, p95 FROM cl_pct WHERE grp = 'qc' AND var IN ('pblh', 'wth', 'us', 'u30')",
    {c: 5 for c in ("p5", "p25", "p50", "p75", "p95")},
)
def _(t):
    return cl.sweep_ranges(derived(t))


_RW = ", ".join(f"coalesce(max(CASE WHEN oct = '{o}' THEN r.pct END), 0) AS oct_{o}" for o in [*range(8), "all"])


@query(
    "climate_report",
    f"""SELECT r.site, r.cls, any_value(s.n) AS n, any_value(pblh_p50) AS pblh_p50, any_value(us_p50) AS us_p50, any_value(wth_p50) AS wth_p50, {_RW}
    FROM rose r LEFT JOIN stab s ON s.site = r.site AND s.cls = r.cls GROUP BY r.site, r.cls""",
    {"pblh_p50": 5, "us_p50": 6, "wth_p50": 7, **{f"oct_{o}": 6 for o in [*range(8), "all"]}},
)
def _(t):
    from ..plans import reports

    return reports.climate_report(derived(t))
