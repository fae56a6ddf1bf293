"""Sub-window ensembles and incremental queries."""

from pyspark.sql import functions as F

from ..operators import ensemble as en, footprint as fp
from ..sources.shared_table import materialize
from ..sources.fixtures import PLANE
from ..streaming import closing
from ..streaming import incremental as inc
from .footprint import SUB_SECONDS, SUBS, T_FIRST, sub_maps, sub_releases
from .registry import cte, query
from .shared import DOM, RUN, framed, weighted

EX, EY, ERES, ENX, ENY, DRAWS = -600.0, -1560.0, 240.0, 22, 13, 20


def coarse_maps(t):
    idx = fp.subwindow_index(F.col("t_release"), T_FIRST, SUB_SECONDS, SUBS)
    keys = ["run_id", "sub"]
    cells = fp.deposit_cic(weighted(t).withColumn("sub", idx), keys, F.col("x_up"), F.col("y_cross"), EX, EY, ERES, ENX, ENY)
    return fp.density(cells, sub_releases(t), keys, ERES * ERES)


cte("sub_pk", """
SELECT run_id, sub, CASE WHEN tot > 0 THEN -570.0 + i*60 END::DOUBLE AS peak_x FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, sub ORDER BY fy DESC, i) AS r, sum(fy) OVER (PARTITION BY run_id, sub) AS tot
  FROM (SELECT run_id, sub, i, sum(f) AS fy FROM sub_map GROUP BY ALL)) WHERE r = 1""")
cte("sub_ct", "SELECT run_id, sub, CASE WHEN sum(f) > 0 THEN sum(f*(-570.0 + i*60))/sum(f) END AS centroid_x FROM sub_map GROUP BY run_id, sub")
cte("sub_dev", """
SELECT run_id, sub, peak_x - avg(peak_x) OVER (PARTITION BY run_id) AS p, centroid_x - avg(centroid_x) OVER (PARTITION BY run_id) AS c FROM sub_pk JOIN sub_ct USING (run_id, sub)""")
_LAGS = ", ".join(f"coalesce(sum({a}*lag_{a}{n}), 0)/nullif(sum({a}*{a}), 0) AS {nm}_lag{n}" for a, nm in (("p", "peak_x"), ("c", "centroid_x")) for n in range(1, 5))
_LAGC = ", ".join(f"lag({a}, {n}) OVER w AS lag_{a}{n}" for a in "pc" for n in range(1, 5))


@query(
    "lag_autocorr",
    f"""SELECT run_id, count(*) AS windows, 2/sqrt(count(*)) AS bound, {_LAGS} FROM (SELECT *, {_LAGC} FROM sub_dev WINDOW w AS (PARTITION BY run_id ORDER BY sub)) GROUP BY run_id""",
    {"bound": 8, **{f"{m}_lag{n}": 5 for m in ("peak_x", "centroid_x") for n in range(1, 5)}},
)
def _(t):
    m = fp.field_peak_centroid(sub_maps(t), ["run_id", "sub"], -600.0, 60.0)
    return en.lag_autocorr(m, RUN, "sub", ["peak_x", "centroid_x"])


cte("members", """
SELECT draw, sub, row_number() OVER (PARTITION BY draw ORDER BY md5('0-' || draw || '-' || sub)) AS rnk
FROM (SELECT unnest(range(0, 20)) AS draw) CROSS JOIN (SELECT unnest(range(0, 18)) AS sub)""")
cte("ecic", """
SELECT run_id, least(greatest(CAST(floor((t_release - 900)/100) AS BIGINT), 0), 17) AS sub, wt_f, (x_up + 600)/240.0 - 0.5 AS cu, (y_cross + 1560)/240.0 - 0.5 AS cv FROM wt""")
cte("emap", """
SELECT run_id, sub, j, i, sum(f)/any_value(n)/57600.0 AS f FROM (
  SELECT run_id, sub, ((CAST(floor(cv) AS BIGINT) + dj) % 13 + 13) % 13 AS j, ((CAST(floor(cu) AS BIGINT) + di) % 22 + 22) % 22 AS i,
    wt_f * CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END AS f
  FROM ecic, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) JOIN sub_n USING (run_id, sub) GROUP BY run_id, sub, j, i""")


@query(
    "bootstrap_members",
    """SELECT run_id, draw, rnk::INTEGER AS rank, sub, n AS n_particles FROM members JOIN sub_n USING (sub)""",
)
def _(t):
    m = en.draw_members(t.spark, DRAWS, SUBS)
    return sub_releases(t).join(m, "sub").select("run_id", "draw", F.col("rank"), "sub", "n_particles")


cte("em", """
SELECT run_id, draw, n, j, i, sum(f)/n AS f FROM emap JOIN members USING (sub) JOIN (SELECT unnest(range(1, 10)) AS n) q ON rnk <= n GROUP BY run_id, draw, n, j, i""")
cte("er", "SELECT run_id, draw, j, i, sum(f)/9 AS f FROM emap JOIN members USING (sub) WHERE rnk > 9 GROUP BY ALL")


def _pc(src, keys):
    return f"""SELECT {keys}, CASE WHEN any_value(tot) > 0 THEN max(CASE WHEN r = 1 THEN -480.0 + i*240 END) END AS pk, CASE WHEN any_value(tot) > 0 THEN sum(fy*(-480.0 + i*240))/any_value(tot) END AS ct FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY fy DESC, i) AS r, sum(fy) OVER (PARTITION BY {keys}) AS tot FROM (SELECT {keys}, i, sum(f) AS fy FROM {src} GROUP BY ALL)) GROUP BY {keys}"""


def _mk(src, keys):
    return f"""SELECT {keys}, j, i FROM (SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY {keys}) AS hit FROM (
      SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY g DESC RANGE UNBOUNDED PRECEDING) AS c, dense_rank() OVER (PARTITION BY {keys} ORDER BY g DESC) AS ord,
        sum(g) OVER (PARTITION BY {keys}) AS tot FROM (SELECT {keys}, j, i, greatest(f, 0) AS g FROM {src}))) WHERE ord <= hit AND tot > 0"""


cte("em_pc", _pc("em", "run_id, draw, n"))
cte("er_pc", _pc("er", "run_id, draw"))
cte("em_mk", _mk("em", "run_id, draw, n"))
cte("er_mk0", _mk("er", "run_id, draw"))
cte("er_mk", "SELECT run_id, draw, n, j, i FROM er_mk0 CROSS JOIN (SELECT unnest(range(1, 10)) AS n)")
cte("e_ov", """
SELECT run_id, draw, n, sum(CASE WHEN c = 2 THEN 1 ELSE 0 END)/count(*) AS ov FROM (
  SELECT run_id, draw, n, j, i, count(*) AS c FROM (SELECT * FROM em_mk UNION ALL SELECT * FROM er_mk) GROUP BY ALL) GROUP BY ALL""")
cte("e_sc", """
SELECT a.run_id, a.draw, a.n, abs(a.pk - r.pk)::DOUBLE AS d_peak, abs(a.ct - r.ct) AS d_centroid, coalesce(ov, 0) AS overlap
FROM em_pc a JOIN er_pc r ON r.run_id = a.run_id AND r.draw = a.draw LEFT JOIN e_ov o ON o.run_id = a.run_id AND o.draw = a.draw AND o.n = a.n""")
cte("e_conv0", """
SELECT run_id, n, avg(overlap) AS overlap, count(*) FILTER (WHERE d_peak IS NULL) AS undefined, count(*) AS draws, quantile_cont(d_peak, 0.5) AS d_peak_p50,
  quantile_cont(d_peak, 0.9) AS d_peak_p90, quantile_cont(d_centroid, 0.5) AS d_centroid_p50, quantile_cont(d_centroid, 0.9) AS d_centroid_p90 FROM e_sc GROUP BY run_id, n""")
_CONV_D = {"overlap": 7, "d_peak_p50": 4, "d_peak_p90": 4, "d_centroid_p50": 3, "d_centroid_p90": 3}


def scores(t, reference="held-out"):
    packed = materialize(en.pack_maps(coarse_maps(t), RUN, SUBS, ENX, ENY), "submaps")
    drawn = en.draw_maps(packed, en.draw_orders(DRAWS, SUBS), RUN, SUBS, reference)
    return en.draw_scores(drawn, RUN, ENX, ENY, EX, ERES)


@query(
    "convergence",
    """SELECT * REPLACE (n::INTEGER AS n), min(CASE WHEN d_peak_p90 <= 480 THEN n END::INTEGER) OVER (PARTITION BY run_id) AS n_peak, min(CASE WHEN d_centroid_p90 <= 400 THEN n END::INTEGER) OVER (PARTITION BY run_id) AS n_centroid
    FROM e_conv0""",
    _CONV_D,
)
def _(t):
    return en.convergence(scores(t), RUN, 480.0, 400.0)


# fixed held-out reference: always the second half of the window
cte("fm0", """
SELECT draw, sub, row_number() OVER (PARTITION BY draw ORDER BY rnk) AS rnk FROM members WHERE sub < 9""")
cte("fm", """
SELECT run_id, draw, n, j, i, sum(f)/n AS f FROM emap JOIN fm0 USING (sub) JOIN (SELECT unnest(range(1, 10)) AS n) q ON rnk <= n GROUP BY run_id, draw, n, j, i""")
cte("frr", "SELECT run_id, j, i, sum(f)/9 AS f FROM emap WHERE sub >= 9 GROUP BY ALL")
cte("fm_pc", _pc("fm", "run_id, draw, n"))
cte("fr_pc", _pc("frr", "run_id"))
cte("fm_mk", _mk("fm", "run_id, draw, n"))
cte("fr_mk0", _mk("frr", "run_id"))
cte("fr_mk", "SELECT run_id, draw, n, j, i FROM fr_mk0 CROSS JOIN (SELECT unnest(range(0, 20)) AS draw) CROSS JOIN (SELECT unnest(range(1, 10)) AS n)")
cte("f_ov", """
SELECT run_id, draw, n, sum(CASE WHEN c = 2 THEN 1 ELSE 0 END)/count(*) AS ov FROM (
  SELECT run_id, draw, n, j, i, count(*) AS c FROM (SELECT * FROM fm_mk UNION ALL SELECT * FROM fr_mk) GROUP BY ALL) GROUP BY ALL""")


@query(
    "ensemble_report",
    """WITH s AS (SELECT a.run_id, a.draw, a.n, abs(a.pk - r.pk)::DOUBLE AS d_peak, abs(a.ct - r.ct) AS d_centroid, coalesce(ov, 0) AS overlap
      FROM fm_pc a JOIN fr_pc r ON r.run_id = a.run_id LEFT JOIN f_ov o ON o.run_id = a.run_id AND o.draw = a.draw AND o.n = a.n),
    g AS (SELECT run_id, n, avg(overlap) AS overlap, count(*) FILTER (WHERE d_peak IS NULL) AS undefined, count(*) AS draws, quantile_cont(d_peak, 0.5) AS d_peak_p50,
      quantile_cont(d_peak, 0.9) AS d_peak_p90, quantile_cont(d_centroid, 0.5) AS d_centroid_p50, quantile_cont(d_centroid, 0.9) AS d_centroid_p90 FROM s GROUP BY run_id, n)
    SELECT * REPLACE (n::INTEGER AS n), min(CASE WHEN d_peak_p90 <= 480 THEN n END::INTEGER) OVER (PARTITION BY run_id) AS n_peak, min(CASE WHEN d_centroid_p90 <= 400 THEN n END::INTEGER) OVER (PARTITION BY run_id) AS n_centroid FROM g""",
    _CONV_D,
)
def _(t):
    return en.convergence(scores(t, "fixed"), RUN, 480.0, 400.0)


# ---- incremental -----------------------------------------------------------------------
def td_stream(t):
    """Touchdown events as a file stream; their runs come from the static orders."""
    path = f"{t.sf_dir}/lineitem.parquet"
    li = inc.stream_parquet(t.spark, path, t.raw("lineitem").schema)
    return t.touchdown_columns(li).join(t.releases.select("particle", "run_id"), "particle")


def windowed(t, name, length):
    keys = ["run_id", "win_start", "j", "i"]
    frames = materialize(framed(t), "framed")

    def parts(batch):
        s = inc.footprint_windows(batch, frames, DOM, length)
        return s.select("run_id", F.unix_seconds("win.start").alias("win_start"), "j", "i", "flux", "conc")

    return inc.summed(t.spark, inc.run_updates(td_stream(t), inc.shared_folder(t.spark, name), parts), keys, ["flux", "conc"])


def _win_sql(sec):
    return f"""SELECT run_id, CAST(floor(t_release/{sec}) AS BIGINT)*{sec} AS win_start, (CAST(floor(cv) AS BIGINT) + dj + 64) % 64 AS j, (CAST(floor(cu) AS BIGINT) + di + 64) % 64 AS i,
      sum(wt_f*p) AS flux, sum(wt_c*p) AS conc FROM (
      SELECT *, CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END AS p
      FROM (SELECT run_id, t_release, wt_f, wt_c, xm/24.0 + 32.0 AS cu, ym/24.0 + 32.0 AS cv FROM wt), (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) GROUP BY ALL"""


@query("stream_footprint_30min", _win_sql(1800), {"flux": 6, "conc": 8})
def _(t):
    return windowed(t, "footprint", "30 minutes")


@query("stream_subwindows", _win_sql(150), {"flux": 6, "conc": 8})
def _(t):
    return windowed(t, "subwindows", "150 seconds")


def cell_stream(t):
    """Gridded dumps as a file stream, through the same projection as the batch table."""
    from ..sources.fixtures import Tables

    class Live(Tables):
        def raw(self, name):
            return inc.stream_parquet(self.spark, f"{self.sf_dir}/{name}.parquet", t.raw(name).schema)

    return Live(t.spark, t.sf_dir).cells


def closed_planes(t, name):
    """Sums of all planes of the stream: those that left the state, compacted, and those still open."""
    folder = inc.shared_folder(t.spark, name)
    closing.run_parts(closing.plane_parts(cell_stream(t), PLANE * PLANE), folder)
    closing.compact(t.spark, folder)
    return closing.planes_so_far(t.spark, folder)


@query("stream_k0k1", "SELECT * FROM k0k1", {"ww0": 8, "ww1": 8, "ratio": 6})
def _(t):
    return inc.gate_status(closing.gates(closed_planes(t, "k0k1")))


@query(
    "stream_profile_means",
    """SELECT run_id, k, avg(mU) AS "U", avg(mV) AS "V", avg(ww) AS ww, avg(mE) AS "E", count(*) AS n_dumps FROM prof GROUP BY run_id, k""",
    {"U": 7, "V": 7, "ww": 8, "E": 8},
)
def _(t):
    return inc.window_means(closing.profiles(closed_planes(t, "profiles")))
