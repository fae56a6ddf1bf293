"""Interpolation joins, recorded tracks, storage precision and log texts."""

from pyspark.sql import functions as F

from ..functions.numeric import half_precision, pack16, unpack16
from ..operators import footprint as fp, interp, levels as lv, tracks as tr
from ..operators.interp import Axis
from ..sources import planes, text
from ..sources.fixtures import LEVELS, PLANE
from .registry import cte, query
from .shared import DOM, RUN, framed, frames, static_map

# ---- 4-D, 3-D and 1-D sampling ------------------------------------------------------
cte("p4", """
SELECT 'r' || ((o_orderkey // 384) // 16) AS run_id, o_orderkey AS pid, CAST((o_orderkey*37) % 1700 - 50 AS DOUBLE)/100 AS ft, CAST((o_orderkey*53) % 700 - 50 AS DOUBLE)/100 AS fk,
  CAST((o_orderkey*71) % 1600 - 400 AS DOUBLE)/100 AS fj, CAST((o_orderkey*89) % 1600 - 400 AS DOUBLE)/100 AS fi FROM orders""")
cte("nsteps", "SELECT run_id, count(DISTINCT step) AS nt FROM fx_cells GROUP BY run_id")
cte("p4c", """
SELECT run_id, pid, least(greatest(ft, 0), nt - 1) AS ct, least(greatest(fk, 0), 5) AS ck, fj, fi, nt FROM p4 JOIN nsteps USING (run_id)""")
cte("p4b", """
SELECT *, least(greatest(CAST(floor(ct) AS BIGINT), 0), greatest(nt - 2, 0)) AS t0, least(greatest(CAST(floor(ck) AS BIGINT), 0), 4) AS k0,
  CAST(floor(fj) AS BIGINT) AS j0, CAST(floor(fi) AS BIGINT) AS i0 FROM p4c""")
cte("c4", """
SELECT run_id, pid, least(t0 + dt, nt - 1) AS step, k0 + dk AS k, ((j0 + dj) % 8 + 8) % 8 AS j, ((i0 + di) % 8 + 8) % 8 AS i,
  CASE WHEN dt = 1 THEN ct - t0 ELSE 1 - (ct - t0) END * CASE WHEN dk = 1 THEN ck - k0 ELSE 1 - (ck - k0) END
  * CASE WHEN dj = 1 THEN fj - j0 ELSE 1 - (fj - j0) END * CASE WHEN di = 1 THEN fi - i0 ELSE 1 - (fi - i0) END AS w
FROM p4b, (VALUES (0), (1)) a(dt), (VALUES (0), (1)) b(dk), (VALUES (0), (1)) c(dj), (VALUES (0), (1)) d(di)""")
_I4 = """
SELECT run_id, pid, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*u) END AS u, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*v) END AS v,
  CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*w_) END AS w, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*tke) END AS tke
FROM (SELECT p.run_id, pid, CASE WHEN u IS NOT NULL THEN p.w END AS q, u, v, w_, tke FROM c4 p
  LEFT JOIN (SELECT run_id, step, k, j, i, u, v, w AS w_, tke FROM fx_cells) c USING (run_id, step, k, j, i) WHERE p.w <> 0) GROUP BY run_id, pid"""
VALS = ["u", "v", "w", "tke"]
AX_K, AX_J, AX_I = Axis("fk", "k", LEVELS), Axis("fj", "j", PLANE, "wrap"), Axis("fi", "i", PLANE, "wrap")
AX_T = Axis("ft", "step", "nt")


def points4(t, dumps=None):
    k = F.col("o_orderkey")
    n = F.floor(k / (PLANE * PLANE * LEVELS))
    num = lambda m, mod, off: ((k * m % mod - off).cast("double") / 100.0)
    p = t.raw("orders").select(
        F.concat(F.lit("r"), F.floor(n / 16).cast("string")).alias("run_id"),
        k.alias("pid"),
        num(37, 1700, 50).alias("ft"),
        num(53, 700, 50).alias("fk"),
        num(71, 1600, 400).alias("fj"),
        num(89, 1600, 400).alias("fi"),
    )
    nt = (t.cells if dumps is None else dumps).select("run_id", "step").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("nt"))
    return p.join(nt, "run_id")


def dump_planes(t):
    return planes.stored_planes(t.spark, f"{t.sf_dir}/cells", lambda: t.cells, ["run_id", "step", "k"], PLANE, VALS)


@query("interp4", _I4, {c: 7 for c in VALS})
def _(t):
    stored = dump_planes(t)
    return interp.interpolate_planes(points4(t, stored), stored, RUN, "pid", [AX_T, AX_K], AX_J, AX_I, PLANE, PLANE, VALS, planes.touched)


@query(
    "interp4_planes",
    """WITH fp AS (SELECT run_id, step, k FROM fx_cells GROUP BY ALL HAVING count(*) = 64)
    SELECT run_id, pid, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*u) END AS u, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*tke) END AS tke
    FROM (SELECT p.run_id, pid, CASE WHEN u IS NOT NULL THEN p.w END AS q, u, tke FROM c4 p
      LEFT JOIN (SELECT run_id, step, k, j, i, u, tke FROM fx_cells JOIN fp USING (run_id, step, k)) c USING (run_id, step, k, j, i) WHERE p.w <> 0) GROUP BY run_id, pid""",
    {"u": 7, "tke": 7},
)
def _(t):
    stored = dump_planes(t)
    whole = stored.where(F.size("at") == PLANE * PLANE)
    return interp.interpolate_planes(points4(t, stored), whole, RUN, "pid", [AX_T, AX_K], AX_J, AX_I, PLANE, PLANE, ["u", "tke"], planes.touched)


@query(
    "interp3",
    """SELECT run_id, pid, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*ustar) END AS ustar, CASE WHEN sum(q) > 1 - 1e-9 THEN sum(q*z0m) END AS z0m FROM (
      SELECT run_id, pid, CASE WHEN ustar IS NOT NULL THEN w END AS q, ustar, z0m FROM (
      SELECT run_id, pid, least(t0 + dt, nt - 1) AS step, ((j0 + dj) % 8 + 8) % 8 AS j, ((i0 + di) % 8 + 8) % 8 AS i,
        CASE WHEN dt = 1 THEN ct - t0 ELSE 1 - (ct - t0) END * CASE WHEN dj = 1 THEN fj - j0 ELSE 1 - (fj - j0) END * CASE WHEN di = 1 THEN fi - i0 ELSE 1 - (fi - i0) END AS w
      FROM p4b, (VALUES (0), (1)) a(dt), (VALUES (0), (1)) c(dj), (VALUES (0), (1)) d(di)) LEFT JOIN fx_surface_dumps USING (run_id, step, j, i) WHERE w <> 0) GROUP BY run_id, pid""",
    {"ustar": 7, "z0m": 7},
)
def _(t):
    stored = planes.stored_planes(t.spark, f"{t.sf_dir}/surface", lambda: t.surface_dumps, ["run_id", "step"], PLANE, ["ustar", "z0m"])
    return interp.interpolate_planes(points4(t, stored), stored, RUN, "pid", [AX_T], AX_J, AX_I, PLANE, PLANE, ["ustar", "z0m"], planes.touched)


cte("lv_arr", """
SELECT run_id, list(z ORDER BY k) AS zs, list(k::DOUBLE ORDER BY k) AS ks, list(mU ORDER BY k) AS us FROM mprof JOIN lvl USING (run_id, k) GROUP BY run_id""")


@query(
    "interp1",
    """SELECT run_id, pid, zq, ks[lo] + (ks[lo+1] - ks[lo])*f AS fk, us[lo] + (us[lo+1] - us[lo])*f AS u FROM (
      SELECT *, least(greatest((zq - zs[lo])/(zs[lo+1] - zs[lo]), 0), 1) AS f FROM (
        SELECT run_id, pid, zq, zs, ks, us, least(greatest(len(list_filter(zs, lambda q: q <= zq)), 1), len(zs) - 1) AS lo
        FROM (SELECT run_id, pid, fk*12 AS zq FROM p4) JOIN lv_arr USING (run_id)))""",
    {"zq": 6, "fk": 7, "u": 7},
)
def _(t):
    mean = lv.mean_profiles(lv.dump_profiles(t.cells)).join(lv.levels_table(t.cells), ["run_id", "k"])
    arr = interp.level_arrays(mean.withColumn("kd", F.col("k").cast("double")), RUN, "z", ["kd", "U"])
    p = points4(t).select("run_id", "pid", (F.col("fk") * 12).alias("zq"))
    out = interp.at_height(p, arr, RUN, "zq", "z_arr", ["kd_arr", "U_arr"])
    return out.select("run_id", "pid", "zq", F.col("kd_arr_at").alias("fk"), F.col("U_arr_at").alias("u"))


# ---- tracks --------------------------------------------------------------------------
cte("tr_age", """
SELECT *, t - first_value(t) OVER w AS age, sqrt(pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2)) AS disp,
  lag(z) OVER w AS pz, lag(t) OVER w AS pt FROM fx_tracks WINDOW w AS (PARTITION BY particle ORDER BY t, seq)""")
cte("tr_td", """
SELECT particle, seq, x AS td_x, y AS td_y, abs((z - pz)/(t - pt)) AS td_w, age AS td_age, disp FROM tr_age WHERE z < 2 AND pz >= 2""")


@query("track_touchdowns", "SELECT * FROM tr_td", {"td_w": 9, "td_age": 3, "disp": 6})
def _(t):
    return tr.track_touchdowns(t.tracks)


@query(
    "track_retire",
    """SELECT particle, seq, z, age, disp FROM tr_age LEFT JOIN (
      SELECT particle, min((age, seq)) AS stop FROM tr_age WHERE disp > 950 OR age >= 1500000 GROUP BY particle) USING (particle)
    WHERE stop IS NULL OR (age, seq) <= stop""",
    {"age": 3, "disp": 6},
)
def _(t):
    return tr.retire(t.tracks, 950.0, 1500000.0).select("particle", "seq", "z", "age", "disp")


_PQ = ", ".join(f"quantile_cont(age, {p}) AS p{round(100 * p)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(
    "transit_quantiles",
    f"""WITH f AS (SELECT particle % 3 AS grp, particle, min(td_age) AS age FROM tr_td GROUP BY ALL), n AS (SELECT particle % 3 AS grp, count(DISTINCT particle) AS n FROM fx_tracks GROUP BY 1)
    SELECT n.grp, n AS n_particles, count(age)/n::DOUBLE AS fraction, {_PQ} FROM n LEFT JOIN f ON f.grp = n.grp GROUP BY n.grp, n""",
    {"fraction": 7, **{f"p{q}": 2 for q in (5, 25, 50, 75, 95)}},
)
def _(t):
    grp = (F.col("particle") % 3).alias("grp")
    n = t.tracks.select(grp, "particle").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n_particles"))
    return tr.transit_quantiles(tr.track_touchdowns(t.tracks).select(grp, "particle", "td_age"), n, ["grp"])


@query(
    "wellmixed_gate",
    """WITH e AS (SELECT particle % 3 AS grp, arg_min(z, (t, seq)) AS z0, arg_max(z, (t, seq)) AS z1 FROM fx_tracks GROUP BY particle),
    b AS (SELECT grp, CASE WHEN z0 = 15 THEN 9 ELSE CAST(floor(z0/1.5) AS BIGINT) END AS bin, 1 AS a, 0 AS c FROM e UNION ALL
      SELECT grp, CASE WHEN z1 = 15 THEN 9 ELSE CAST(floor(z1/1.5) AS BIGINT) END, 0, 1 FROM e),
    h AS (SELECT grp, bin, coalesce(sum(a), 0) AS h0, coalesce(sum(c), 0) AS h1 FROM (SELECT DISTINCT grp FROM e) CROSS JOIN (SELECT unnest(range(0, 10)) AS bin)
      LEFT JOIN b USING (grp, bin) GROUP BY ALL),
    g AS (SELECT grp, max(abs(h1/greatest(h0, 1) - 1)) AS max_dev, sqrt(avg(pow(h1/greatest(h0, 1) - 1, 2))) AS rms_dev, sqrt(2/avg(h0)) AS noise,
      sum(CASE WHEN bin < 3 THEN h1 END)/greatest(sum(CASE WHEN bin < 3 THEN h0 END), 1) AS lowest3 FROM h GROUP BY grp)
    SELECT *, CASE WHEN max_dev < greatest(0.1, 4*noise) AND abs(lowest3 - 1) < greatest(0.05, 3*noise) THEN 'PASS' ELSE 'FAIL' END AS gate FROM g""",
    {"max_dev": 7, "rms_dev": 7, "noise": 7, "lowest3": 7},
)
def _(t):
    p = tr.end_states(t.tracks).withColumn("grp", F.col("particle") % 3)
    return tr.wellmixed_gate(tr.height_bins(p, ["grp"], 0.0, 15.0, 10), ["grp"])


@query(
    "seed_bias",
    """WITH s AS (SELECT CASE WHEN (particle // 8) % 2 = 0 THEN 60.0 ELSE 100.0 END::DOUBLE AS lid, particle % 8 AS seed, sum(rel_w*2/greatest(td_w, 0.02)) AS s
        FROM fx_touchdowns JOIN fx_releases USING (run_id, particle) GROUP BY ALL),
    n AS (SELECT CASE WHEN (particle // 8) % 2 = 0 THEN 60.0 ELSE 100.0 END::DOUBLE AS lid, particle % 8 AS seed, count(*) AS n FROM fx_releases GROUP BY ALL),
    g AS (SELECT lid, count(*) AS n, avg(s/n.n) AS mean, stddev_samp(s/n.n) AS sd FROM s JOIN n USING (lid, seed) GROUP BY lid)
    SELECT lid, n, mean, sd, sd/sqrt(n) AS se, 1 - 28/(lid - 2) AS target, (mean - (1 - 28/(lid - 2)))/(sd/sqrt(n)) AS sigmas FROM g""",
    {"mean": 6, "sd": 6, "se": 6, "target": 7, "sigmas": 5},
)
def _(t):
    keys = [F.when(F.floor(F.col("particle") / 8) % 2 == 0, 60.0).otherwise(100.0).alias("lid"), (F.col("particle") % 8).alias("seed")]
    j = t.touchdowns.join(t.releases.select("run_id", "particle", "rel_w"), ["run_id", "particle"])
    s = j.groupBy(*keys).agg(F.sum(F.col("rel_w") * fp.contact_weight(F.col("td_w"))).alias("s"))
    n = t.releases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    est = s.join(n, ["lid", "seed"]).select("lid", "seed", (F.col("s") / F.col("n")).alias("est"))
    return tr.seed_bias(est, ["lid"], tr.slab_target(F.col("lid")))


# ---- storage precision -------------------------------------------------------------------
def half_sql(x):
    ulp = f"pow(2, greatest(floor(log2(greatest(abs({x}), pow(2, -30)))), -14) - 10)"
    return f"round_even({x}/{ulp}, 0)*{ulp}"


@query(
    "fp16_quantise",
    f"""SELECT run_id, step, k, count(*) AS n, sum({half_sql('u')}) AS u16, max(abs({half_sql('u')} - u)) AS du, sum({half_sql('theta')}) AS th16,
      max(abs({half_sql('theta')} - theta)) AS dth, sum({half_sql('w')}) AS w16 FROM fx_cells GROUP BY ALL""",
    {"u16": 6, "du": 8, "th16": 6, "dth": 7, "w16": 7},
)
def _(t):
    q = lambda c: half_precision(F.col(c))
    return t.cells.groupBy("run_id", "step", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(q("u")).alias("u16"),
        F.max(F.abs(q("u") - F.col("u"))).alias("du"),
        F.sum(q("theta")).alias("th16"),
        F.max(F.abs(q("theta") - F.col("theta"))).alias("dth"),
        F.sum(q("w")).alias("w16"),
    )


cte("pack_m", "SELECT run_id, (max(u) - min(u))/65000 AS sc, (max(u) + min(u))/2 AS off FROM fx_cells GROUP BY run_id")


@query(
    "cf_pack",
    """SELECT run_id, step, k, j, i, CAST(round_even((u - off)/sc, 0) AS SMALLINT) AS packed, abs(CAST(round_even((u - off)/sc, 0) AS SMALLINT)*sc + off - u) <= 0.5000001*sc AS within
    FROM fx_cells JOIN pack_m USING (run_id)""",
)
def _(t):
    m = t.cells.groupBy("run_id").agg(((F.max("u") - F.min("u")) / 65000).alias("sc"), ((F.max("u") + F.min("u")) / 2).alias("off"))
    c = t.cells.join(m, "run_id").withColumn("packed", pack16(F.col("u"), F.col("sc"), F.col("off")))
    back = unpack16(F.col("packed"), F.col("sc"), F.col("off"))
    return c.select("run_id", "step", "k", "j", "i", "packed", (F.abs(back - F.col("u")) <= 0.5000001 * F.col("sc")).alias("within"))


cte("wt16", f"""
SELECT run_id, xm/24.0 + 32.0 AS cu, ym/24.0 + 32.0 AS cv, {half_sql('w_release')}*2/greatest({half_sql('td_w')}, 0.02) AS wf FROM wt""")
cte("map16", """
SELECT run_id, j, i, sum(x)/any_value(n_particles)/576.0 AS f FROM (
  SELECT run_id, (CAST(floor(cv) AS BIGINT) + dj + 64) % 64 AS j, (CAST(floor(cu) AS BIGINT) + di + 64) % 64 AS i,
    wf * CASE WHEN di = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END * CASE WHEN dj = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END AS x
  FROM wt16, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)) JOIN frames USING (run_id) GROUP BY run_id, j, i""")


def _mask(src):
    return f"""SELECT run_id, j, i FROM (SELECT *, min(CASE WHEN c >= 0.8*tot THEN ord END) OVER (PARTITION BY run_id) AS hit FROM (
      SELECT *, sum(g) OVER (PARTITION BY run_id ORDER BY g DESC RANGE UNBOUNDED PRECEDING) AS c, dense_rank() OVER (PARTITION BY run_id ORDER BY g DESC) AS ord,
        sum(g) OVER (PARTITION BY run_id) AS tot FROM (SELECT run_id, j, i, greatest(f, 0) AS g FROM {src}))) WHERE ord <= hit AND tot > 0"""


cte("mask16", _mask("map16"))


@query(
    "fp16_ab",
    """WITH o AS (SELECT run_id, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)/count(*) AS overlap FROM (
        SELECT run_id, j, i, count(*) AS n FROM (SELECT * FROM mask16 UNION ALL SELECT * FROM mask_les) GROUP BY ALL) GROUP BY run_id),
    d AS (SELECT run_id, sum(abs(b.f - a.f))/sum(abs(a.f)) AS l1, (sum(b.f) - sum(a.f))*576 AS d_integral FROM fmap a JOIN map16 b USING (run_id, j, i) GROUP BY run_id)
    SELECT run_id, overlap, l1, d_integral FROM o JOIN d USING (run_id)""",
    {"overlap": 9, "l1": 8, "d_integral": 7},
)
def _(t):
    from ..plans import reports

    full = framed(t)
    low = full.withColumn("w_release", half_precision(F.col("w_release")))
    coarse = fp.weigh(t.touchdowns.withColumn("td_w", half_precision(F.col("td_w"))), low, DOM)
    return reports.precision_ab(static_map(t), fp.density(fp.deposit_static(coarse, DOM), frames(t), RUN, DOM.area), DOM)


# ---- logs and case files --------------------------------------------------------------------
@query(
    "log_score",
    """SELECT log_id, count(*) FILTER (WHERE line LIKE '%CORRUPTED%') AS corrupt, count(*) FILTER (WHERE regexp_matches(line, '#NaN|#Inf|[-+\\s](nan|inf)(\\s|$)')) AS not_finite,
      count(*) FILTER (WHERE regexp_matches(line, 'CRITICAL ERROR|_FAIL|MPI_ERR|too many resources|Segmentation')) AS errors,
      count(*) FILTER (WHERE line LIKE '%simulation is complete%') AS banner, 0 AS rc,
      CASE WHEN count(*) FILTER (WHERE line LIKE '%CORRUPTED%' OR regexp_matches(line, '#NaN|#Inf')) = 0 AND count(*) FILTER (WHERE line LIKE '%simulation is complete%') > 0
        THEN 'OK' ELSE 'REJECTED' END AS verdict FROM fx_logs GROUP BY log_id""",
)
def _(t):
    return text.score_log(t.log_lines, ["log_id"])


@query("newest_dump", "SELECT log_id, arg_max(line_no, (ts, line_no)) AS line_no, max(ts) AS ts, arg_max(line, (ts, line_no)) AS line FROM fx_logs GROUP BY log_id")
def _(t):
    p = t.log_lines.groupBy("log_id").agg(F.max(F.struct("ts", "line_no", "line")).alias("m"))
    return p.select("log_id", F.col("m.line_no").alias("line_no"), F.col("m.ts").alias("ts"), F.col("m.line").alias("line"))


cte("case_lines", """
SELECT p_partkey AS kase, unnest(['Description = ' || p_name || ' case', '#--GRID', 'dt = 0.0' || (1 + p_size) || ' # time step', 'dx = ' || (10 + p_size % 20) || '.5 # spacing', 'dy=24',
  'dz = ' || (5 + p_partkey % 7) || '   # level', 'inPath = ./', 'inFile = RST.' || (p_partkey % 5)]) AS line FROM part""")
cte("case_kv", r"""
SELECT kase, regexp_extract(line, '^\s*([A-Za-z]\w*)\s*=\s*([^#]*?)\s*(?:#\s*(.*))?$', 1) AS key, regexp_extract(line, '^\s*([A-Za-z]\w*)\s*=\s*([^#]*?)\s*(?:#\s*(.*))?$', 2) AS value,
  nullif(regexp_extract(line, '^\s*([A-Za-z]\w*)\s*=\s*([^#]*?)\s*(?:#\s*(.*))?$', 3), '') AS comment FROM case_lines""")


def case_lines(t):
    s = lambda c: c.cast("string")
    pk, size = F.col("p_partkey"), F.col("p_size")
    return t.raw("part").select(
        pk.alias("kase"),
        F.explode(
            F.array(
                F.concat(F.lit("Description = "), F.col("p_name"), F.lit(" case")),
                F.lit("#--GRID"),
                F.concat(F.lit("dt = 0.0"), s(size + 1), F.lit(" # time step")),
                F.concat(F.lit("dx = "), s(size % 20 + 10), F.lit(".5 # spacing")),
                F.lit("dy=24"),
                F.concat(F.lit("dz = "), s(pk % 7 + 5), F.lit("   # level")),
                F.lit("inPath = ./"),
                F.concat(F.lit("inFile = RST."), s(pk % 5)),
            )
        ).alias("line"),
    )


@query("case_params", "SELECT * FROM case_kv WHERE key <> ''")
def _(t):
    return text.parse_case(case_lines(t), ["kase"])


@query("case_diff", "SELECT key, count(DISTINCT value) AS n_values, count(*) AS n_cases FROM case_kv WHERE key <> '' GROUP BY key HAVING count(DISTINCT value) > 1")
def _(t):
    return text.differing_keys(text.parse_case(case_lines(t), ["kase"]))


@query(
    "acoustic_cfl",
    """SELECT kase, dt, dx, dy, dz, dt*347.2*sqrt(1/(dx*dx) + 1/(dy*dy) + 1/(dz*dz)) AS cfl FROM (
      SELECT kase, max(CASE WHEN key = 'dt' THEN value::DOUBLE END) AS dt, max(CASE WHEN key = 'dx' THEN value::DOUBLE END) AS dx,
        max(CASE WHEN key = 'dy' THEN value::DOUBLE END) AS dy, max(CASE WHEN key = 'dz' THEN value::DOUBLE END) AS dz
      FROM case_kv WHERE key IN ('dt', 'dx', 'dy', 'dz') GROUP BY kase)""",
    {"cfl": 7},
)
def _(t):
    return text.acoustic_cfl(text.parse_case(case_lines(t), ["kase"]), "kase")


@query(
    "missing_restarts",
    """SELECT kase, './RST.' || (kase % 5) AS name FROM (SELECT p_partkey AS kase FROM part) WHERE './RST.' || (kase % 5) NOT IN (SELECT './RST.' || r_regionkey FROM region WHERE r_name <> 'ASIA')""",
)
def _(t):
    files = t.raw("region").where(F.col("r_name") != "ASIA").select(F.concat(F.lit("./RST."), F.col("r_regionkey").cast("string")).alias("name"))
    return text.missing_restarts(text.parse_case(case_lines(t), ["kase"]), files, "kase")
