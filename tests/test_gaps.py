"""Holes, marks close together, long tails and runs that arrive out of order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.operators import ensemble, levels, rasters
from windprint.operators import footprint as fp
from windprint.functions.geometry import Domain
from windprint.streaming import incremental as inc


def test_stencils_stop_at_a_hole(spark):
    cells = spark.createDataFrame([("s", 0, i, float(i * i)) for i in range(7) if i != 3], "site string, j long, i long, v double")
    slope = {r.i: r.gx for r in rasters.edge_slope(cells, ["site"], "v", 1.0).collect()}
    assert slope[2] == 3.0 and slope[4] == 9.0 and slope[1] == 2.0  # one-sided beside the hole
    smooth = {r.i: r.v for r in rasters.smooth121(cells, ["site"], "v", 1).collect()}
    assert smooth[2] == 4.0 and smooth[4] == 16.0 and smooth[1] == 0.25 * 0 + 0.5 * 1 + 0.25 * 4


def test_gradient_and_correlation_stop_at_a_missing_level(spark):
    cells = spark.createDataFrame([("r", 0, k, 0, 0, float(k * k)) for k in range(6) if k != 2], "run_id string, step long, k long, j long, i long, f double")
    lv = spark.createDataFrame([("r", k, float(k), 1.0) for k in range(6)], "run_id string, k long, z double, dz double")
    g = {r.k: r.df_dz for r in levels.vertical_gradient(cells, lv, ["f"]).collect()}
    assert g[1] == 1.0 and g[3] == 7.0 and g[4] == 8.0
    row = spark.createDataFrame([("r", 0, 0, 0, i, float(v)) for i, v in ((0, 1), (1, 2), (3, 9))], "run_id string, step long, k long, j long, i long, w double")
    x = np.array([1.0, 2.0, 9.0])
    want = (x[0] - x.mean()) * (x[1] - x.mean()) / x.var()
    assert levels.lag1_autocorr(row).first().corr_x == pytest.approx(want)


def test_missing_sub_window_is_a_gap(spark):
    m = spark.createDataFrame([("r", s, v) for s, v in ((0, 1.0), (1, 3.0), (3, 2.0), (4, 6.0))], "run_id string, sub long, x double")
    r = ensemble.lag_autocorr(m, ["run_id"], "sub", ["x"], 1).first()
    d = np.array([1.0, 3.0, 2.0, 6.0]) - 3.0
    assert r.windows == 5 and r.x_lag1 == pytest.approx((d[0] * d[1] + d[2] * d[3]) / (d * d).sum())


def touchdowns(spark, runs, n=40):
    rng = np.random.default_rng(7)
    td, rel = [], []
    for k, (run, start) in enumerate(runs):
        for p in range(n):
            t = float(start + 60 * p)
            rel.append((run, k * n + p, t, 3.0, 1.0, 0.1))
            td.append((run, k * n + p, *map(float, rng.uniform(-200, 200, 2)), -0.5, float(rng.uniform(0, 800)), t))
    return td, rel


def test_marks_close_together_stay_apart(spark):
    dom = Domain()
    w = spark.createDataFrame(
        [("r", 1, 1.0, 1.0, 10.0, 5.0, a, False, 3.0, 4.0) for a in (300.1, 300.3, 500.0)],
        "run_id string, half int, wt_f double, wt_c double, x_up double, disp double, td_age double, wrapped boolean, xm double, ym double",
    )
    acc = fp.accumulate(w, dom, marks=(300.2, 300.4), t_back=900.0).where("kind = 'age'").groupBy("a").agg(F.sum("n").alias("n"))
    assert {r.a: r.n for r in acc.collect()} == {0: 1, 1: 2, 2: 3}


def test_tail_share_has_no_cap(spark):
    w = spark.range(3_000_000).select(F.lit("r").alias("run_id"), (F.col("id") % 1000 + 1).cast("double").alias("wt_f"))
    cells = spark.createDataFrame([("r", 1.0)], "run_id string, flux double")
    assert fp.tail_share(w, cells).first().top0p1pct_share == 3000 * 1000.0


def test_runs_out_of_order_lose_nothing(spark, tmp_path, monkeypatch):
    """Three runs, each beginning its own model time anew, in three files."""
    rows = [(run, float(t), float(x)) for run in "zxy" for t in range(900, 2700, 100) for x in (1, 2)]
    df = spark.createDataFrame(rows, "run_id string, t_release double, flux double")
    src = tmp_path / "in"
    src.mkdir()
    for run in "zxy":
        df.where(F.col("run_id") == run).toPandas().to_parquet(src / f"{run}.parquet")
    monkeypatch.setattr(inc.fp, "weigh", lambda batch, framed, dom: batch)
    monkeypatch.setattr(inc.fp, "deposit_static", lambda w, dom, keys: w.groupBy(*keys).agg(F.sum("flux").alias("flux")))

    def parts(batch):
        return inc.footprint_windows(batch, None, None, "30 minutes").select("run_id", F.unix_seconds("win.start").alias("win"), "flux")

    stream = inc.stream_parquet(spark, str(src), df.schema, files_per_trigger=1)
    table = inc.run_updates(stream, str(tmp_path / "out"), parts)
    got = {(r.run_id, r.win): r.flux for r in inc.summed(spark, table, ["run_id", "win"], ["flux"]).collect()}
    want = {(r.run_id, r.win): r.flux for r in parts(df).collect()}
    assert got == want and len(got) == 6
