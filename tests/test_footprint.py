import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.functions.geometry import Domain
from windprint.operators import ensemble, footprint as fp
from windprint.plans import reports

DOM = Domain(nx=16, ny=16, dx=10.0, i_r=8, j_r=8)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    rel, td = [], []
    for run, n in (("hot", 300), ("cold", 60), ("quiet", 20)):
        for p in range(n):
            rel.append((run, p, 900.0 + (p * 37) % 600, 5.0 + rng.normal() * 0.3, rng.normal() * 0.2, 0.3 + rng.normal() * 0.2))
            for _ in range(0 if run == "quiet" else rng.poisson(3)):
                td.append((run, 0, p, DOM.xr - rng.exponential(60), DOM.yr + rng.normal() * 30, abs(rng.normal()) * 0.3, rng.uniform(10, 900)))
    releases = spark.createDataFrame(rel, "run_id string, particle long, t_release double, rel_u double, rel_v double, rel_w double")
    touch = spark.createDataFrame(td, "run_id string, site long, particle long, td_x double, td_y double, td_w double, td_age double")
    return touch.cache(), releases.cache()


def weighted(tables):
    touch, releases = tables
    return fp.weigh(touch, fp.framed_releases(releases, fp.release_frames(releases)), DOM)


def test_deposition_conserves_weight(tables):
    w = weighted(tables)
    want = {r.run_id: r.s for r in w.groupBy("run_id").agg(F.sum("wt_f").alias("s")).collect()}
    got = {r.run_id: r.s for r in fp.deposit_static(w, DOM).groupBy("run_id").agg(F.sum("flux").alias("s")).collect()}
    assert got == pytest.approx(want)


def test_open_grid_drops_what_falls_outside(tables):
    w = weighted(tables)
    args = (["run_id"], F.col("x_up"), F.col("y_cross"), 0.0, -50.0, 10.0, 10, 10)
    closed = fp.deposit_cic(w, *args).agg(F.sum("conc")).first()[0]
    opened = fp.deposit_cic(w, *args, periodic=False).agg(F.sum("conc")).first()[0]
    assert 0 < opened < closed


def test_one_pass_account_equals_separate_operators(tables):
    touch, releases = tables
    parts = reports.compute_footprint(touch, releases, None, DOM)
    w, frames = weighted(tables), fp.release_frames(releases)
    m = {(r.run_id, r.j, r.i): r.f for r in fp.density(fp.deposit_static(w, DOM), frames, ["run_id"], DOM.area).collect()}
    assert {(r.run_id, r.j, r.i): r.f for r in parts["map"].collect()} == pytest.approx(m)
    fy = {(r.run_id, r.bin): r.f for r in fp.fy_histogram(w, frames, ["run_id"], DOM).collect()}
    assert {(r.run_id, r.bin): r.f for r in parts["fy"].collect()} == pytest.approx(fy)
    cap = {(r.run_id, r.mark): r.integral for r in fp.capture_curve(w, frames, DOM).collect()}
    assert {(r.run_id, r.mark): r.integral for r in parts["capture"].collect()} == pytest.approx(cap)
    s = {r.run_id: r for r in parts["scalars"].collect()}
    for run in ("hot", "cold"):
        assert s[run].integral_all == pytest.approx(cap[(run, 900.0)])


def test_releases_without_touchdown_count(tables):
    f = {r.run_id: r.n_particles for r in fp.release_frames(tables[1]).collect()}
    assert f == {"hot": 300, "cold": 60, "quiet": 20}


def test_runs_without_touchdown_stay_in_every_result(spark, tables):
    touch, releases = tables
    w, frames = weighted(tables), fp.release_frames(releases)
    runs = {"hot", "cold", "quiet"}
    srf = spark.createDataFrame([(0, j, i, False, i > 7, 40) for j in range(16) for i in range(16)], "site long, j long, i long, water boolean, array boolean, lcclass int")
    disp = fp.by_displacement(w, frames, DOM).toPandas()
    assert set(disp["run_id"]) == runs and (disp[disp["run_id"] == "quiet"]["integral"] == 0).sum() == len(fp.DISP_FRACTIONS)
    cover = fp.cover_share(w, srf, frames).collect()
    assert {r.run_id for r in cover} == runs and [r[1:] for r in cover if r.run_id == "quiet"] == [(None, None, None)]
    assert {r.run_id: r.n_touchdown > 0 for r in fp.wrapped_fraction(w, frames).collect()} == {"hot": True, "cold": True, "quiet": False}
    sweep = {(r.run_id, r.t_back): r for r in fp.frame_sweep(touch, releases, DOM, (900.0, 1200.0)).collect()}
    quiet = sweep["quiet", 900.0]
    assert {k[0] for k in sweep} == runs and quiet[2:] == (20, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    tail = {r.run_id: r[1:] for r in fp.tail_share(w, fp.deposit_static(w, DOM), totals=frames).collect()}
    assert set(tail) == runs and tail["quiet"] == (None, 0.0, 0)
    parts = reports.compute_footprint(touch, releases, srf, DOM)
    assert {r.run_id: r.n_particles for r in parts["scalars"].collect()} == {"hot": 300, "cold": 60, "quiet": 20}
    assert {r.run_id for r in parts["by_disp"].collect()} == {r.run_id for r in parts["cover"].collect()} == runs


def test_report_keeps_runs_without_touchdown_or_parameters(spark, tables):
    rows = [(run, 5.0, 800.0, 0.4, 5.0, -100.0, 0.8, 0.0) for run in ("hot", "quiet")]
    params = spark.createDataFrame(rows, "run_id string, zm double, h double, ustar double, u_mean double, L double, sigma_v double, yaw double")
    got = {r.run_id: r for r in reports.footprint_report(*tables, params, DOM).collect()}
    assert set(got) == {"hot", "cold", "quiet"}
    assert got["hot"].integral_les != 0 and got["hot"].integral_kljun > 0 and got["hot"].overlap_kljun is not None
    assert got["cold"].integral_les != 0 and got["cold"].integral_kljun is None and got["cold"].peak_kljun is None and got["cold"].overlap_kljun is None
    q = got["quiet"]
    assert (q.n_particles, q.integral_les, q.wrapped_fraction) == (20, 0.0, 0.0) and q.area80_ha is None and q.peak_x is None and q.integral_kljun > 0


def test_halves_sum_to_the_whole(tables):
    w = weighted(tables)
    whole = fp.deposit_static(w, DOM).agg(F.sum("flux")).first()[0]
    parts = fp.deposit_static(w, DOM, ["run_id", "half"]).agg(F.sum("flux")).first()[0]
    assert whole == pytest.approx(parts)


def test_overlap_with_itself_is_one_and_l1_zero(tables):
    f = fp.density(fp.deposit_static(weighted(tables), DOM), fp.release_frames(tables[1]), ["run_id"], DOM.area)
    assert {r.overlap for r in fp.overlap(f, f, ["run_id"]).collect()} == {1.0}
    assert {r.l1 for r in fp.shape_l1(f, f, ["run_id"]).collect()} == {0.0}


def test_bounded_and_unbounded_source_areas_agree(tables):
    f = fp.density(fp.deposit_static(weighted(tables), DOM), fp.release_frames(tables[1]), ["run_id"], DOM.area)
    a = fp.source_area(f, ["run_id"], 0.8).select("run_id", "j", "i")
    b = fp.source_area(f, ["run_id"], 0.8, bounded=False).select("run_id", "j", "i")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_draws_are_permutations(spark):
    m = ensemble.draw_members(spark, 7, 6).groupBy("draw").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.sort_array(F.collect_list("sub")).alias("s"))
    assert all(r.r == [1, 2, 3, 4, 5, 6] and r.s == [0, 1, 2, 3, 4, 5] for r in m.collect())


def test_short_windows_are_reported(spark):
    w = spark.createDataFrame([("a", 0.0, 100.0), ("b", 0.0, 10.0)], "run_id string, t_start double, t_end double")
    assert [r.run_id for r in fp.check_windows(w, 20.0).collect()] == ["b"]
    plan = fp.release_plan(w, 3, 4.0, 20.0)
    assert plan.where("run_id = 'a'").count() == 63 and plan.where("run_id = 'b'").count() == 0
