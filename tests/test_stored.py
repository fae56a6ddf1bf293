"""Reports longer than a split, sinks that are broken off, baselines, and nearest cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.operators import climate, compare, levels as lv
from windprint.sources import sinks, text

HEAD, ROW, OTHER = "the land-cover share table", "  class{}  {}.5%  (domain area share  2.25%)", "end"


def by_hand(lines):
    out, on = [], False
    for x in lines:
        if "land-cover share" in x:
            on = True
        elif on and "(domain area share" not in x:
            break
        elif on:
            out.append(float(x.split("%")[0].split()[-1]))
    return out


@pytest.mark.parametrize("case", ["early", "late", "never shut", "no head", "head again", "shut at once"])
def test_report_longer_than_a_split(spark, tmp_path, case):
    row = lambda a, b: [ROW.format(n % 3, n) for n in range(a, b)]
    lines = {
        "early": [OTHER, HEAD, *row(0, 900), OTHER, *row(900, 3000), HEAD, *row(0, 5)],
        "late": [*row(0, 2500), OTHER, *row(0, 9), HEAD, *row(0, 400), OTHER],
        "never shut": [OTHER, *row(0, 700), HEAD, *row(0, 3000)],
        "no head": [*row(0, 3000), OTHER],
        "head again": [HEAD, *row(0, 1200), HEAD, *row(1200, 2600), OTHER, *row(0, 100)],
        "shut at once": [HEAD, OTHER, *row(0, 3000)],
    }[case]
    path = tmp_path / "long.txt"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = text.split_lines(spark, str(path))
        assert split.select("block").distinct().count() > 5
        got = text.cover_report(split).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.share_pct for r in got) == sorted(by_hand(lines)) and all(r.area_pct == 2.25 for r in got)


def test_sink_survives_broken_attempts(spark, tmp_path):
    path = str(tmp_path / "runs")
    make = lambda rows: spark.createDataFrame(rows, "run_id string, x long")
    whole = [(r, n) for r in "abc" for n in range(10)]
    assert {r.run_id for r in sinks.append_runs(make([x for x in whole if x[0] == "a"]), path).collect()} == {"a"}
    sinks.append_runs(make([("b", 99), ("b", 98)]), path, mark=False)
    assert {(r.run_id, r.x) for r in sinks.read_runs(spark, path).collect()} == {x for x in whole if x[0] == "a"}
    more = make(whole).withColumn("y", F.col("x") * 2.0)
    for _ in range(2):
        sinks.append_runs(more, path)
        got = [(r.run_id, r.x, r.y) for r in sinks.read_runs(spark, path).collect()]
        assert sorted(got, key=str) == sorted([(r, n, None if r == "a" else 2.0 * n) for r, n in whole], key=str)
    sinks.append_runs(make([("a", 5)]), path)
    assert sinks.read_runs(spark, path).count() == 30


def test_newest_accepted_baseline_counts(spark, tmp_path):
    path = str(tmp_path / "base")
    rows = lambda v, runs="ab": spark.createDataFrame([(r, "peak_x", v) for r in runs], "run_id string, metric string, value double")
    sinks.propose(rows(1.0), path, 1)
    sinks.accept(spark, path, 1)
    sinks.propose(rows(5.0, "a"), path, 2)
    now, floor = rows(3.0), spark.createDataFrame([("a", 0.0), ("b", 0.0)], "run_id string, dpeak double")
    value = lambda: {r.run_id: r.value for r in sinks.baseline(spark, path).collect()}
    assert value() == {"a": 1.0, "b": 1.0}
    sinks.accept(spark, path, 2)
    assert value() == {"a": 5.0, "b": 1.0}
    was = sinks.baseline(spark, path).select("run_id", "metric", "value")
    got = {r.run_id: (r["diff"], r.status) for r in compare.verdict(was, now, compare.tolerances(was, floor)).collect()}
    assert got == {"a": (-2.0, "ok"), "b": (2.0, "ok")}


def test_nearest_cells_equal_argmin(spark):
    rng = np.random.default_rng(6)
    axis = np.sort(np.r_[rng.uniform(0, 500, 30), rng.uniform(5_000, 5_400, 20), 700.0, 800.0])
    at = np.r_[rng.uniform(-900, 7_000, 400), axis[:5], 750.0, -1e6, 1e6]
    grid = spark.createDataFrame([(n, float(c)) for n, c in enumerate(axis)], "n long, c double")
    sites = spark.createDataFrame([(f"s{n}", float(x)) for n, x in enumerate(at)], "site string, x double")
    for block in (50.0, 1e4):
        got = {r.site: (r.n, r.offset) for r in climate.nearest_cells(sites, grid, "site", "x", "c", "n", block).collect()}
        for n, x in enumerate(at):
            k = int(np.argmin(np.abs(axis - x)))
            assert got[f"s{n}"][0] == k and got[f"s{n}"][1] == pytest.approx(axis[k] - x)


def test_nearest_cells_of_crowded_blocks(spark):
    """A block of many sites is cut into pieces and costs one pass: no frame is summed anew for every row."""
    sites = spark.range(20_000).select(F.col("id").alias("site"), (F.col("id") * 7919 % 20011 / 20.0).alias("x"))
    axis = spark.createDataFrame([(n, float(c)) for n, c in enumerate([3.0, 250.5, 250.5, 700.0, 990.0, 2500.0, -40.0])], "n long, c double")
    points = axis.collect()
    want = {r.site: min((abs(c.c - r.x), c.n) for c in points) for r in sites.where("site % 400 = 0").collect()}
    for rows in (100_000, 300):
        near = climate.nearest_cells(sites, axis, "site", "x", "c", "n", 1e4, rows)
        assert "currentrow$(), unboundedfollowing$()" not in near._jdf.queryExecution().toString()
        got = {r.site: r for r in near.collect()}
        assert len(got) == 20_000
        for s, w in want.items():
            assert (abs(got[s].offset), got[s].n) == (pytest.approx(w[0]), w[1])


def test_columns_over_terrain(spark):
    zs = [2.0, 6.0, 14.0, 30.0]
    levels = spark.createDataFrame([("r", k, z) for k, z in enumerate(zs)], "run_id string, k long, z double")
    ground = spark.createDataFrame([("r", 0, 0, 0.0), ("r", 0, 1, 9.0)], "run_id string, j long, i long, zg double")
    cells = spark.createDataFrame([("r", 0, k, 0, i, float(10 * k + i)) for k in range(4) for i in range(2) if (k, i) != (2, 0)], "run_id string, step long, k long, j long, i long, u double")
    cols = lv.terrain_columns(levels, ground)
    agl = np.array([z * (30.0 - 9.0) / 30.0 + 9.0 for z in zs]) - 9.0
    got = {(r.i, r.h): r.u for r in lv.regrid_above_ground(cells, cols, (1.0, 8.0, 100.0), ["u"]).collect()}
    for h in (1.0, 8.0, 100.0):
        assert got[1, h] == pytest.approx(np.interp(h, agl, [1.0, 11.0, 21.0, 31.0])) and got[0, h] is None
    r = lv.receptor_height(cols, levels, 13.0, F.lit(0), F.lit(1)).first()
    assert (r.k_r, r.z_r, r.agl_r) == (2, pytest.approx(agl[2] + 9.0), pytest.approx(agl[2]))
