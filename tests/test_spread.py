import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.catalog import model
from windprint.functions.geometry import Domain
from windprint.operators import footprint as fp, rasters
from windprint.plans import reports
from windprint.sources import shared_table, spread

DOM = Domain(nx=16, ny=16, dx=10.0, i_r=8, j_r=8)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rel, td = [], []
    for run, n in (("a", 400), ("b", 50)):
        for p in range(n):
            rel.append((run, p * 1000, 900.0 + (p * 37) % 600, 5.0, float(rng.normal()) * 0.2, 0.3 + float(rng.normal()) * 0.2))
            td += [(run, 0, p * 1000, DOM.xr - float(rng.exponential(80)), DOM.yr + float(rng.normal()) * 30, abs(float(rng.normal())) * 0.3, float(rng.uniform(10, 900))) for _ in range(3)]
    # a NULL particle meets no release, a repeated one all of them
    td += [("a", 0, None, 1.0, 1.0, 0.1, 20.0), td[0], td[0]]
    rel.append(rel[0])
    folder = tmp_path_factory.mktemp("with {odd} name")
    spark.createDataFrame(rel, "run_id string, particle long, t_release double, rel_u double, rel_v double, rel_w double").write.parquet(f"{folder}/releases")
    spark.createDataFrame(td, "run_id string, site long, particle long, td_x double, td_y double, td_w double, td_age double").write.parquet(f"{folder}/touch")
    path = str(folder).replace("{", "\\{").replace("}", "\\}")
    return spark.read.parquet(f"{path}/touch"), spark.read.parquet(f"{path}/releases")


def weighted(tables):
    touch, releases = tables
    return fp.weigh(touch, fp.framed_releases(releases, fp.release_frames(releases)), DOM)


def keyed(df, n):
    return {tuple(r)[:n]: pytest.approx(tuple(r)[n:]) for r in df.collect()}


def test_tasks_follow_the_size_of_the_input(tables, spark, monkeypatch):
    assert spread.tasks(*tables) is None
    assert spread.tasks(spark.range(5)) is None
    monkeypatch.setattr(spread, "TASK_BYTES", 1000)
    small = spread.tasks(tables[1])
    monkeypatch.setattr(spread, "TASK_BYTES", 500)
    assert small > 4 and spread.tasks(tables[1]) == pytest.approx(2 * small, abs=1)
    assert weighted(tables).rdd.getNumPartitions() == spread.tasks(*tables) > 4
    assert fp.deposit_static(weighted(tables), DOM).rdd.getNumPartitions() == spread.tasks(*tables)


def test_a_large_session_number_is_named_too(tables, spark, monkeypatch):
    """Tasks that only the session counts are merged by their bytes, so a task grows with the input."""
    monkeypatch.setattr(spread, "TASK_BYTES", 500)
    named = spread.tasks(*tables)
    spark.conf.set("spark.sql.shuffle.partitions", str(named + 50))
    try:
        assert spread.tasks(*tables) == named + 50
        assert fp.deposit_static(weighted(tables), DOM).rdd.getNumPartitions() == named + 50
        monkeypatch.setattr(spread, "TASK_BYTES", 8 << 20)
        assert spread.tasks(*tables) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_neighbours_are_summed_before_they_move(tables, capsys):
    """What moves from a block to the task of a key is one row a cell with one sum a value, not four."""
    cells = fp.deposit_static(weighted(tables), DOM)
    cells.explain()
    lines = capsys.readouterr().out.splitlines()
    fan = next(n for n, line in enumerate(lines) if "explode([0,1,2,3])" in line)
    assert any("Exchange" in line for line in lines[:fan])
    want = {}
    for r in weighted(tables).collect():
        u, v = r.xm / DOM.dx + DOM.i_r, r.ym / DOM.dx + DOM.j_r
        i, j = int(np.floor(u)), int(np.floor(v))
        for dj, di in ((0, 0), (0, 1), (1, 0), (1, 1)):
            part = (v - j if dj else 1 - v + j) * (u - i if di else 1 - u + i)
            at = (r.run_id, (j + dj) % DOM.ny, (i + di) % DOM.nx)
            want[at] = [x + y * part for x, y in zip(want.get(at, [0.0, 0.0]), (r.wt_f, r.wt_c), strict=True)]
    assert {(r.run_id, r.j, r.i): [r.flux, r.conc] for r in cells.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_more_tasks_and_blocks_give_the_same_sums(tables, monkeypatch):
    w = weighted(tables)
    loose = w.drop("particle").cache()  # rows without particles have no blocks
    maps, acc = keyed(fp.deposit_static(loose, DOM, ["run_id", "half"]), 4), keyed(fp.accumulate(loose, DOM), 5)
    monkeypatch.setattr(spread, "TASK_BYTES", 500)
    w = weighted(tables)
    assert maps == {tuple(r)[:4]: tuple(r)[4:] for r in fp.deposit_static(w, DOM, ["run_id", "half"]).collect()}
    assert acc == {tuple(r)[:5]: tuple(r)[5:] for r in fp.accumulate(w, DOM).collect()}
    assert w.agg(F.max(F.floor(F.col("particle") / fp.BLOCK))).first()[0] > 0


def test_thresholds_of_many_maps_take_more_tasks(tables, monkeypatch):
    frames = fp.release_frames(tables[1])
    field = fp.density(fp.deposit_static(weighted(tables), DOM), frames, ["run_id"], DOM.area)
    want = keyed(fp.map_metrics(field, ["run_id"], DOM), 1)
    monkeypatch.setattr(spread, "TASK_BYTES", 500)
    assert fp.with_threshold(field, ["run_id"], {"thr": 0.8}).rdd.getNumPartitions() == spread.tasks(*tables)
    assert want == {tuple(r)[:1]: tuple(r)[1:] for r in fp.map_metrics(field, ["run_id"], DOM).collect()}


def test_an_account_has_three_rows_a_touchdown(tables, capsys):
    """Marks, edges and flags of a touchdown are one row of the account's sums, not one row each."""
    acc = fp.accumulate(weighted(tables), DOM)
    acc.explain()
    fans = [line.count("struct(kind") for line in capsys.readouterr().out.splitlines() if "explode(array(" in line]
    assert fans and max(fans) <= 3
    n = {r.kind: r.n for r in acc.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert n["cell"] == 4 * n["all"] and n["fy"] == n["all"]


def test_flags_beyond_one_word(tables):
    marks = [float(m) for m in range(10, 800, 10)]
    got = fp.accumulate(weighted(tables), DOM, marks=marks).where("kind = 'age'").groupBy("a").agg(F.sum("n").alias("n"))
    ages = [r.td_age for r in weighted(tables).select("td_age").collect()]
    want = {n: sum(a <= m for a in ages) for n, m in enumerate([*marks, 900.0])}
    assert {r.a: r.n for r in got.collect()} == {n: k for n, k in want.items() if k}


def counted(monkeypatch):
    made = []
    real = shared_table.materialize

    def note(df, name):
        made.append(name)
        return real(df, name)

    for module in (rasters, model, reports):
        monkeypatch.setattr(module, "materialize", note)
    return made


def test_surface_and_candidate_are_made_once(spark, monkeypatch):
    from windprint.catalog import QUERIES

    made = counted(monkeypatch)
    QUERIES["swing"](spark, "/root/testdata/sf0.001")
    assert made.count("surface-cells") == 1
    made.clear()
    QUERIES["baseline_verdict"](spark, "/root/testdata/sf0.001")
    assert "candidate" in made


def test_cover_reads_the_touchdowns_once(tables, spark, capsys):
    rows = [(0, j, i, 10 * (1 + (i + j) % 3), i == 3, j == 2) for j in range(16) for i in range(15)]
    # a cell twice, and one of nowhere
    srf = spark.createDataFrame([*rows, (0, 8, 8, 10, False, True), (None, 1, 1, 10, False, True)], "site long, j long, i long, lcclass int, array boolean, water boolean")
    w = weighted(tables)
    cover = fp.cover_share(w, srf)
    cover.explain()
    assert sum("FileScan" in line and "td_w" in line for line in capsys.readouterr().out.splitlines()) == 1
    total, want = {}, {}
    classes = {}
    for _, j, i, lc, arr, water in [*rows, (0, 8, 8, 10, False, True)]:
        classes.setdefault((j, i), []).extend([*(["water"] if water else []), "solar array" if arr else f"class {lc}"])
    for r in w.collect():
        total[r.run_id] = total.get(r.run_id, 0.0) + r.wt_f
        for c in classes.get((r.jj, r.ii), []):
            want[r.run_id, c] = want.get((r.run_id, c), 0.0) + r.wt_f
    got = {(r.run_id, r.cover): r.share for r in cover.collect()}
    assert got == pytest.approx({k: v / total[k[0]] for k, v in want.items()})


def test_surface_of_odd_pixels(spark):
    rows = [(0, j, i, 250.0 + j + i / 7, 10 * (1 + (i + j) % 3)) for j in range(16) for i in range(16) for _ in range(2)]
    rows += [(0, 3, 3, None, None), (0, None, 0, 900.0, 10), (None, 1, 1, 5.0, 10), (0, 4, 4, 100.0, 80)]
    pixels = spark.createDataFrame(rows, "site long, j long, i long, elevation double, lcclass int")
    got = {(r.j, r.i): r for r in rasters.build_surface(pixels, DOM).collect()}
    mean = {(r.j, r.i): r["mean"] for r in rasters.resample_mean(pixels, ["site", "j", "i"], "elevation").where("site = 0").collect()}
    mode = {(r.j, r.i): r.lcclass for r in rasters.resample_mode(pixels, ["site", "j", "i"], "lcclass").where("site = 0").collect()}
    assert len(got) == 256
    assert all(r.elevation == pytest.approx(mean[k]) and r.lcclass == mode[k] for k, r in got.items())
