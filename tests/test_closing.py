"""Streams whose state ends: twenty batches, planes in pieces, late pieces, compaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.streaming import closing
from windprint.streaming import incremental as inc

SCHEMA = "run_id string, step long, k long, j long, i long, u double, v double, w double, tke double"
SIZE = 12


def arriving(spark, folder, batches=20):
    """Two whole planes a batch; a third of one that never ends, and a late cell of a plane closed long before."""
    rng = np.random.default_rng(3)
    for b in range(batches):
        run = "ab"[b % 2]
        rows = [(run, b, k, 0, i, *map(float, rng.normal(size=4))) for k in (0, 1) for i in range(SIZE)]
        rows += [(run, b, 2, 0, i, *map(float, rng.normal(size=4))) for i in range(SIZE // 3)]
        if b > 10:
            rows.append(("b" if b % 2 else "a", b - 10, 2, 1, b, 1.0, 2.0, float("nan") if b == 12 else 3.0, -1.0))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_state_stays_bounded_and_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "cells"), str(tmp_path / "out")
    arriving(spark, src)
    cells = spark.read.schema(SCHEMA).parquet(src)
    stream = inc.stream_parquet(spark, src, cells.schema, files_per_trigger=1)
    progress = closing.run_parts(closing.plane_parts(stream, SIZE, wait_ms=1), out)
    held = [s.numRowsTotal for p in progress for s in p.stateOperators]
    assert len(held) >= 20 and max(held) <= 4 * 3, held  # the open planes of a batch, with their timers; not one for each dump
    want = {(r.run_id, r.step, r.k): r for r in cells.groupBy("run_id", "step", "k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("w")).alias("ok"), F.sum("u").alias("u"), F.sum(F.nanvl("w", F.lit(0.0))).alias("w"), F.sum(F.greatest("tke", F.lit(0.0))).alias("tke")).collect()}

    def same():
        got = closing.planes_so_far(spark, out).collect()
        assert len(got) == len(want) == 60
        for r in got:
            x = want[r.run_id, r.step, r.k]
            assert (r.n, r.ok) == (x.n, x.ok) and (r.u, r.w, r.tke) == pytest.approx((x.u, x.w, x.tke))

    same()
    before = closing.written(spark, out).count()
    assert closing.compact(spark, out) == 1 and closing.written(spark, out).count() < before
    same()
    # a batch folder that is already merged, left by a compaction that was broken off, doesn't count twice
    last = closing._numbers(spark, f"{out}/merged", "upto")[-1]
    closing.written(spark, out).write.parquet(f"{out}/table/batch={last}")
    same()
    assert closing.compact(spark, out) == 1
    same()


def test_gate_and_profiles_from_sums(spark):
    rows = [("r", 0, k, 4, 4, 8.0, 4.0, s, q, 2.0) for k, s, q in ((0, 2.0, 5.0), (1, 0.0, 1.0))]
    planes = spark.createDataFrame(rows, closing._PARTS)
    g = closing.gates(planes).first()
    assert (g.ww0, g.ww1, g.n_bad, g.n_cells) == (1.0, 0.25, 0, 8)
    p = closing.profiles(planes).where("k = 0").first()
    assert (p.U, p.V, p.ww, p.E) == (2.0, 1.0, 1.0, 0.5)
