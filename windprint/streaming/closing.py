"""Plane sums of arriving dumps, with state that ends: a plane leaves it when it is whole, or when it has waited long enough.

What leaves is a part: sums that add up, so cells that come after a plane was closed make a second part and nothing is
lost. Parts are written by micro-batch, compacted now and then, and added up with the sums that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared_table import materialize

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["run_id", "step", "k"]
SUMS = ["n", "ok", "u", "v", "w", "ww", "tke"]
_SUMS = "n bigint, ok bigint, u double, v double, w double, ww double, tke double"
_PARTS = f"run_id string, step bigint, k bigint, {_SUMS}"


class PlaneSums(StatefulProcessor):
    """Sums of one plane; ``size`` cells make it whole, ``wait_ms`` after its last cells it is closed as it is."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS)

    def _close(self, key, sums: tuple) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, *sums)], columns=[*KEYS, *SUMS])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums, last = np.array(self.sums.get() if self.sums.exists() else [0.0] * len(SUMS), float), 0
        for f in rows:
            last = max(last, int(f["arrived"].max()))
            w = f["w"].to_numpy(float)
            fine = w[np.isfinite(w)]
            sums += [len(f), len(fine), f["u"].to_numpy(float).sum(), f["v"].to_numpy(float).sum(), fine.sum(), (fine * fine).sum(), np.maximum(f["tke"].to_numpy(float), 0.0).sum()]
        state = (int(sums[0]), int(sums[1]), *map(float, sums[2:]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] >= self.size:
            self.sums.clear()
            yield from self._close(key, state)
        else:
            self.sums.update(state)
            self.handle.registerTimer(last + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            state = self.sums.get()
            self.sums.clear()
            yield from self._close(key, state)

    def close(self) -> None:
        pass


def plane_parts(cells: DataFrame, size: int, wait_ms: int = 600_000) -> DataFrame:
    """Closed parts of a stream of cells (run_id, step, k, u, v, w, tke): its state holds open planes alone.

    The clock of the timers is the time of arrival, the same for all runs, whose model time starts anew in each: it is
    the watermark's column, so no cell is ever late. A NULL counts like a value that isn't finite.
    """
    timed = cells.withColumn("arrival", F.current_timestamp()).withWatermark("arrival", "0 seconds")
    rows = timed.select(*KEYS, "u", "v", "w", "tke", "arrival", F.unix_millis("arrival").alias("arrived"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(PlaneSums(size, wait_ms), _PARTS, "Append", "EventTime")


def run_parts(parts: DataFrame, folder: str) :
    """Drain the available input; every batch's parts become ``table/batch=<id>``. Returns the progress of the batches."""
    conf, name = parts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    conf.set(name, PROVIDER)
    try:
        q = parts.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
        q.awaitTermination()
        return q.recentProgress
    finally:
        conf.set(name, before)


# ---------------------------------------------------------------- compaction
def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, column: str) -> list[int]:
    """Numbers of the folders ``<column>=<number>`` below ``path`` that were written to the end."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where)]
    done = [p.getName() for p in names if fs.exists(_files(spark, f"{p}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{column}="))


def written(spark: SparkSession, folder: str) -> DataFrame | None:
    """All closed parts: the newest merged folder and the batches after it; None before the first batch."""
    merged, batches = _numbers(spark, f"{folder}/merged", "upto"), _numbers(spark, f"{folder}/table", "batch")
    last = merged[-1] if merged else -1
    paths = [f"{folder}/merged/upto={last}"] * bool(merged) + [f"{folder}/table/batch={b}" for b in batches if b > last]
    return spark.read.schema(_PARTS).parquet(*paths) if paths else None


def compact(spark: SparkSession, folder: str) -> int:
    """Merge all finished batches to one folder, a row for each plane; returns how many folders are left.

    The merged folder counts from the moment it is complete, and what it replaces is deleted after that: broken off at
    any point, :func:`written` gives the same sums.
    """
    batches, merged = _numbers(spark, f"{folder}/table", "batch"), _numbers(spark, f"{folder}/merged", "upto")
    last = merged[-1] if merged else -1
    if batches and batches[-1] > last:
        added(written(spark, folder)).write.mode("overwrite").parquet(f"{folder}/merged/upto={batches[-1]}")
        last = batches[-1]
    for path in [f"{folder}/table/batch={b}" for b in batches if b <= last] + [f"{folder}/merged/upto={m}" for m in merged if m < last]:
        where, fs = _files(spark, path)
        fs.delete(where, True)
    return len(_numbers(spark, f"{folder}/table", "batch")) + len(_numbers(spark, f"{folder}/merged", "upto"))


# ------------------------------------------------------------------- results
def added(parts: DataFrame) -> DataFrame:
    """One row for each plane: its parts added up."""
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def still_open(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of planes that are open in the state, read from the checkpoint as a table."""
    state = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "sums").load()
    return state.select(*[F.col(f"key.{c}").alias(c) for c in KEYS], *[F.col(f"value.{c}").alias(c) for c in SUMS])


def planes_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Every plane that has come in so far, closed or open, as one row of sums."""
    conf, name = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        held, parts = still_open(spark, folder), written(spark, folder)
        held = materialize(held, "open-planes")  # while the provider is set
    finally:
        conf.set(name, before)
    return added(held if parts is None else parts.unionByName(held))


def _variance() -> Column:
    return F.greatest(F.try_divide("ww", "ok") - F.pow(F.try_divide("w", "ok"), F.lit(2.0)), F.lit(0.0))


def gates(planes: DataFrame, near: Sequence[int] = (0, 1)) -> DataFrame:
    """Near-surface variances of every dump, as the gate needs them."""
    at = [F.max(F.when(F.col("k") == k, _variance())).alias(f"ww{n}") for n, k in enumerate(near)]
    return planes.groupBy("run_id", "step").agg(*at, F.sum(F.col("n") - F.col("ok")).alias("n_bad"), F.sum("n").alias("n_cells"))


def profiles(planes: DataFrame) -> DataFrame:
    """Level means and variance of every dump."""
    per = lambda c: F.col(c) / F.col("n")
    return planes.select(*KEYS, per("u").alias("U"), per("v").alias("V"), F.when(F.col("ok") == F.col("n"), _variance()).otherwise(float("nan")).alias("ww"), per("tke").alias("E"))
