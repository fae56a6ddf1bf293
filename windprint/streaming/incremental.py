"""Incremental forms of the grouped sums, on Structured Streaming.

A micro-batch emits only the groups it changed (update mode). Each batch is
written once to its own folder of a shared table, keyed by batch id, so a
replayed batch overwrites itself; :func:`latest` reads the newest state of
every group. One stateful aggregate per query, metrics are finished in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Domain
from ..operators import footprint as fp
from ..operators.levels import gate_status
from ..sources.shared_table import shared_folder  # noqa: F401


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a folder of parquet files, or over a table kept as one file.

    The one-letter glob is for the single file: a plain path must be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_updates(stream: DataFrame, folder: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Drain the available input; every batch becomes ``table/batch=<id>``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = finish(batch) if finish else batch
        out.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    q = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    q.awaitTermination()
    return f"{folder}/table"


def latest(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """Newest emitted row of every group."""
    df = spark.read.option("basePath", table).parquet(table)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return g.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def release_time(w: DataFrame) -> DataFrame:
    """Event time = release time; a touchdown arrives up to t_back later."""
    return w.withColumn("release_ts", F.timestamp_seconds("t_release"))


def footprint_windows(touchdowns: DataFrame, framed: DataFrame, dom: Domain, length: str) -> DataFrame:
    """Map sums per averaging window of one micro-batch of touchdowns.

    Sums add up, so a batch needs no state of earlier ones: each writes its own
    part and :func:`summed` adds the parts. Model time starts anew in every
    run, so no clock is shared and no touchdown is ever late.
    """
    w = release_time(fp.weigh(touchdowns, framed, dom)).withColumn("win", F.window("release_ts", length))
    return fp.deposit_static(w, dom, ["run_id", "win"])


def summed(spark: SparkSession, table: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Parts written by :func:`run_updates`, added up per key."""
    parts = spark.read.option("basePath", table).parquet(table)
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def dump_gate(cells: DataFrame) -> DataFrame:
    """Running near-surface variance ratio per dump, as mergeable moments."""
    from ..functions.numeric import isfinite

    ok = isfinite(F.col("w"))
    at = lambda k: F.var_pop(F.when((F.col("k") == k) & ok, F.col("w")))
    return cells.groupBy("run_id", "step").agg(
        at(0).alias("ww0"), at(1).alias("ww1"), F.count_if(~ok).alias("n_bad"), F.count(F.lit(1)).alias("n_cells")
    )


def gate_alerts(batch: DataFrame) -> DataFrame:
    return gate_status(batch)


def plane_means(cells: DataFrame) -> DataFrame:
    """Running per-dump level means and variances (state per run, step, level)."""
    return cells.groupBy("run_id", "step", "k").agg(
        F.avg("u").alias("U"), F.avg("v").alias("V"), F.var_pop("w").alias("ww"), F.avg(F.greatest("tke", F.lit(0.0))).alias("E")
    )


def window_means(planes: DataFrame) -> DataFrame:
    """Second level: mean over dumps of the finished per-dump values."""
    return planes.groupBy("run_id", "k").agg(
        F.avg("U").alias("U"), F.avg("V").alias("V"), F.avg("ww").alias("ww"), F.avg("E").alias("E"), F.count(F.lit(1)).alias("n_dumps")
    )
