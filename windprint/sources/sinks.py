"""Sinks that can be broken off and taken up again: results by run, a log of finished runs, and versions of a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dumps import pending


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _replace(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``df`` in place of the partitions it has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def finished(spark: SparkSession, path: str, key: str = "run_id") -> DataFrame:
    """(key, as string): runs whose results are complete."""
    if not _exists(spark, f"{path}/done"):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.option("basePath", f"{path}/done").schema(f"at timestamp, {key} string").parquet(f"{path}/done").select(key).distinct()


def append_runs(results: DataFrame, path: str, key: str = "run_id", mark: bool = True) -> DataFrame:
    """Write the results of runs that aren't finished yet; returns the runs (``key``) that were written.

    A run's rows replace whatever an attempt that was broken off has left of it, in one partition of its own; only
    then is the run marked as finished. So any number of attempts, broken off anywhere, leaves each run once. ``mark``
    False stops before the mark, as a broken attempt would.
    """
    spark = results.sparkSession
    done = finished(spark, path, key).withColumnRenamed(key, "tag")
    todo = pending(results.select(F.col(key).cast("string").alias("tag")).distinct(), done)
    rows = results.withColumn(key, F.col(key).cast("string")).join(todo.withColumnRenamed("tag", key), key, "left_semi")
    _replace(rows, f"{path}/rows", [key])
    # the marks follow from the table that is asked for, not from what was written, so a run without rows counts as well
    names = todo.withColumnRenamed("tag", key).withColumn("at", F.current_timestamp())
    if mark:
        _replace(names.select("at", key), f"{path}/done", [key])
    return finished(spark, path, key) if mark else names.select(key)


def read_runs(spark: SparkSession, path: str, key: str = "run_id") -> DataFrame:
    """The rows of finished runs; a column that older runs lack is NULL there."""
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn(key, F.col(key).cast("string"))
    return rows.join(finished(spark, path, key), key, "left_semi")


# ----------------------------------------------------------------- baselines
def propose(metrics: DataFrame, path: str, version: int) -> None:
    """Store metrics (run_id, metric, value, floor columns) as a version of the baseline; it doesn't count until accepted."""
    _replace(metrics.withColumn("version", F.lit(version)), f"{path}/versions", ["version"])


def accept(spark: SparkSession, path: str, version: int) -> None:
    """From now on the version counts, unless a higher one is accepted as well."""
    _replace(spark.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version")), f"{path}/accepted", ["version"])


def baseline(spark: SparkSession, path: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """For each key the rows of the highest accepted version that has it; a key that only older versions have keeps theirs."""
    versions = spark.read.option("basePath", f"{path}/versions").parquet(f"{path}/versions")
    good = spark.read.option("basePath", f"{path}/accepted").parquet(f"{path}/accepted").select("version").distinct()
    counted = versions.join(good, "version", "left_semi")
    newest = counted.groupBy(*keys).agg(F.max("version").alias("version"))
    return counted.join(newest, [*keys, "version"], "left_semi")
