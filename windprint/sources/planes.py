"""Plane tables: dumps packed to one row per plane, stored so that a join with them moves points and not fields.

A table is bucketed and sorted by the plane's key, so the other side alone is shuffled to it, and partitioned by a few
steps of a run, so that only partitions which some point touches are opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.interp import pack_planes
from .shared_table import shared_folder

#: Consecutive steps of a run that share a partition.
STEPS = 8
#: Partitions of a table; where there would be more, those whose names hash alike share one.
PARTS = 64


def part(steps: int = STEPS) -> Column:
    """Name of the partition that a row's plane lies in."""
    return F.concat_ws("-", "run_id", F.floor(F.col("step") / steps).cast("string"))


def shared_part(steps: int = STEPS, parts: int = PARTS) -> Column:
    """Name of the partition of a row's plane in a table of more than ``parts`` names."""
    return F.concat(F.lit("shared-"), F.pmod(F.xxhash64(part(steps)), F.lit(parts)).cast("string"))


def save_planes(
    cells: DataFrame, name: str, keys: Sequence[str], nx: int, values: Sequence[str], steps: int = STEPS, buckets: int | None = None, parts: int = PARTS
) -> DataFrame:
    """Pack ``cells`` to planes of ``keys`` (run_id, step, perhaps k) and store them as the table ``name``.

    Its files lie in the cluster's shared folder. A task writes one bucket, so there are at most as many files as
    partitions times buckets; ``parts`` bounds the partitions, so files grow with the planes and not in number.
    """
    spark = cells.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = cells.select(part(steps).alias("part")).distinct().limit(parts + 1).count() > parts
    packed = pack_planes(cells, keys, nx, values).withColumn("part", shared_part(steps, parts) if many else part(steps)).repartition(n, *keys)
    packed.write.partitionBy("part").bucketBy(n, *keys).sortBy(*keys).option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def stored_planes(spark: SparkSession, source: str, cells: Callable[[], DataFrame], keys: Sequence[str], nx: int, values: Sequence[str], steps: int = STEPS) -> DataFrame:
    """The table of planes of a dump series, stored when it is first asked for in a session.

    ``source`` names the series, whose files are never rewritten.
    """
    tag = hashlib.md5("|".join([source, str(steps), *keys, *values]).encode()).hexdigest()[:16]
    name = f"planes_{tag}"
    return spark.table(name) if spark.catalog.tableExists(name) else save_planes(cells(), name, keys, nx, values, steps)


def touched(planes: DataFrame, wanted: DataFrame, steps: int = STEPS, parts: int = PARTS) -> DataFrame:
    """``planes`` without the partitions that no row of ``wanted`` (run_id, step) needs.

    The names of partitions become a filter on the partition column: the scan lists and opens only those. A table has
    names of its own for each few steps or shared ones, never both.
    """
    names = wanted.select(part(steps).alias("part"), shared_part(steps, parts).alias("shared")).distinct().collect()
    own = sorted({n for r in names for n in r if n is not None})
    return planes.where(F.col("part").isin(own)) if own else planes.where(F.lit(False))
