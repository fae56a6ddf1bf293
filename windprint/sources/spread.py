"""Deal rows out to more tasks than the session names where the input is large."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes, as stored, for each task.
TASK_BYTES = 8 << 20


@lru_cache(maxsize=64)
def _stored(files: tuple[str, ...]) -> int:
    """Bytes of the files; their content is not read."""
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f)) for f in files]
    lengths = SparkSession.active().read.format("binaryFile").load(paths)
    return lengths.agg(F.sum("length")).first()[0] or 0


def tasks(*inputs: DataFrame) -> int | None:
    """Tasks for rows derived from the inputs, by the size of their files; None where as many as run at once will do.

    Beyond that the number is named, the session's at least: tasks of which the session only knows the number are merged
    by the bytes that move, however many rows those hold, until each core has one.
    """
    files = tuple(sorted({f for df in inputs for f in df.inputFiles()}))
    n = -(-_stored(files) // TASK_BYTES) if files else 0
    spark = inputs[0].sparkSession
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else None


def deal(df: DataFrame, n: int | None, *by: str | Column) -> DataFrame:
    """Rows of equal ``by`` in one of ``n`` tasks, or of as many as the session says."""
    return df.repartition(n, *by) if n else df.repartition(*by)


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], n: int | None) -> DataFrame:
    """The inner join of two large tables in ``n`` tasks, or in as many as the session says."""
    if n:
        left, right = left.repartition(n, *on), right.repartition(n, *on)
    return left.join(right, list(on))
