"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windprint.sources.shared_table import materialize

__all__ = ["fresh", "materialize", "reachable", "sliced", "table", "text_of", "unit_hash"]


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, where it isn't installed."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(text: str | Column) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``df`` bears."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (28 bits of MD5)."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 7), 16, 10).cast("double") / float(1 << 28)


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = [0 if v is None else v for v in pc.binary_length(column).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
