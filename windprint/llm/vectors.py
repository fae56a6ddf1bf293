"""What the two searches over vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows ``vid, dim, vec`` (doubles) of the vectors that take part.

    Left out are null ids, null or empty vectors and those with a null or non-finite component. Rows that share an
    id count once, with the smallest vector in array order.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vid"), vec.alias("vec"))
    rows = rows.filter(F.col("vid").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(good)
    return rows.groupBy("vid").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype, copy=False)


def best(query: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((vid, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]
