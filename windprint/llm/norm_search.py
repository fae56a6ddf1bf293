"""Exact highest inner products by buckets of similar length, with pruning from local cosine thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import best, matrix, usable

#: Lengths within this factor share a class; a class is dealt to pieces of at most PIECE rows.
FACTOR, PIECE, MIN_PIECES, QUERY_BLOCK = 1.05, 65_536, 24, 8_192
#: From this cosine threshold on, single coordinates prune; below it lengths do. Coordinates looked at.
COORDINATE_FROM, FOCUS = 0.3, 4
LONG = np.iinfo(np.int64)


def scaled(vectors: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """``vid, dim, vec`` with whole-number components floor(factor * x); and ``length`` as a double."""
    rows = usable(vectors, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x * factor)))
    return rows.withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))


def products(vec: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact whole-number inner products; beyond 64 bits they end at the largest or smallest long."""
    if most < 2.0**52:
        return (vec.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return (vec * query).sum(1)
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in vec.astype(object) @ query.astype(object)], np.int64)


def candidates(unit: np.ndarray, length: np.ndarray, query: np.ndarray, norm: float, floor: float) -> np.ndarray:
    """Places that may score ``floor`` or more; ``length`` descends.

    With a threshold above 0, a vector needs a cosine of floor / (|query| * longest) at least. A high local threshold
    confines each coordinate of the unit vector to an interval around that of the query; a low one only bounds the length.
    """
    if not floor > 0 or not norm > 0:
        return np.arange(len(length))
    upto = int(np.searchsorted(-length, -(floor / norm) * (1 - 1e-9), side="right"))
    cosine = floor / (norm * length[0]) * (1 - 1e-9) if upto else 2.0
    if cosine > 1:
        return np.zeros(0, np.int64)
    if cosine < COORDINATE_FROM:
        return np.arange(upto)
    q = query / norm
    inside = np.ones(upto, bool)
    for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
        reach = np.sqrt((1 - cosine**2) * max(1 - q[f] ** 2, 0.0)) + 1e-9
        # a coordinate beyond the query's own only helps while the cosine can still be reached
        low = -1.0 if -q[f] >= cosine else q[f] * cosine - reach
        high = 1.0 if q[f] >= cosine else q[f] * cosine + reach
        inside &= (unit[:upto, f] >= low - 1e-9) & (unit[:upto, f] <= high + 1e-9)
    return np.nonzero(inside)[0]


def search(cands: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest whole-number products of each query: ``query_id, rank, vec_id, score``, ties to the smaller id.

    Both sides come from ``scaled``. Candidates are grouped by dimension and length class; a class of many rows is
    dealt to several pieces by a hash of the id, so that equal lengths or equal vectors fill no single task. The
    longest class of a dimension gives each query a first floor, its k-th best score there. A query then goes only to
    the pieces whose longest vector can reach that floor, and inside a piece only the candidates left by the local
    threshold are multiplied. All pruning is safe, so the result is exact. A query's own id is never returned.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; rows sharing an
    id count once; zero vectors score 0. Products beyond 64 bits end at the limits of a long.
    """
    cls = F.when(F.col("length") > 0, F.floor(F.log(FACTOR, F.col("length")))).otherwise(-1).cast("int")
    cands = cands.withColumn("class", F.greatest(cls, F.lit(-1)))
    # one row for each dimension and length class: bounded by the range of doubles, not by the input
    classes = cands.groupBy("dim", "class").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("dim", F.desc("class")).collect()
    if not classes:
        return queries.select(F.col("vid").alias("query_id"), F.lit(0).alias("rank"), F.col("vid").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    total = sum(c["n"] for c in classes)
    piece = min(PIECE, max(256, -(-total // MIN_PIECES)))
    split = [(c["dim"], c["class"], -(-c["n"] // piece), float(c["longest"])) for c in classes]
    top = {}
    for dim, c, parts, _ in split:
        top.setdefault(dim, (c, parts))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part_of = F.pmod(F.xxhash64("vid"), F.lit(query_blocks)).cast("int")
    plan = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(c).alias("class"), F.lit(p).alias("pieces"), F.lit(x).alias("longest")) for d, c, p, x in split])

    dealt = cands.withColumn("plan", F.element_at(F.filter(plan, lambda s: (s["dim"] == F.col("dim")) & (s["class"] == F.col("class"))), 1))
    dealt = dealt.select(
        "dim", "class", F.pmod(F.xxhash64("vid"), F.col("plan.pieces")).cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "vid", "vec", "length",
    )
    first = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(c).alias("class")) for d, (c, _) in top.items()])
    asked = queries.select("dim", part_of.alias("part"), "vid", "vec", "length")
    seeded = asked.withColumn("s", F.explode(F.filter(first, lambda s: s["dim"] == F.col("dim")))).select(
        "dim", F.col("s.class").alias("class"), F.lit(0).alias("piece"), "part", "vid", "vec", "length", F.lit(None).cast("double").alias("floor"))
    tops = dealt.filter(F.exists(first, lambda s: (s["dim"] == F.col("dim")) & (s["class"] == F.col("class"))) & (F.col("piece") == 0))
    seeds = _meet(tops, seeded, k)
    # the first piece of the longest class is enough for a floor; a query with fewer than k scores there has none
    floors = materialize(seeds.groupBy(F.col("query_id").alias("vid")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")), "norm-floors")
    reach = asked.join(floors, "vid", "left").withColumn(
        "s", F.explode(F.filter(plan, lambda s: (s["dim"] == F.col("dim")) & (F.coalesce(F.col("floor"), F.lit(0.0)) <= s["longest"] * F.col("length") * (1 + 1e-9))))
    )
    reach = reach.select("dim", F.col("s.class").alias("class"), F.explode(F.sequence(F.lit(0), F.col("s.pieces") - 1)).alias("piece"), "part", "vid", "vec", "length", "floor")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return _meet(dealt, reach, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(cands: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query in each piece."""

    def inside(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("length", "descending"), ("vid", "ascending")])
            vid, vec, length = left.column("vid").to_numpy(), matrix(left.column("vec"), dim, np.int64), left.column("length").to_numpy()
            unit = np.asfortranarray(vec / np.where(length > 0, length, 1)[:, None])
            qid, qvec, norms = right.column("asked_id").to_numpy(), matrix(right.column("asked"), dim, np.int64), right.column("norm").to_numpy()
            floors = right.column("floor").to_numpy(zero_copy_only=False)
            for i in range(len(qid)):
                at = candidates(unit, length, qvec[i], norms[i], floors[i])
                at = at[vid[at] != qid[i]]
                if not len(at):
                    continue
                score = products(vec[at], qvec[i], norms[i] * length[0])
                cut = max(len(at) - k, 0)
                at, score = (x[score >= np.partition(score, cut)[cut]] for x in (at, score))
                keep = np.lexsort((vid[at], -score))[:k]
                found.append((np.full(len(keep), qid[i]), vid[at[keep]], score[keep]))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    keys = ("dim", "class", "piece", "part")
    # new names throughout, as both sides may come from one table
    asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in keys], F.col("vid").alias("asked_id"), F.col("vec").alias("asked"), F.col("length").alias("norm"), "floor")
    return cands.groupBy(*keys).cogroup(asked.groupBy(*[f"asked_{c}" for c in keys])).applyInArrow(inside, "query_id long, vec_id long, score long")


def highest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``search`` of the whole table for the rows whose id is divisible by ``every``."""
    rows = materialize(scaled(vectors, id_col, vec_col, factor), "norm-vectors")
    return search(rows, rows.filter(F.col("vid") % every == 0), k)
