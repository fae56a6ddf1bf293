"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import best, matrix, usable

#: Standard deviations of the code's error that the bounds allow for.
EPSILON = 1.5
SEED = 11
#: So many times k candidates of the best estimates give the floor that a block's upper bounds must reach.
FIRST = 4
#: Candidates and queries that meet in one task, at most; candidates of a block where there are few; and tasks to aim at.
BLOCK, QUERY_BLOCK, SMALL_BLOCK, TASKS = 65_536, 65_536, 12_288, 24


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vec: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, their lengths, and the inner product of each unit vector with its code."""
    dim = vec.shape[1]
    turned = vec @ rotation(dim, seed).T
    length = np.sqrt((vec * vec).sum(1))
    fit = np.abs(turned).sum(1) / (np.sqrt(dim) * np.where(length > 0, length, 1))
    return np.packbits(turned > 0, axis=1), length, fit


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed bits as rows of 1 and -1."""
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimate(codes: np.ndarray, length: np.ndarray, fit: np.ndarray, query: np.ndarray, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of each query (row) with each coded vector (column), and the half width of their bounds.

    With unit vector o, code b (signs over the root of the dimension) and rotated query q: <q, o> is estimated by
    <q, b> / <b, o>; its error is below epsilon |q| sqrt((1 - f^2) / f^2 / (dim - 1)) but for rare cases, f = <b, o>.
    """
    dim = query.shape[1]
    product = (query @ rotation(dim, seed).T).astype(np.float32) @ signs(codes, dim).T
    product *= (length / (np.sqrt(dim) * fit)).astype(np.float32)
    # the last term covers single-precision rounding
    spread = epsilon * length * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(dim - 1, 1)) + 1e-5 * length
    return product, np.sqrt((query * query).sum(1))[:, None].astype(np.float32) * spread.astype(np.float32)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """The index: ``vid, dim, vec, code, length, fit`` of every vector that takes part (see ``search``)."""

    def coded(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                codes, length, fit = encode(matrix(part.column("vec"), int(dim)), seed)
                part = part.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))
                yield from part.append_column("length", pa.array(length)).append_column("fit", pa.array(fit)).to_batches()

    rows = usable(vectors, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0)).select("vid", "dim", "vec")
    return rows.mapInArrow(coded, "vid long, dim int, vec array<double>, code binary, length double, fit double")


def search(index: DataFrame, queries: DataFrame, k: int = 20, seed: int = SEED, epsilon: float = EPSILON) -> DataFrame:
    """The ``k`` nearest by inner product of each query (``vid, dim, vec``): ``query_id, rank, vec_id, score``.

    Candidates are dealt to blocks by a hash of their id, queries likewise; every block of queries meets every block
    of candidates of the same dimension in a task of bounded size. There the codes give estimates of all inner products
    and upper bounds; the exact products of the best estimates give a floor that k candidates reach, and whatever has
    an upper bound at the floor or above goes to the exact product.
    Scores are double-precision products of the original vectors; ties go to the smaller id. A query's own id is
    never returned. Fewer candidates than ``k`` give as many rows.

    Null, empty or zero vectors, and those with null or non-finite components, take no part, nor do null ids.
    Rows sharing an id count once. Only vectors of equal dimension are compared.
    """
    n, n_queries = index.count(), queries.count()
    blocks = max(-(-n // BLOCK), min(4, -(-n // SMALL_BLOCK)), 1)
    query_blocks = max(-(-n_queries // QUERY_BLOCK), min(-(-TASKS // blocks), -(-n_queries // 64)), 1)

    def each(count: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    left = index.select("dim", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block"), each(query_blocks, "part"), "vid", "vec", "code", "length", "fit")
    # new names throughout, as both sides may come from one table
    right = queries.select(
        F.col("dim").alias("asked_dim"), each(blocks, "asked_block"), F.pmod(F.xxhash64("vid"), F.lit(query_blocks)).cast("int").alias("asked_part"),
        F.col("vid").alias("asked_id"), F.col("vec").alias("asked"),
    )

    def meet(key, cands: pa.Table, asked: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        if cands.num_rows and asked.num_rows:
            cands = cands.sort_by("vid")
            vid, vec = cands.column("vid").to_numpy(), matrix(cands.column("vec"), dim)
            codes = np.frombuffer(b"".join(cands.column("code").to_pylist()), np.uint8).reshape(len(vid), -1)
            length, fit = cands.column("length").to_numpy(), cands.column("fit").to_numpy()
            qid, qvec = asked.column("asked_id").to_numpy(), matrix(asked.column("asked"), dim)
            step = max(1, 4_000_000 // len(vid))
            for s in range(0, len(qid), step):
                found.append(_block(qid[s : s + step], qvec[s : s + step], vid, vec, codes, length, fit, k, seed, epsilon))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    near = left.groupBy("dim", "block", "part").cogroup(right.groupBy("asked_dim", "asked_block", "asked_part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _products(qvec: np.ndarray, vec: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    score = np.empty(len(q))
    for s in range(0, len(q), 50_000):
        score[s : s + 50_000] = (qvec[q[s : s + 50_000]] * vec[c[s : s + 50_000]]).sum(1)
    return score


def _block(qid, qvec, vid, vec, codes, length, fit, k, seed, epsilon):
    mid, half = estimate(codes, length, fit, qvec, seed, epsilon)
    at = np.minimum(np.searchsorted(vid, qid), len(vid) - 1)
    own = np.nonzero(vid[at] == qid)[0]
    mid[own, at[own]] = -np.inf
    first = min(FIRST * k, len(vid))
    lead = np.argpartition(-mid, first - 1, axis=1)[:, :first]
    known = _products(qvec, vec, np.repeat(np.arange(len(qid)), first), lead.ravel()).reshape(len(qid), first)
    known[np.take_along_axis(mid, lead, 1) == -np.inf] = -np.inf
    floor = np.sort(known, axis=1)[:, -k] if first >= k else np.full(len(qid), -np.inf)
    mid += half
    q, c = np.nonzero((mid >= floor[:, None].astype(np.float32)) & (mid > -np.inf))
    score = _products(qvec, vec, q, c)
    keep = best(q, vid[c], score, k)
    # the lead itself, where a bound failed
    lead_q, lead_c, lead_s = np.repeat(np.arange(len(qid)), first), lead.ravel(), known.ravel()
    some = lead_s > -np.inf
    q, c, score = np.r_[q[keep], lead_q[some]], np.r_[c[keep], lead_c[some]], np.r_[score[keep], lead_s[some]]
    _, once = np.unique(q * len(vid) + c, return_index=True)
    q, c, score = q[once], c[once], score[once]
    keep = best(q, vid[c], score, k)
    return qid[q[keep]], vid[c[keep]], score[keep]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``search`` of the whole table for the rows whose id is divisible by ``every``."""
    index = materialize(build_index(vectors, id_col, vec_col), "bit-index")
    return search(index, index.filter(F.col("vid") % every == 0).select("vid", "dim", "vec"), k)
