"""Sub-window ensembles: independence, random draws, convergence."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def lag_autocorr(metrics: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], lags: int = 4) -> DataFrame:
    """Autocorrelation of per-window metrics; NULLs drop out of both sums.

    ``order`` numbers the sub-windows: a missing one is a gap, not a neighbour,
    and counts in ``windows``. A key has one row per sub-window, so its window
    is small by construction.
    """
    w, wk = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    d = metrics
    for v in values:
        d = d.withColumn(f"d_{v}", F.col(v) - F.avg(v).over(wk))
    for v in values:
        for n in range(1, lags + 1):
            d = d.withColumn(f"_{v}_{n}", F.col(f"d_{v}") * F.max(f"d_{v}").over(w.rangeBetween(-n, -n)))
    aggs = [
        F.try_divide(F.coalesce(F.sum(f"_{v}_{n}"), F.lit(0.0)), F.sum(F.col(f"d_{v}") * F.col(f"d_{v}"))).alias(f"{v}_lag{n}")
        for v in values
        for n in range(1, lags + 1)
    ]
    slots = F.max(order) - F.min(order) + 1
    return d.groupBy(*keys).agg(slots.cast("bigint").alias("windows"), (2.0 / F.sqrt(slots)).alias("bound"), *aggs)


def draw_members(spark: SparkSession, draws: int, nsub: int, seed: int = 0) -> DataFrame:
    """(draw, sub, rank): a reproducible permutation of sub-windows per draw.

    The order is that of md5(seed-draw-sub), the same in every engine and on
    every retry. Size is draws * nsub, set by the caller.
    """
    m = spark.range(draws).withColumnRenamed("id", "draw").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nsub - 1).cast("bigint"))))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("sub").cast("string")))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(key)))


def draw_orders(draws: int, nsub: int, seed: int = 0) -> list[list[int]]:
    """The sub-windows of each draw in the order of their rank, as in :func:`draw_members`."""
    key = lambda draw, sub: hashlib.md5(f"{seed}-{draw}-{sub}".encode()).hexdigest()
    return [sorted(range(nsub), key=lambda sub: key(draw, sub)) for draw in range(draws)]


def pack_maps(maps: DataFrame, keys: Sequence[str], nsub: int, nx: int, ny: int) -> DataFrame:
    """One row per key: ``maps``, the dense map of each sub-window in order, ny values for each of its nx columns.

    A sub-window without a cell is zero there. The size of a row follows from grid and window alone.
    """
    at = (F.col("i") * ny + F.col("j")).cast("int")
    cells = maps.groupBy(*keys, F.col("sub").cast("int").alias("sub")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "f"))).alias("cells"))
    # zeros between the places of neighbouring cells, and after the last
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = F.concat(F.array(F.lit(-1)), F.col("cells.at"))
    parts = F.zip_with("cells", F.slice(before, 1, F.size("cells")), lambda c, was: F.concat(zeros(c["at"] - was - 1), F.array(c["f"])))
    dense = F.concat(F.flatten(parts), zeros(F.lit(nx * ny - 1) - F.element_at("cells.at", -1)))
    subs = cells.select(*keys, "sub", dense.alias("f")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sub", "f"))).alias("subs"))
    places = F.sequence(F.lit(0), F.lit(nsub - 1))
    return subs.select(*keys, F.transform(places, lambda n: F.coalesce(F.try_element_at("subs", n), zeros(F.lit(nx * ny)))).alias("maps"))


def draw_maps(packed: DataFrame, orders: Sequence[Sequence[int]], keys: Sequence[str], nsub: int, reference: str = "held-out") -> DataFrame:
    """(keys, draw, n, f, ref): mean map of the first n members of every draw, and its reference map, as dense arrays.

    ``reference`` is "held-out" (the other half of the same draw) or "fixed" (always the second half of the window;
    draws then use the first half only). The orders are literals; the sums run over ranks inside a row, each from the
    one before, so no cell is joined, exploded or shuffled.
    """
    half = nsub // 2
    fixed = reference == "fixed"
    chosen = [[n for n in o if n < half] if fixed else list(o[:half]) for o in orders]
    rests = [list(range(half, nsub)) if fixed else list(o[half:]) for o in orders]
    lists = F.array(*[F.struct(F.lit(d).cast("bigint").alias("draw"), F.array(*map(F.lit, c)).alias("subs"), F.array(*map(F.lit, r)).alias("rest")) for d, (c, r) in enumerate(zip(chosen, rests))])
    zero = F.transform(F.get("maps", F.lit(0)), lambda x: F.lit(0.0))
    plus = lambda s, n: F.zip_with(s, F.get("maps", n), lambda a, b: a + b)
    # every draw in a partition of its own choice: a run's draws don't wait for one task
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = packed.select(*keys, "maps", F.explode(lists).alias("o")).repartition(n, *keys, "o.draw")
    sums = F.aggregate("o.subs", F.array(zero), lambda done, n: F.concat(done, F.array(plus(F.element_at(done, -1), n))))
    rest = F.transform(F.aggregate("o.rest", zero, plus), lambda x: x / (nsub - half))
    each = drawn.select(*keys, "o.draw", rest.alias("ref"), F.posexplode(F.slice(sums, 2, half)).alias("p", "s"))
    n = F.col("p") + 1
    return each.select(*keys, "draw", n.alias("n"), F.transform("s", lambda x: x / n).alias("f"), "ref")


def _peak_centroid(f: Column, nx: int, ny: int, x_edge: float, res: float) -> tuple[Column, Column, Column]:
    """Crosswind sums of a dense map; x of the largest one and their mean x, given those sums in a column of their own."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: F.aggregate(F.slice(f, i * ny + 1, ny), F.lit(0.0), lambda s, x: s + x))
    fy = F.col("fy")
    total = F.aggregate(fy, F.lit(0.0), lambda s, x: s + x)
    moment = F.aggregate(F.transform(fy, lambda x, i: x * (x_edge + (i + 0.5) * res)), F.lit(0.0), lambda s, x: s + x)
    peak = F.when(total > 0, x_edge + (F.array_position(fy, F.array_max(fy)) - 0.5) * res)
    return sums, peak, F.when(total > 0, moment / total)


def _threshold(f: Column, frac: float) -> tuple[Column, Column]:
    """The sum of a map's values, and given it as ``total`` the value at which the running sum of a map's values, in descending order, reaches that share of it; NULL where it isn't positive."""
    total = F.aggregate(f, F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda t, x: F.struct((t["sum"] + x).alias("sum"), F.when(t["at"].isNull() & (t["sum"] + x >= frac * F.col("total")), x).otherwise(t["at"]).alias("at"))
    return total, F.when(F.col("total") > 0, F.aggregate(F.sort_array(f, asc=False), start, step, lambda t: t["at"]))


def draw_scores(drawn: DataFrame, keys: Sequence[str], nx: int, ny: int, x_edge: float, res: float, frac: float = 0.8) -> DataFrame:
    """|d peak|, |d centroid| and overlap of the source areas of every (draw, n) with its reference; one row in, one out."""
    on = [*keys, "draw", "n"]

    def described(name: str, tag: str, df: DataFrame) -> DataFrame:
        sums, peak, centroid = _peak_centroid(F.col(name), nx, ny, x_edge, res)
        df = df.withColumn("fy", sums).withColumns({f"peak_{tag}": peak, f"centroid_{tag}": centroid}).drop("fy")
        df = df.withColumn(name, F.transform(name, lambda x: F.greatest(x, F.lit(0.0))))
        total, threshold = _threshold(F.col(name), frac)
        return df.withColumn("total", total).withColumn(f"thr_{tag}", threshold).drop("total")

    both = described("ref", "r", described("f", "f", drawn))
    a = lambda c: F.coalesce(c["f"] >= F.col("thr_f"), F.lit(False))
    b = lambda c: F.coalesce(c["ref"] >= F.col("thr_r"), F.lit(False))
    inside = F.arrays_zip("f", "ref")
    shared = F.size(F.filter(inside, lambda c: a(c) & b(c)))
    either = F.size(F.filter(inside, lambda c: a(c) | b(c)))
    return both.select(
        *on,
        F.abs(F.col("peak_f") - F.col("peak_r")).alias("d_peak"),
        F.abs(F.col("centroid_f") - F.col("centroid_r")).alias("d_centroid"),
        F.coalesce(F.try_divide(shared, either), F.lit(0.0)).alias("overlap"),
    )


def convergence(scores: DataFrame, keys: Sequence[str], peak_tol: float, centroid_tol: float = 100.0) -> DataFrame:
    """Median and p90 of the differences per n, and the first n inside tolerance.

    Draws without a defined metric are left out of the percentiles and counted.
    """
    # a group has one row per draw, so an exact percentile is bounded
    out = scores.groupBy(*keys, "n").agg(
        F.avg("overlap").alias("overlap"), F.count_if(F.col("d_peak").isNull()).alias("undefined"), F.count(F.lit(1)).alias("draws"),
        *[F.percentile(m, p).alias(f"{m}_{t}") for m in ("d_peak", "d_centroid") for p, t in ((0.5, "p50"), (0.9, "p90"))],
    )
    wk = Window.partitionBy(*keys)
    return out.withColumns(
        {
            "n_peak": F.min(F.when(F.col("d_peak_p90") <= peak_tol, F.col("n"))).over(wk),
            "n_centroid": F.min(F.when(F.col("d_centroid_p90") <= centroid_tol, F.col("n"))).over(wk),
        }
    )
