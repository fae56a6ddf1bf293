"""Recorded particle tracks: touchdowns, retirement, mixing and transit checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles, lag_in_blocks


def with_age(tracks: DataFrame, keys: Sequence[str] = ("particle",)) -> DataFrame:
    """Add the start position and the age since each particle's first sample."""
    first = F.min_by(F.struct("t", "x", "y"), F.struct("t", "seq")).alias("s")
    start = tracks.groupBy(*keys).agg(first)
    j = tracks.join(start, list(keys))
    return j.select(
        *tracks.columns,
        (F.col("t") - F.col("s.t")).alias("age"),
        F.hypot(F.col("x") - F.col("s.x"), F.col("y") - F.col("s.y")).alias("disp"),
    )


def track_touchdowns(tracks: DataFrame, z_touch: float = 2.0, zg: Column | None = None) -> DataFrame:
    """Samples where the height above ground falls through ``z_touch``.

    The previous sample is found block by block, so a very long track does not
    land in one task.
    """
    ground = F.lit(0.0) if zg is None else zg
    agl = with_age(tracks).withColumn("agl", F.col("z") - ground)
    p = lag_in_blocks(agl, ["particle"], "day", ["t", "seq"], ["t", "agl"])
    hit = (F.col("agl") < z_touch) & (F.col("prev_agl") >= z_touch)
    rate = F.abs(F.try_divide(F.col("agl") - F.col("prev_agl"), F.col("t") - F.col("prev_t")))
    return p.where(hit).select(
        "particle", "seq", F.col("x").alias("td_x"), F.col("y").alias("td_y"), rate.alias("td_w"), F.col("age").alias("td_age"), "disp"
    )


def retire(tracks: DataFrame, max_disp: float, t_limit: float) -> DataFrame:
    """Keep samples up to the one at which a particle leaves or times out."""
    a = with_age(tracks)
    done = (F.col("disp") > max_disp) | (F.col("age") >= t_limit)
    stop = a.groupBy("particle").agg(F.min(F.when(done, F.struct("age", "seq"))).alias("stop"))
    j = a.join(stop, "particle")
    return j.where(F.col("stop").isNull() | (F.struct("age", "seq") <= F.col("stop"))).drop("stop")


def end_states(tracks: DataFrame) -> DataFrame:
    """First and last height and elapsed time per particle."""
    o = F.struct("t", "seq")
    g = tracks.groupBy("particle").agg(F.min_by(F.struct("z", "t"), o).alias("a"), F.max_by(F.struct("z", "t"), o).alias("b"))
    return g.select("particle", F.col("a.z").alias("z_init"), F.col("b.z").alias("z"), (F.col("b.t") - F.col("a.t")).alias("elapsed"))


def height_bins(particles: DataFrame, keys: Sequence[str], lo: float, hi: float, n: int) -> DataFrame:
    """Initial and final counts per height bin; the last bin is closed."""
    width = (hi - lo) / n

    def bin_of(c: Column) -> Column:
        return F.when(c == hi, F.lit(n - 1).cast("bigint")).otherwise(F.floor((c - lo) / width))

    ends = F.array(
        F.struct(F.lit(0).alias("last"), F.col("z_init").alias("z")), F.struct(F.lit(1).alias("last"), F.col("z").alias("z"))
    )
    e = particles.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.last", bin_of(F.col("e.z")).alias("bin"))
    counts = e.where(F.col("bin").between(0, n - 1)).groupBy(*keys, "bin").agg(
        F.count_if(F.col("last") == 0).alias("h0"), F.count_if(F.col("last") == 1).alias("h1")
    )
    spine = particles.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return spine.join(counts, [*keys, "bin"], "left").na.fill(0, ["h0", "h1"])


def wellmixed_gate(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Noise-aware verdict: profile deviation and the lowest three bins."""
    r = F.col("h1") / F.greatest("h0", F.lit(1))
    g = bins.groupBy(*keys).agg(
        F.max(F.abs(r - 1)).alias("max_dev"),
        F.sqrt(F.avg(F.pow(r - 1, F.lit(2.0)))).alias("rms_dev"),
        F.avg("h0").alias("mean_h0"),
        F.sum(F.when(F.col("bin") < 3, F.col("h1"))).alias("l1"),
        F.sum(F.when(F.col("bin") < 3, F.col("h0"))).alias("l0"),
    )
    noise = F.sqrt(F.try_divide(F.lit(2.0), F.col("mean_h0")))
    g = g.withColumn("noise", noise).withColumn("lowest3", F.col("l1") / F.greatest("l0", F.lit(1)))
    ok = (F.col("max_dev") < F.greatest(F.lit(0.10), 4 * F.col("noise"))) & (
        F.abs(F.col("lowest3") - 1) < F.greatest(F.lit(0.05), 3 * F.col("noise"))
    )
    return g.select(*keys, "max_dev", "rms_dev", "noise", "lowest3", F.when(ok, "PASS").otherwise("FAIL").alias("gate"))


def transit_quantiles(touch: DataFrame, n_particles: DataFrame, keys: Sequence[str], probs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of first-touchdown age and the share that ever touches down."""
    first = touch.groupBy(*keys, "particle").agg(F.min("td_age").alias("age"))
    q = exact_quantiles(first, keys, "age", probs)
    wide = q.groupBy(*keys).agg(F.max("n").alias("reached"), *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(100 * p):d}") for p in probs])
    return n_particles.join(wide, list(keys), "left").select(
        *keys, "n_particles", (F.coalesce("reached", F.lit(0)) / F.col("n_particles")).alias("fraction"), *[f"p{round(100 * p):d}" for p in probs]
    )


def seed_bias(estimates: DataFrame, keys: Sequence[str], target: Column) -> DataFrame:
    """Mean, sample spread and distance from a known answer over seeds."""
    g = estimates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("est").alias("mean"), F.stddev_samp("est").alias("sd"))
    g = g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("target", target)
    return g.withColumn("sigmas", F.try_divide(F.col("mean") - F.col("target"), F.col("se")))


def slab_target(lid: Column, zr: float = 30.0, z_touch: float = 2.0) -> Column:
    """Exact answer in a slab closed by a lid."""
    return 1.0 - (zr - z_touch) / (lid - z_touch)


