"""The closed-form footprint evaluated over many runs and cells at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kljun
from ..functions.geometry import Domain
from ..functions.numeric import erf


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal a few parameter rows over every core before they fan out.

    The rows are tiny but each stands for much work, so the partition count
    comes from the cluster and not from the data size.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1), *cols)


def with_scale(params: DataFrame) -> DataFrame:
    """Add Pi_4 and the distance scale to (zm, h, ustar, u_mean, L[, z0])."""
    z0 = F.col("z0") if "z0" in params.columns else None
    p4 = kljun.pi4(F.col("zm"), F.col("ustar"), F.col("u_mean"), z0, F.col("L"))
    return params.withColumn("p4", p4).withColumn("scale", kljun.x_scale(F.col("zm"), F.col("h"), F.col("p4")))


def _sigma(x: Column) -> Column:
    return kljun.sigma_y(x, *[F.col(c) for c in ("scale", "zm", "ustar", "sigma_v", "L")])


def along_wind(params: DataFrame, step: float, count: int) -> DataFrame:
    """f_y and sigma_y at ``count`` upwind distances per run."""
    p = with_scale(params).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("x", F.col("n") * step)
    return p.select(
        "run_id", "n", "x", kljun.crosswind_integrated(F.col("x"), F.col("scale")).alias("fy"), _sigma(F.col("x")).alias("sigma_y")
    )


def peaks(params: DataFrame) -> DataFrame:
    p = with_scale(params)
    return p.select(
        "run_id", "p4", kljun.peak_distance(F.col("scale")).alias("x_max"), kljun.implied_roughness(F.col("zm"), F.col("p4")).alias("z0_implied")
    )


def cell_integrated(params: DataFrame, step: float, nx: int, ny: int) -> DataFrame:
    """2-D field on a wind-aligned grid, crosswind Gaussian averaged per cell."""
    p = with_scale(params).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(nx))))
    p = p.withColumn("m", F.explode(F.sequence(F.lit(-ny), F.lit(ny - 1))))
    x, lo = F.col("n") * step, F.col("m") * step
    fy = kljun.crosswind_integrated(x, F.col("scale"))
    sy = _sigma(x)
    return p.select(
        "run_id",
        "n",
        "m",
        kljun.cell_integrated_2d(fy, sy, lo, lo + step).alias("f"),
        kljun.gaussian_2d(fy, sy, lo + step / 2.0).alias("f_centre"),
    )


def static_raster(params: DataFrame, dom: Domain, nsub: int = 8) -> DataFrame:
    """The model on the north-up raster, each cell the mean of nsub x nsub samples.

    ``params`` also needs ``yaw``. The sub-samples of a cell are generated and
    combined in one task; only one partial sum per cell reaches the shuffle.
    """
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = with_scale(params)
    p = spread(p.withColumn("j", seq(dom.ny)), "run_id", "j")
    for name, n in (("i", dom.nx), ("sj", nsub), ("si", nsub)):
        p = p.withColumn(name, seq(n))
    off = lambda c: (F.col(c) + 0.5) / nsub - 0.5
    east = dom.xc(F.col("i")) + off("si") * dom.dx
    north = dom.yc(F.col("j")) + off("sj") * dom.dx
    up, cross = geo.wind_frame(east, north, F.col("yaw"))
    p = p.withColumn("x", up).withColumn("y", cross)
    f = kljun.gaussian_2d(kljun.crosswind_integrated(F.col("x"), F.col("scale")), _sigma(F.col("x")), F.col("y"))
    return p.groupBy("run_id", F.col("j").cast("bigint").alias("j"), F.col("i").cast("bigint").alias("i")).agg(F.avg(f).alias("f"))


def predicted_share(params: DataFrame, fy: DataFrame, measured: DataFrame, rect: Sequence[float], reach: int = 6000) -> DataFrame:
    """Rectangle share predicted from geometry against the measured share.

    ``fy`` is the dense crosswind-integrated curve, ``measured`` (run_id, share).
    """
    west, east, south, north = rect
    p = with_scale(params).withColumn("chord", geo.chord(F.col("wdir"), west, east, south, north))
    x = F.col("x").cast("double")
    curve = p.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(reach - 1)))).withColumn("f", kljun.crosswind_integrated(x, F.col("scale")))
    cum = curve.groupBy("run_id").agg(
        F.try_divide(F.sum(F.when(F.col("x") <= F.ceil(F.greatest("chord", F.lit(1.0))), F.col("f")).otherwise(0.0)), F.sum("f")).alias("kl")
    )
    half = F.greatest(F.col("chord") / 2.0, F.lit(1.0))
    cf = erf(0.5 * (east - west) / F.greatest(_sigma(half) * 2.0**0.5, F.lit(1e-6)))
    les = fy.join(p.select("run_id", "chord"), "run_id")
    pos, c = F.greatest("f", F.lit(0.0)), F.col("chord")
    width = F.lit(24.0) if "res" not in fy.columns else F.col("res")
    # value of the cumulative curve at the chord = all bins at or below it plus a part of the next
    part = F.when(F.col("xc") <= c, pos).when(F.col("xc") - width < c, pos * (c - (F.col("xc") - width)) / width).otherwise(0.0)
    les_cum = les.groupBy("run_id").agg(F.try_divide(F.sum(part), F.sum(pos)).alias("les"))
    out = p.withColumn("crosswind", cf).join(cum, "run_id").join(les_cum, "run_id").join(measured, "run_id", "left")
    return out.select(
        "run_id",
        "wdir",
        "chord",
        (100.0 * F.col("kl")).alias("kljun_cum"),
        "crosswind",
        (100.0 * F.col("kl") * F.col("crosswind")).alias("pred_kljun"),
        (100.0 * F.col("share")).alias("measured"),
        (100.0 * F.col("les") * F.col("crosswind")).alias("pred_les"),
    )
