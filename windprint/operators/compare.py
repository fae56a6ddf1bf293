"""Comparisons across runs, directions and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def swing(shares: DataFrame, keys: Sequence[str], area: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Largest over smallest share across cases, and enrichment over area share.

    ``shares`` has (keys, case, share); ``area`` has (keys, area_share).
    """
    g = shares.groupBy(*keys).agg(
        F.min(F.struct((-F.col("share")).alias("s"), "case")).alias("hi"), F.min(F.struct("share", "case")).alias("lo")
    )
    hi, lo = -F.col("hi.s"), F.col("lo.share")
    return g.join(area, list(keys)).select(
        *keys,
        hi.alias("max_share"),
        F.col("hi.case").alias("max_case"),
        lo.alias("min_share"),
        F.col("lo.case").alias("min_case"),
        (hi / F.greatest(lo, F.lit(floor))).alias("swing"),
        F.try_divide(hi, F.col("area_share")).alias("enrich_best"),
        F.try_divide(lo, F.col("area_share")).alias("enrich_worst"),
    )


def pair_ratio(table: DataFrame, keys: Sequence[str], case: str, pairs: Sequence[tuple[str, str]], values: Sequence[str]) -> DataFrame:
    """Ratios between named cases; one grouped pass picks both sides.

    One row per (keys, case) is expected.
    """
    members = sorted({c for p in pairs for c in p})
    pick = lambda c, v: F.max(F.when(F.col(case) == c, F.col(v)))
    per = table.groupBy(*keys).agg(*[pick(c, v).alias(f"_{n}_{v}") for n, c in enumerate(members) for v in values])
    at = {c: n for n, c in enumerate(members)}
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{a}/{b}").alias("pair"),
                *[(F.col(f"_{at[a]}_{v}") / F.greatest(F.col(f"_{at[b]}_{v}"), F.lit(1e-9))).alias(f"ratio_{v}") for v in values],
            )
            for a, b in pairs
        ]
    )
    return per.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def verdict(baseline: DataFrame, current: DataFrame, tol: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Metric-by-metric comparison with a tolerance table; overall via bool_and."""
    on = [*keys, "metric"]
    j = (
        baseline.withColumnRenamed("value", "was")
        .join(current.withColumnRenamed("value", "now"), on, "full_outer")
        .join(tol, on, "left")
    )
    ok = F.coalesce(F.abs(F.col("now") - F.col("was")) <= F.col("tol"), F.lit(False))
    return j.select(*on, "was", "now", (F.col("now") - F.col("was")).alias("diff"), "tol", F.when(ok, "ok").otherwise("CHANGED").alias("status"))


def overall(table: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    good = F.col("status") == "ok"
    return table.groupBy(*keys).agg(F.count_if(~good).alias("n_changed"), F.when(F.bool_and(good), "PASS").otherwise("CHANGED").alias("result"))


def tolerances(base: DataFrame, floor: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Tolerance per metric from the run's own half-vs-half difference.

    ``base`` (keys, metric, value) is the baseline; ``floor`` (keys, dpeak).
    """
    m, v = F.col("metric"), F.col("value")
    t = (
        F.when(m == "peak_x", F.greatest(2.5 * F.abs(F.coalesce("dpeak", F.lit(0.0))), F.lit(48.0)))
        .when(m == "area80_ha", F.greatest(0.35 * v, F.lit(5.0)))
        .when(m == "integral", F.lit(0.08))
        .when(m == "overlap", F.lit(0.15))
    )
    return base.join(floor, list(keys), "left").select(*keys, "metric", t.alias("tol"))


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.metric", "r.value")


def aligned_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell-aligned b - a after scaling each map to a unit total."""

    def unit(f: DataFrame, name: str) -> DataFrame:
        t = f.groupBy(*keys).agg(F.sum("f").alias("t"))
        return f.join(t, list(keys)).select(*keys, "j", "i", F.try_divide("f", "t").alias(name))

    j = unit(a, "fa").join(unit(b, "fb"), [*keys, "j", "i"], "full_outer").na.fill(0.0, ["fa", "fb"])
    return j.select(*keys, "j", "i", (F.col("fb") - F.col("fa")).alias("diff"))


def first_non_empty(*maps: Column) -> Column:
    """First map column that is neither NULL nor empty."""
    return F.coalesce(*[F.when(F.size(m) > 0, m) for m in maps])
