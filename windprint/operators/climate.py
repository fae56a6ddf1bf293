"""Hourly climatology: derived surface-layer columns, roses, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boundary_layer as bl
from ..functions import geometry as geo
from ..functions.numeric import isfinite
from ..sources.shared_table import materialize
from .ordered import finite_rows, quantiles_of

PROBS = (0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
#: Rows of a block of sites and axis points above which it is cut into pieces.
PIECE_ROWS = 50000


def block_sample(hourly: DataFrame, stride: int, block: int = 144) -> DataFrame:
    """Every stride-th block of contiguous hours; padding hours (< 0) drop out.

    A plain predicate on the hour, so a table laid out by hour can prune.
    """
    return hourly.where((F.col("time_hours") >= 0) & (F.pmod(F.floor(F.col("time_hours") / block), F.lit(stride)) == 0))


def hour_parts(hours: Column, offset: int = -6) -> dict[str, Column]:
    """Timestamp, month, UTC hour and local hour from hours since 1979-10-01."""
    day = F.date_add(F.lit("1979-10-01").cast("date"), F.floor(hours / 24).cast("int"))
    hour = geo.pmod_(hours, 24).cast("int")
    return {
        "valid": day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour),
        "month": F.month(day),
        "hour": hour,
        "local_hour": geo.pmod_(hour + offset, 24),
    }


def earth_wind(u: Column, v: Column, cos_a: Column, sin_a: Column) -> tuple[Column, Column]:
    return u * cos_a - v * sin_a, v * cos_a + u * sin_a


def nearest_cells(sites: DataFrame, axis: DataFrame, site: str, at: str, coord: str, index: str, block: float, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(site, index, offset): for each site the index of the axis point nearest to it, the first one where two are as near.

    Sites and axis points are sorted together in blocks of ``block`` along the coordinate, and a block of many rows in
    pieces of equal width, about ``piece_rows`` each where positions are spread; each site takes the last point before it
    and the first after it, from its own piece or, carried through the small table of pieces, from the nearest piece that
    has one. Both are running aggregates of a sorted piece, so nothing is paired beyond that.
    """
    points = axis.groupBy(F.col(coord).cast("double").alias("x")).agg(F.min(index).alias("n"))
    point = points.select("x", F.lit(None).cast(sites.schema[site].dataType).alias(site), F.struct("x", "n").alias("p"))
    asked = sites.select(F.col(at).cast("double").alias("x"), site, F.lit(None).cast(point.schema["p"].dataType).alias("p"))
    both = point.unionByName(asked).withColumn("b", F.floor(F.col("x") / block))
    cuts = both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / piece_rows).alias("cuts"))
    inside = F.least((F.col("x") / block - F.col("b")) * F.col("cuts"), (F.col("cuts") - 1).cast("double"))
    both = both.join(cuts, "b").select("x", site, "p", "b", F.floor(F.greatest(inside, F.lit(0.0))).alias("c"))
    held = F.when(F.col("p").isNotNull(), F.col("x"))
    ends = both.groupBy("b", "c").agg(F.max_by("p", held).alias("last"), F.min_by("p", held).alias("first"))
    # one row for each piece of the axis
    before = Window.orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.desc("b"), F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("b", "c", F.last("last", True).over(before).alias("carried"), F.last("first", True).over(behind).alias("ahead"))
    piece = Window.partitionBy("b", "c")
    # both frames grow from the first row of their order: one that ends at the last row would be summed anew for every row
    up = piece.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = piece.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("low", F.max_by("p", held).over(up)).withColumn("high", F.min_by("p", held).over(down)).where(F.col("p").isNull())
    j = near.join(ends, ["b", "c"]).withColumns({"low": F.coalesce("low", "carried"), "high": F.coalesce("high", "ahead")})
    sides = F.filter(F.array("low", "high"), lambda c: c.isNotNull())
    best = F.array_min(F.transform(sides, lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), c["n"].alias("n"), c["x"].alias("at"))))
    return j.select(site, best["n"].alias(index), (best["at"] - F.col("x")).alias("offset"))


def derive(hourly: DataFrame, cos_a: Column, sin_a: Column, zm: float = 30.0, z0: float = 0.05) -> DataFrame:
    """One projection chain from raw hourly values to everything downstream."""
    d = hourly.where(F.col("time_hours") >= 0)
    ue, ve = earth_wind(F.col("u10"), F.col("v10"), cos_a, sin_a)
    d = d.withColumns({"ue": ue, "ve": ve, "hfx": bl.sensible_flux(F.col("acshflsm"))})
    d = d.withColumns(
        {
            "u10m": F.hypot("ue", "ve"),
            "wdir": geo.met_direction(F.col("ue"), F.col("ve")),
            "wth": bl.kinematic_flux(F.col("hfx"), F.col("psfc"), F.col("tk")),
            **hour_parts(F.col("time_hours")),
        }
    )
    d = bl.with_ustar(d, "u10m", "wth", "tk", z0)
    return d.withColumns(
        {
            "u30": bl.profile_wind(F.col("us"), F.col("L"), zm, z0),
            "zl": F.try_divide(F.lit(zm), F.col("L")),
            "zil": F.try_divide(F.col("pblh"), F.col("L")),
            "cls": bl.stability_class(F.try_divide(F.lit(zm), F.col("L"))),
            "oct": geo.octant(F.col("wdir")),
            "qc": (F.col("us") >= 0.15) & isfinite(F.col("pblh")) & (F.col("pblh") > 20),
        }
    )


def _long(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("x")) for v in variables])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.var", "r.x").where(isfinite(F.col("x")))


def _value_table(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """The values of all variables in one narrow table: the derivation runs once, and counts, means and quantiles read this."""
    return finite_rows(_long(df, keys, variables), [*keys, "var"], "x")


def percentiles(df: DataFrame, keys: Sequence[str], variables: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """Exact percentile line per (keys, var): count, mean and one column per prob."""
    on = [*keys, "var"]
    rows = _value_table(df, keys, variables)
    q = quantiles_of(rows, on, probs)
    wide = q.groupBy(*on).agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"p{round(100 * p):d}") for p in probs])
    mean = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return mean.join(wide, on)


def with_groups(derived: DataFrame) -> DataFrame:
    """Each hour once as "all" and once more as "qc" when it passes."""
    return derived.withColumn("grp", F.explode(F.when(F.col("qc"), F.array(F.lit("all"), F.lit("qc"))).otherwise(F.array(F.lit("all")))))


def stability_table(derived: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Share of every stability class and its exact medians."""
    on = [*keys, "cls"]
    rows = _value_table(derived.where("qc"), on, ["pblh", "us", "wth"])
    # every accepted hour has a finite pblh, so their number is the class count
    n = rows.where(F.col("var") == "pblh").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    med = quantiles_of(rows, [*on, "var"], [0.5])
    wide = med.groupBy(*on).agg(*[F.max(F.when(F.col("var") == v, F.col("q"))).alias(f"{v}_p50") for v in ("pblh", "us", "wth")])
    return n.join(tot, list(keys)).join(wide, on).select(*on, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), "pblh_p50", "us_p50", "wth_p50")


def rose_counts(derived: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    return derived.where("qc").groupBy(*keys, "cls", "oct").agg(F.count(F.lit(1)).alias("n"))


def wind_rose(derived: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Class x octant crosstab with both margins, as % of all accepted hours.

    Hours collapse to at most 40 counts per key before the margins fan out.
    """
    c = materialize(rose_counts(derived, keys), "rose")
    margins = F.array(
        F.struct("cls", F.col("oct").cast("string").alias("oct")),
        F.struct("cls", F.lit("all").alias("oct")),
        F.struct(F.lit("all").alias("cls"), F.col("oct").cast("string").alias("oct")),
        F.struct(F.lit("all").alias("cls"), F.lit("all").alias("oct")),
    )
    m = c.select(*keys, "n", F.explode(margins).alias("m")).groupBy(*keys, "m.cls", "m.oct").agg(F.sum("n").alias("n"))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("total"))
    return m.join(tot, list(keys)).select(*keys, "cls", "oct", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def rose_wide(rose: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    names = [str(o) for o in range(8)] + ["all"]
    cols = [F.coalesce(F.max(F.when(F.col("oct") == o, F.col("pct"))), F.lit(0.0)).alias(f"oct_{o}") for o in names]
    return rose.groupBy(*keys, "cls").agg(*cols)


def midday(derived: DataFrame) -> DataFrame:
    """Convective midday hours among the accepted ones."""
    return derived.where(F.col("qc") & F.col("local_hour").between(10, 16) & (F.col("wth") > 0.05))


def sweep_ranges(derived: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    return percentiles(derived.where("qc"), keys, ["pblh", "wth", "us", "u30"], (0.05, 0.25, 0.5, 0.75, 0.95)).drop("mean")
