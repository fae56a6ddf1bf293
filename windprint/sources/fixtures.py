"""Model-shaped tables derived from the driver's parquet tables.

Everything here is a narrow projection or one aggregation over a whole input
table, so its size follows the input. Values come from integer arithmetic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Domain
from .spread import joined, tasks

DOMAIN = Domain()
SITE_ORDERS = 15000
PLANE, LEVELS, DUMPS = 8, 6, 16
DUMP_SECONDS = 5.0
# Land-cover codes in the order the fixture hands them out.
COVER_CODES = (40, 10, 30, 80, 50, 90)


def _unit(a: Column, b: Column, ma: int, mb: int, n: int) -> Column:
    """Integer hash mapped to [0, 1)."""
    return ((a * ma + b * mb) % n).cast("double") / float(n)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(F.to_date(ts)).cast("bigint") * 86400000000
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return day + clock.cast("bigint") * 1000000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1000000).cast("bigint")


class Tables:
    """Lazy accessors; nothing is read until a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------ releases, touchdowns
    @staticmethod
    def _run(o: str = "o_orderkey") -> list[Column]:
        site = F.floor(F.col(o) / SITE_ORDERS).cast("bigint")
        return [site.alias("site"), F.concat("o_orderstatus", site.cast("string")).alias("run_id")]

    @cached_property
    def releases(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        return self.raw("orders").select(
            *self._run(),
            F.col("o_orderkey").alias("particle"),
            (F.lit(900) + (F.col("o_orderkey") * 37) % 1800).cast("double").alias("t_release"),
            (F.lit(5.0) + (F.col("o_custkey") % 21 - 10).cast("double") / 10.0).alias("rel_u"),
            ((F.col("o_orderkey") % 13 - 6).cast("double") / 10.0).alias("rel_v"),
            ((cents % 2001 - 900).cast("double") / 1000.0).alias("rel_w"),
        )

    @staticmethod
    def touchdown_columns(li: DataFrame) -> DataFrame:
        pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("bigint")
        dx = (pk * 31 + ln * 17) % 600 * -10 + ((sk * 13) % 41 - 5) * 4
        dy = ((sk * 29 + ln * 7) % 121 - 60) * 15
        return li.select(
            F.col("l_orderkey").alias("particle"),
            (dx.cast("double") + DOMAIN.xr).alias("td_x"),
            (dy.cast("double") + DOMAIN.yr).alias("td_y"),
            (F.col("l_discount") * 4.0).alias("td_w"),
            (F.col("l_quantity") * 18.0).alias("td_age"),
        )

    @cached_property
    def touchdowns(self) -> DataFrame:
        """Event table keyed by (run_id, particle), as an integrator would write it."""
        owner = self.raw("orders").select(F.col("o_orderkey").alias("particle"), *self._run())
        events = self.touchdown_columns(self.raw("lineitem"))
        return joined(events, owner, ["particle"], tasks(events, owner))

    # ------------------------------------------------------------- gridded dumps
    @cached_property
    def cells(self) -> DataFrame:
        """field_cells: one row per (run, step, k, j, i)."""
        key, c = F.col("o_orderkey"), F.col("o_custkey")
        n = F.floor(key / (PLANE * PLANE * LEVELS)).cast("bigint")
        k = F.floor(key / (PLANE * PLANE)).cast("bigint") % LEVELS
        amp = F.greatest(F.lit(1.2) - F.abs(k - 1).cast("double") * 0.3, F.lit(0.1))
        base = self.raw("orders").select(
            F.concat(F.lit("r"), F.floor(n / DUMPS).cast("string")).alias("run_id"),
            (n % DUMPS).alias("step"),
            k.alias("k"),
            (F.floor(key / PLANE).cast("bigint") % PLANE).alias("j"),
            (key % PLANE).alias("i"),
            amp.alias("amp"),
            _unit(key, c, 7919, 31, 2003).alias("a"),
            _unit(key, c, 104729, 17, 1999).alias("b"),
            _unit(key, c, 1299709, 13, 1993).alias("d"),
            _unit(key, c, 15485863, 11, 1987).alias("e"),
            _unit(key, c, 32452843, 7, 1979).alias("g"),
        )
        kd = F.col("k").cast("double")
        return base.select(
            "run_id",
            "step",
            "k",
            "j",
            "i",
            (5.0 + kd / 2.0 + F.col("amp") * (F.col("a") - 0.5)).alias("u"),
            (0.5 + kd / 10.0 + F.col("amp") * (F.col("b") - 0.5)).alias("v"),
            (F.col("amp") * (F.col("d") - 0.5)).alias("w"),
            ((F.col("e") * 0.5 + 0.05) * (1.0 - kd / 8.0)).alias("tke"),
            (300.0 + kd / 2.0 + (F.col("g") - 0.5) / 5.0 + F.col("amp") * (F.col("d") - 0.5) * (0.2 - kd / 10.0)).alias("theta"),
            F.when(F.col("step") == 0, 4.0 + 9.0 * kd + kd * kd / 2.0).alias("z_pos"),
        )

    @cached_property
    def surface_dumps(self) -> DataFrame:
        """surface_cells: one row per (run, step, j, i)."""
        return (
            self.cells.groupBy("run_id", "step", "j", "i")
            .agg(F.avg("tke").alias("m_e"), F.avg("w").alias("m_w"), F.avg("theta").alias("m_t"))
            .select(
                "run_id",
                "step",
                "j",
                "i",
                (0.2 + F.col("m_e") / 2.0).alias("ustar"),
                (0.01 + F.col("m_e") / 20.0).alias("z0m"),
                ((F.col("m_w") - 0.2) / 50.0).alias("inv_l"),
                F.when(F.col("run_id") != "r1", (F.col("m_t") - 301.0) / 20.0).alias("ht_flux"),
            )
        )

    # ------------------------------------------------------------------- rasters
    @cached_property
    def pixels(self) -> DataFrame:
        """Fine survey pixels over each site's 64 x 64 raster."""
        pk, sk, ok, ln = (F.col(c).cast("bigint") for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
        j, i, q = (pk * 31 + ln * 17) % 64, (sk * 29 + ok * 7) % 64, F.col("l_quantity").cast("bigint")
        block = (F.floor(j / 8) + F.floor(i / 8) * 3).cast("bigint") % 6
        idx = F.when((block == 3) | (q % 3 != 0), block).otherwise((block + q) % 6)
        codes = F.array(*[F.lit(c) for c in COVER_CODES])
        wet = 250.0 + F.col("l_tax") / 11.0
        dry = 251.0 + F.col("l_extendedprice") / 4999.0 + j.cast("double") / 8.0
        return self.raw("lineitem").select(
            F.floor(F.col("l_orderkey") / SITE_ORDERS).cast("bigint").alias("site"),
            j.alias("j"),
            i.alias("i"),
            F.when(block == 3, wet).otherwise(dry).alias("elevation"),
            F.get(codes, idx.cast("int")).alias("lcclass"),
        )

    # ----------------------------------------------------------------- time series
    @cached_property
    def hourly(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            (F.col("user_id") % 3).alias("site"),
            e.alias("rec"),
            F.floor((micros("ts") - 307584000000000) / 3600000000).cast("bigint").alias("time_hours"),
            (F.col("value") / 40.0 - 3.0).alias("u10"),
            (((e * 7919) % 2001 - 1000).cast("double") / 200.0).alias("v10"),
            ((e * 104729) % 1501 - 300).cast("double").alias("acshflsm"),
            ((e * 31) % 2000).cast("double").alias("pblh"),
            (280 + e % 25).cast("double").alias("tk"),
            (98000 + e % 3000).cast("double").alias("psfc"),
        )

    @cached_property
    def tower(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            (F.col("user_id") % 10).alias("station"),
            F.col("ts"),
            (3.0 + F.col("value") / 100.0).alias("u"),
            ((e % 21 - 10).cast("double") / 10.0).alias("v"),
            ((e % 41 - 20).cast("double") / 50.0).alias("w"),
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        line = (
            F.when(F.col("event_type") == "error", F.lit("****CORRUPTED*** --- (#NaN, 0)"))
            .when(F.col("event_type") == "purchase", F.lit("simulation is complete"))
            .otherwise(F.concat(F.lit("step "), F.col("event_id").cast("string")))
        )
        return self.raw("events").select(
            F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), "ts", line.alias("line")
        )

    @cached_property
    def tracks(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            F.col("user_id").alias("particle"),
            F.col("event_id").alias("seq"),
            (micros("ts") / 1000000).alias("t"),
            F.floor(micros("ts") / 86400000000).cast("bigint").alias("day"),
            (-(e % 997)).cast("double").alias("x"),
            (e % 89).cast("double").alias("y"),
            (F.col("value") / 10.0).alias("z"),
        )
