"""Queries over files as a user has them: dump series by name, result JSON, and what the sinks have written."""

from pyspark.sql import functions as F

from ..operators import footprint as fp, levels as lv
from ..sources import dumps
from ..sources.fixtures import DUMP_SECONDS
from ..sources.shared_table import shared_folder
from .climate import derived
from .registry import query
from .shared import RUN, frames, static_map, surface
from .surface import KEY


def _rename(spark, folder, name):
    """Give the one part file of each sub-folder of ``folder`` the name that ``name`` makes of the sub-folder's."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for sub in fs.listStatus(root):
        for part in fs.listStatus(sub.getPath()) if sub.isDirectory() else []:
            fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name(sub.getPath().getName().split('=')[1])}"))


# ---- dump series ------------------------------------------------------------------------
def dump_files(t):
    """The dumps of run r0 and r1 as files ``WIN-<run>.<step>``."""
    folder = shared_folder(t.spark, "dumps")
    tag = F.concat(F.lit("WIN-"), "run_id", F.lit("."), F.col("step").cast("string"))
    rows = t.cells.where(F.col("run_id").isin("r0", "r1")).select(tag.alias("tag"), "run_id", "k", "j", "i", "u", "w")
    rows.repartition("tag").write.partitionBy("tag").parquet(folder)
    _rename(t.spark, folder, lambda tag: tag)
    return folder


@query(
    "dump_window",
    """SELECT run_id, step, k, avg(u) AS "U", var_pop(w) AS ww, count(*) AS n FROM fx_cells WHERE run_id IN ('r0', 'r1') AND step BETWEEN 5 AND 11 GROUP BY run_id, step, k""",
    {"U": 8, "ww": 8},
)
def _(t):
    d = dumps.dump_window(t.spark, dump_files(t), 5, 11, ["run_id", "k", "u", "w"])
    return d.groupBy("run_id", "step", "k").agg(F.avg("u").alias("U"), F.var_pop("w").alias("ww"), F.count(F.lit(1)).alias("n"))


# ---- result files of two generations ------------------------------------------------------
@query(
    "result_files",
    """SELECT 'win_' || run_id AS tag, CASE WHEN n_particles % 2 = 0 THEN NULL ELSE 'inf'::DOUBLE END AS "L", CASE WHEN n_particles % 2 = 0 THEN NULL ELSE n_particles/100.0::DOUBLE END AS area80_ha,
      CASE WHEN n_particles % 2 = 0 THEN n_particles/50.0::DOUBLE END AS centroid_x, 'water' AS cover, CASE WHEN n_particles % 2 = 0 THEN 0.25 ELSE 0.125 END::DOUBLE AS share FROM frames""",
)
def _(t):
    folder = shared_folder(t.spark, "json")
    n = F.col("n_particles")
    num = lambda x: x.cast("string")
    new = F.concat(F.lit('{"stats": {"L": Infinity, "h": 900.0},\n "les": {"area80_ha": '), num(n / 100.0), F.lit('},\n "cover_share": {"water": 0.5}, "cover_share_nowrap": {"water": 0.125}}'))
    old = F.concat(F.lit('{"les": {"centroid_x": '), num(n / 50.0), F.lit(', "x80_near": 30.0},\n "cover_share": {"water": 0.25}, "cover_share_nowrap": {}}'))
    body = frames(t).select(F.concat(F.lit("win_"), "run_id").alias("tag"), F.when(n % 2 == 0, old).otherwise(new).alias("body"))
    body.repartition("tag").write.partitionBy("tag").text(folder)
    _rename(t.spark, folder, lambda tag: f"{tag}.json")
    r = dumps.result_files(t.spark, folder)
    shares = dumps.cover_shares(r).select("tag", "cover", "share")
    return r.select("tag", "stats.L", "les.area80_ha", "les.centroid_x").join(shares, "tag")


# ---- sinks ----------------------------------------------------------------------------------
@query("footprint_file", "SELECT run_id, j, i, f, sum(f) OVER (PARTITION BY run_id)*576 AS integral FROM fmap", {"f": 12, "integral": 7})
def _(t):
    path = shared_folder(t.spark, "footprint")
    cells = static_map(t).select("run_id", "j", "i", "f")
    dumps.write_footprint(cells, cells.groupBy("run_id").agg((F.sum("f") * 576.0).alias("integral")), path)
    back = t.spark.read.parquet(f"{path}/cells").select(F.col("run_id").cast("string").alias("run_id"), "j", "i", "f")
    return back.join(t.spark.read.schema("run_id string, integral double").json(f"{path}/summary"), RUN)


@query("surface_file", 'SELECT site, j, i, z0m, water, 24.0::DOUBLE AS dx FROM srf', {"z0m": 6})
def _(t):
    path = shared_folder(t.spark, "surface")
    s = surface(t).select(*KEY, "z0m", "water")
    dumps.write_surface(s, s.select("site").distinct().withColumn("dx", F.lit(24.0)), path)
    back = t.spark.read.parquet(f"{path}/surface").select(F.col("site").cast("bigint").alias("site"), "j", "i", "z0m", "water")
    return back.join(t.spark.read.parquet(f"{path}/grid_meta"), "site")


@query("climate_file", "SELECT site, cls, count(*) AS n, avg(us) AS us FROM cl3 WHERE site = 1 GROUP BY site, cls", {"us": 7})
def _(t):
    path = shared_folder(t.spark, "climate")
    dumps.write_climate(derived(t).select("site", "cls", "us"), path)
    one = t.spark.read.parquet(path).where("site = 1")  # one partition is listed and opened
    return one.groupBy(F.col("site").cast("bigint").alias("site"), "cls").agg(F.count(F.lit(1)).alias("n"), F.avg("us").alias("us"))


@query(
    "union_runs",
    """SELECT run_id, count(*) AS n, avg(u) AS u, avg(CASE WHEN run_id > 'r1' THEN theta END) AS theta FROM fx_cells GROUP BY run_id""",
    {"u": 8, "theta": 7},
)
def _(t):
    old = t.cells.where("run_id <= 'r1'").select("run_id", "step", "u")
    new = t.cells.where("run_id > 'r1'").select("theta", "u", "run_id")
    return dumps.union_runs(new, old).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u"), F.avg("theta").alias("theta"))


# ---- averaging period and momentum flux --------------------------------------------------------
@query(
    "averaging_window",
    """WITH s AS (SELECT run_id, step*5.0::DOUBLE AS t, us FROM sfc), b AS (SELECT run_id, greatest(min(t) + 10, max(t) - 30) AS t0, max(t) AS t1 FROM s GROUP BY run_id)
    SELECT run_id, t0 AS t_first, t1 AS t_last, count(*) AS n, avg(us) AS ustar FROM s JOIN b USING (run_id) WHERE t BETWEEN t0 - 1e-6 AND t1 + 1e-6 GROUP BY run_id, t0, t1""",
    {"ustar": 8},
)
def _(t):
    s = lv.surface_means(t.surface_dumps).select("run_id", (F.col("step") * DUMP_SECONDS).alias("t"), "us")
    # ten seconds of history, then at most thirty of the averaging period
    b = s.groupBy("run_id").agg(F.greatest(F.min("t") + 10.0, F.max("t") - 30.0).alias("t_first"), F.max("t").alias("t_last"))
    w = fp.averaging_period(s.join(b, "run_id"), F.col("t_first"), F.col("t_last"))
    return w.groupBy("run_id", "t_first", "t_last").agg(F.count(F.lit(1)).alias("n"), F.avg("us").alias("ustar"))


@query("momentum_ustar", "SELECT run_id, step, pow(uw*uw + vw*vw, 0.25) AS ustar_flux FROM prof WHERE k = 0", {"ustar_flux": 8})
def _(t):
    return lv.momentum_ustar(lv.dump_profiles(t.cells))
