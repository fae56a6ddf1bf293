"""File-level access to dump series, surface tables and results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP_PATTERN = r"\.(\d+)(?:\.parquet)?$"


def dump_series(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, dt: float | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Dump files ``<base>.<step>[.parquet]`` with the step taken from the name.

    Only the asked columns are read; a column that some files lack is NULL there.
    Pass ``schema`` for a long series: it saves opening every footer first.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)).parquet(path)
    step = F.regexp_extract(F.col("_metadata.file_name"), STEP_PATTERN, 1)
    keep = [c for c in (columns or df.columns) if c in df.columns]
    out = df.select(*keep, F.when(step != "", step.cast("bigint")).alias("step"))
    return out.withColumn("t", F.col("step") * dt) if dt is not None else out


def listed_steps(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(step, path) of the dump files below ``path``, by step: from their names alone, none is opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        at = found.next().getPath()
        hit = re.search(STEP_PATTERN, at.getName())
        if hit:
            out.append((int(hit.group(1)), at.toString()))
    return sorted(out)


def dump_window(
    spark: SparkSession, path: str, first: int, last: int, columns: Sequence[str] | None = None, schema: T.StructType | None = None, stride: int = 1
) -> DataFrame:
    """The dumps of steps ``first`` to ``last`` of a series, every ``stride``-th of them, as :func:`dump_series` gives them.

    Steps come from the file names, and only the files of the window are opened: a series of a thousand dumps costs a
    listing and the dumps asked for. A window without dumps gives no rows; it needs ``schema`` then.
    """
    paths = [p for s, p in listed_steps(spark, path) if first <= s <= last][::stride]
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("step", T.LongType())]))
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    df = reader.parquet(*paths)
    step = F.regexp_extract(F.col("_metadata.file_name"), STEP_PATTERN, 1)
    return df.select(*[c for c in (columns or df.columns) if c in df.columns], step.cast("bigint").alias("step"))


def newest_file(spark: SparkSession, path: str, file_format: str = "binaryFile") -> DataFrame:
    """Path of the most recently written file below ``path`` (names only, no content)."""
    df = spark.read.format(file_format).option("recursiveFileLookup", True).load(path)
    m = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime")).distinct()
    return m.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))


def union_runs(*runs: DataFrame) -> DataFrame:
    """Bag union of runs whose optional columns differ."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


_CURVE = T.ArrayType(
    T.StructType(
        [
            T.StructField("t_back", T.DoubleType()),
            T.StructField("integral", T.DoubleType()),
            T.StructField("frac", T.DoubleType()),
            T.StructField("peak_x", T.DoubleType()),
            T.StructField("x80", T.DoubleType()),
        ]
    )
)
_DISP = T.ArrayType(
    T.StructType([T.StructField(n, T.DoubleType()) for n in ("max_disp", "frac_of_Lx", "integral")])
)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# Superset of both generations of result files: old ones carry centroid_x/_y and
# x80_near/_far, new ones centroid_e/_n and areas in hectares.
_METRICS = _doubles(
    "peak_x",
    "mean_x",
    "x80",
    "integral",
    "centroid_x",
    "centroid_y",
    "x80_near",
    "x80_far",
    "area80_cells",
    "thr80",
    "centroid_e",
    "centroid_n",
    "centroid_dist",
    "centroid_bearing",
    "area80_ha",
    "area50_ha",
    "peak_e",
    "peak_n",
    "peak_value",
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dirs", T.ArrayType(T.StringType())),
        T.StructField("zm", T.DoubleType()),
        T.StructField("tback", T.DoubleType()),
        T.StructField("rel_seconds", T.DoubleType()),
        T.StructField("res", T.DoubleType()),
        T.StructField(
            "stats",
            _doubles(
                "z_recept", "u_mean", "wdir", "sigma_u", "sigma_v", "sigma_w", "sigma_v_resolved", "sigma_w_resolved", "e_sgs", "ustar", "htFlux", "theta0", "L", "h", "n_dumps", "U", "V"
            ),
        ),
        T.StructField("les", _METRICS),
        T.StructField("kljun", _METRICS),
        T.StructField("overlap_kljun", T.DoubleType()),
        T.StructField("overlap50_kljun", T.DoubleType()),
        T.StructField("integral_les", T.DoubleType()),
        T.StructField("integral_les_all", T.DoubleType()),
        T.StructField("integral_kljun", T.DoubleType()),
        T.StructField("cover_share", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("cover_share_nowrap", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("wrapped_fraction", T.DoubleType()),
        T.StructField("wind_angle", T.DoubleType()),
        T.StructField("capture", _CURVE),
        T.StructField("by_disp", _DISP),
        T.StructField("halves", _doubles("overlap", "dpeak", "dcentroid")),
    ]
)


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Result JSON files under one superset schema; absent fields are NULL."""
    df = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.json)?$", 1)
    return df.select(name.alias("tag"), "*")


def cover_shares(results: DataFrame) -> DataFrame:
    """(tag, cover, share): the unwrapped map where it has entries, else the folded one."""
    from ..operators.compare import first_non_empty

    m = first_non_empty(F.col("cover_share_nowrap"), F.col("cover_share"))
    return results.select("tag", F.explode(m).alias("cover", "share"))


def write_footprint(cells: DataFrame, summary: DataFrame, path: str) -> None:
    """Footprint arrays as parquet by run, one summary JSON row per run."""
    cells.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/cells")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_surface(surface: DataFrame, meta: DataFrame, path: str) -> None:
    surface.write.mode("overwrite").partitionBy("site").parquet(f"{path}/surface")
    meta.write.mode("overwrite").parquet(f"{path}/grid_meta")


def write_climate(derived: DataFrame, path: str) -> None:
    derived.write.mode("overwrite").partitionBy("site").parquet(path)


def pending(tags: DataFrame, done: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Tags still without a result, optionally narrowed to a chosen list."""
    t = tags.where(F.col("tag").isin(*only)) if only else tags
    return t.join(done.select("tag").distinct(), "tag", "left_anti")


def with_results(tags: DataFrame, done: DataFrame) -> DataFrame:
    return tags.join(done.select("tag").distinct(), "tag", "left_semi")
