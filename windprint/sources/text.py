"""Case files, run logs and report texts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASE_LINE = r"^\s*([A-Za-z]\w*)\s*=\s*([^#]*?)\s*(?:#\s*(.*))?$"
# Tokens that reject a run log, and its completion banner.
CORRUPT = "CORRUPTED"
NOT_FINITE = r"#NaN|#Inf|[-+\s](nan|inf)(\s|$)"
ERRORS = "CRITICAL ERROR|_FAIL|MPI_ERR|too many resources|Segmentation"
BANNER = "simulation is complete"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole small text files, one row each."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of run logs, split by line so a long log spreads over tasks."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) from whole files."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def parse_case(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``key = value # comment`` lines; anything else is dropped."""
    part = lambda n: F.regexp_extract("line", CASE_LINE, n)
    out = lines.select(*keys, part(1).alias("key"), part(2).alias("value"), F.nullif(part(3), F.lit("")).alias("comment"))
    return out.where(F.col("key") != "")


def differing_keys(params: DataFrame) -> DataFrame:
    """Keys that do not hold one value over all cases."""
    v = params.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    g = v.groupBy("key").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_cases"))
    return g.where(F.col("n_values") > 1)


def acoustic_cfl(params: DataFrame, case: str, sound: float = 347.2) -> DataFrame:
    """Combined 3-D acoustic CFL number of each case."""
    num = lambda k: F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))).alias(k)
    p = params.where(F.col("key").isin("dt", "dx", "dy", "dz")).groupBy(case).agg(num("dt"), num("dx"), num("dy"), num("dz"))
    inv = lambda c: F.try_divide(F.lit(1.0), F.col(c) * F.col(c))
    return p.withColumn("cfl", F.col("dt") * sound * F.sqrt(inv("dx") + inv("dy") + inv("dz")))


def missing_restarts(params: DataFrame, files: DataFrame, case: str) -> DataFrame:
    """Cases whose restart file is not in ``files`` (name)."""
    need = params.where(F.col("key").isin("inPath", "inFile")).groupBy(case).agg(
        F.coalesce(F.max(F.when(F.col("key") == "inPath", F.col("value"))), F.lit("")).alias("dir"),
        F.max(F.when(F.col("key") == "inFile", F.col("value"))).alias("file"),
    )
    need = need.where(F.col("file").isNotNull() & (F.col("file") != "")).select(case, F.concat("dir", "file").alias("name"))
    return need.join(files.select("name"), "name", "left_anti").select(case, "name")


def score_log(lines: DataFrame, keys: list[str], exit_code: Column | None = None) -> DataFrame:
    """Token counts and verdict per log."""
    hit = lambda p: F.count_if(F.col("line").rlike(p))
    rc = F.lit(0) if exit_code is None else F.max(exit_code)
    g = lines.groupBy(*keys).agg(
        hit(CORRUPT).alias("corrupt"), hit(NOT_FINITE).alias("not_finite"), hit(ERRORS).alias("errors"), hit(BANNER).alias("banner"), rc.alias("rc")
    )
    ok = (F.col("corrupt") == 0) & (F.col("not_finite") == 0) & (F.col("errors") == 0) & (F.col("banner") > 0) & (F.col("rc") == 0)
    return g.withColumn("verdict", F.when(ok, "OK").otherwise("REJECTED"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, seq, line) of text files of any length: ``block`` is where the split of a line begins in its file,
    ``seq`` rises with the lines of a split."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    return df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")
    )


def after_header(lines: DataFrame, keys: list[str], header: Column, row: Column) -> DataFrame:
    """The rows that follow a key's first header line, up to its first line that is neither header nor row.

    ``lines`` has the keys, block, seq and line; blocks of a key are in order, and lines within a block. It is a scan by
    segments: each block says with a few minima what it does to a reader that comes in before, within or after the
    table; what that reader is when it comes to a block follows from the small table of blocks; then every line decides
    for itself. No file, and no block, is gathered in a task.
    """
    kinds = lines.select(*keys, "block", "seq", "line", F.when(header, "head").when(row, "row").otherwise("other").alias("kind"))
    first = lambda c: F.min(F.when(c, F.col("seq")))
    ends = kinds.where("kind != 'row'")
    per = ends.groupBy(*keys, "block").agg(first(F.col("kind") == "head").alias("head"), first(F.col("kind") == "other").alias("other"))
    on = [*keys, "block"]
    after = ends.where("kind = 'other'").join(per.where("head is not null").select(*on, "head"), on).where(F.col("seq") > F.col("head"))
    blocks = per.join(after.groupBy(*on).agg(F.min("seq").alias("shut")), on, "left")
    # one row for each split of a file
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("begun", F.coalesce(F.max(F.col("head").isNotNull()).over(earlier), F.lit(False)))
    blocks = blocks.withColumn("ends", F.when(F.col("begun"), F.col("other").isNotNull()).otherwise(F.col("shut").isNotNull()))
    blocks = blocks.withColumn("over", F.coalesce(F.max("ends").over(earlier), F.lit(False)))
    # a block of rows alone has no entry of its own: the last one before it tells how it is entered
    entry = kinds.select(*on).distinct().join(blocks, on, "left")
    left = F.struct((F.col("begun") | F.col("head").isNotNull()).alias("begun"), (F.col("over") | F.col("ends")).alias("over"))
    entry = entry.withColumn("was", F.last(F.when(F.col("begun").isNotNull(), left), True).over(earlier))
    state = entry.select(*on, F.coalesce("begun", "was.begun", F.lit(False)).alias("begun"), F.coalesce("over", "was.over", F.lit(False)).alias("over"), "head", "other", "shut").where("not over")
    hit = kinds.where("kind = 'row'").join(state, on)
    inside = F.col("begun") & (F.col("other").isNull() | (F.col("seq") < F.col("other")))
    starts = ~F.col("begun") & (F.col("seq") > F.col("head")) & (F.col("shut").isNull() | (F.col("seq") < F.col("shut")))
    return hit.where(inside | F.coalesce(starts, F.lit(False))).select(*on, "seq", "line")


def cover_report(lines: DataFrame, key: str = "path") -> DataFrame:
    """Land-cover share lines that directly follow the share header of a report.

    ``lines`` are those of :func:`split_lines`, or numbered by ``line_no`` where a file is known to be small.
    """
    if "block" not in lines.columns:
        lines = lines.select(key, F.lit(0).alias("block"), F.col("line_no").alias("seq"), "line")
    block = after_header(lines, [key], F.col("line").contains("land-cover share"), F.col("line").contains("(domain area share"))
    name = F.when(F.trim("line").startswith("solar"), "array").otherwise(F.regexp_extract(F.trim("line"), r"^(\S+)", 1))
    return block.select(
        key,
        name.alias("cover"),
        F.regexp_extract("line", r"([-\d.]+)%", 1).cast("double").alias("share_pct"),
        F.regexp_extract("line", r"area share\s+([-\d.]+)%", 1).cast("double").alias("area_pct"),
    )
