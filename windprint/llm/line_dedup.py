"""Removal of passages that repeat, by windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_of

WIDTH = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with three more columns: the text without repeated passages, its lines, and the lines removed.

    Every run of ``width`` consecutive lines is a window. Of the windows that occur more than once in the whole
    table, in one document or several, the first in the order of id, text hash and position stays; the lines of all
    later ones are removed, overlapping windows being merged. Windows are judged on the input. A window of blank
    lines alone never counts. Windows are compared by 128 bits of hash.

    The new columns are ``kept_text``, ``n_lines`` and ``n_removed`` (with underscores appended if a column of that
    name exists). Nulls: a null text stays null with 0 lines; a null id orders first. An empty text has one line.
    Texts of fewer than ``width`` lines have no window and stay as they are. Rows that agree in id and text are one
    document and are treated alike. No row is dropped; all columns are kept.
    """
    key, tie, lines, windows, starts = fresh(docs, "line_key", "line_tie", "line_list", "line_windows", "line_starts")
    kept, n_lines, n_removed = fresh(docs, "kept_text", "n_lines", "n_removed")
    keyed = docs.withColumns({key: F.col(id_col), tie: F.xxhash64(F.col(text_col), F.length(text_col))})
    listed = keyed.filter(F.col(text_col).isNotNull()).select(F.col(key).alias("id"), F.col(tie).alias("tie"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    parts = ", ".join(f"lines[p + {i}]" for i in range(width))
    one = (
        listed.filter(F.size("lines") >= width)
        .select("id", "tie", F.explode(F.expr(
            f"filter(transform(sequence(0, size(lines) - {width}), p -> named_struct('pos', p, 'a', xxhash64({parts}), 'b', xxhash64('second', {parts}),"
            f" 'blank', trim(concat({parts})) = '')), w -> not w.blank)")).alias("w"))
        .select("id", "tie", "w.pos", "w.a", "w.b")
    )
    place = F.struct("id", "tie", "pos")
    firsts = materialize(
        one.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first"),
        "line-firsts",
    )
    later = one.join(firsts, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("id").alias(f"{key}r"), F.col("tie").alias(f"{tie}r")).agg(F.collect_set("pos").alias(starts))
    joined = keyed.join(covered, F.col(key).eqNullSafe(F.col(f"{key}r")) & (F.col(tie) == F.col(f"{tie}r")), "left").withColumn(lines, F.split(F.col(text_col), "\n", -1))
    gone = F.flatten(F.transform(F.col(starts), lambda s: F.sequence(s, s + (width - 1))))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return joined.withColumn(windows, F.when(F.col(starts).isNotNull(), rest)).select(
        *docs.columns,
        F.when(F.col(windows).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(F.col(windows), lambda i: F.get(F.col(lines), i)), "\n")).alias(kept),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(n_lines),
        F.when(F.col(windows).isNull(), 0).otherwise(F.size(lines) - F.size(windows)).alias(n_removed),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text; documents of which nothing is left are dropped.

    Columns stay as they are; a column ``n_chars``, if there is one, follows the text.
    """
    done = repeated_lines(docs, id_col, text_col)
    kept, _, removed = done.columns[-3:]
    left = done.filter((F.col(removed) == 0) | (F.trim(F.col(kept)) != ""))
    new = {text_col: F.col(kept)} | ({"n_chars": F.when(F.col(removed) > 0, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return left.withColumns(new).select(*docs.columns)
