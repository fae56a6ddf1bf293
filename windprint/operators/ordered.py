"""Order statistics and running mass without one-task-per-group windows.

A plain ``sum() over (partition by key order by value)`` or ``percentile`` puts a whole key into one task. Here the
rows of a key are counted in a histogram between its least and its largest value, the buckets that hold an answer are
counted again between their own least and largest value, and so on, until each holds few rows or one value; only those
rows are ever sorted. Each pass reads the rows where they lie and moves a bounded number of counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import isfinite
from ..sources.shared_table import materialize
from ..sources.spread import tasks

#: Buckets of one histogram, and rows of an interval that is sorted.
BUCKETS, FEW = 1024, 8192


def finite_rows(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, _v, _m): the finite values with their mass (1, or ``weight``), written once for all passes."""
    v = F.col(value).cast("double")
    mass = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return materialize(df.where(isfinite(v)).select(*keys, (v + 0.0).alias("_v"), mass.alias("_m")), "values")


def _other(keys: Sequence[str]) -> list[Column]:
    """The keys under the names that :func:`_same` compares them by."""
    return [F.col(k).alias(f"_key_{k}") for k in keys]


def _same(keys: Sequence[str]) -> Column:
    """Equal keys of two tables, NULL being equal to NULL."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def _meet(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the interval of their key that they lie in; keys may be NULL."""
    named = state.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return rows.join(named, _same(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_key_{k}" for k in keys])


def spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _lo, _hi, _rows, _total): range, count and mass of each key."""
    return rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_rows"), F.sum("_m").alias("_total"))


def narrowed(rows: DataFrame, keys: Sequence[str], span: DataFrame, descending: bool = False, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, _part, _lo, _hi, _rows, _before, _targets): for every target an interval of at most ``few`` rows, or of one value.

    ``span`` has for each key its range, count and ``_targets``, an array of (_id, at): the answer is the first value, in
    order, at which the running mass reaches ``at``. ``_before`` is the mass of what comes before the interval.
    """
    done = []
    state = span.select(*keys, F.lit(0).alias("_part"), "_lo", "_hi", "_rows", F.lit(0.0).alias("_before"), "_targets")
    while True:
        state = materialize(state, "intervals")
        small = (F.col("_rows") <= few) | (F.col("_lo") == F.col("_hi"))
        done.append(state.where(small))
        state = state.where(~small)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bucket = F.least(F.floor(at * buckets), F.lit(buckets - 1))
        hit = _meet(rows, state.select(*keys, "_part", "_lo", "_hi"), keys).select(*keys, "_part", bucket.alias("_b"), "_v", "_m")
        counts = hit.groupBy(*keys, "_part", "_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_rows"), F.sum("_m").alias("_mass"))
        # at most ``buckets`` rows a window
        w = Window.partitionBy(*keys, "_part").orderBy(F.col("_b").desc() if descending else F.col("_b"))
        known = state.select(*_other(keys), F.col("_part").alias("_in"), F.col("_before").alias("_start"), F.col("_targets").alias("_open"))
        same = _same(keys) & (F.col("_part") == F.col("_in"))
        run = counts.join(known, same).withColumns({
            "_through": F.col("_start") + F.sum("_mass").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_n": F.row_number().over(w), "_of": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }).withColumn("_before", F.coalesce(F.lag("_through").over(w), F.col("_start")))
        first, last = F.col("_n") == 1, F.col("_n") == F.col("_of")
        mine = F.filter("_open", lambda t: (first | (t["at"] > F.col("_before"))) & (last | (t["at"] <= F.col("_through"))))
        cut = run.withColumn("_targets", mine).where(F.size("_targets") > 0)
        part = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_b"))
        state = cut.select(*keys, part.alias("_part"), "_lo", "_hi", "_rows", "_before", "_targets")


def select_at(rows: DataFrame, keys: Sequence[str], span: DataFrame, descending: bool = False, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, _id, _v, _before, _through): for each target of ``span`` the first value at which the running mass reaches it,
    and the mass before that value and through it. Equal values are reached together."""
    state = narrowed(rows, keys, span, descending, buckets, few)
    # intervals of different rounds may overlap in one key: tell them apart by their range
    ends = [*keys, "_lo", "_hi"]
    values = _meet(rows, state.select(*ends).distinct(), keys).groupBy(*ends, "_v").agg(F.sum("_m").alias("_mass"))
    w = Window.partitionBy(*ends).orderBy(F.col("_v").desc() if descending else F.col("_v"))
    inside = values.withColumn("_inner", F.sum("_mass").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("_v") == F.col("_lo" if descending else "_hi")
    targets = state.select(*_other(ends), F.col("_before").alias("_start"), F.explode("_targets").alias("_t"))
    same = _same(ends)
    through = F.col("_start") + F.col("_inner")
    # rounding may leave the last running mass just below its target
    reached = inside.join(targets, same).where((through >= F.col("_t.at")) | last)
    order = F.min(F.struct(F.col("_inner").alias("inner"), F.col("_v").alias("v"), F.col("_mass").alias("mass"), F.col("_start").alias("start")))
    first = reached.groupBy(*keys, F.col("_t._id").alias("_id")).agg(order.alias("_f"))
    end = F.col("_f.start") + F.col("_f.inner")
    return first.select(*keys, "_id", F.col("_f.v").alias("_v"), (end - F.col("_f.mass")).alias("_before"), end.alias("_through"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, p, q, n): exact linear-interpolated quantiles of the finite values.

    The count column is left out when a key is itself called n.
    """
    return quantiles_of(finite_rows(df, keys, value), keys, probs)


def quantiles_of(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], few: int = FEW) -> DataFrame:
    """Quantiles from a table of :func:`finite_rows`."""
    place = lambda p: p * (F.col("_rows") - 1)
    targets = F.array(*[F.struct(F.lit(2 * n + up).alias("_id"), (end(place(F.lit(float(p)))) + 1).cast("double").alias("at")) for n, p in enumerate(probs) for up, end in ((0, F.floor), (1, F.ceil))])
    span = materialize(spans(rows, keys), "spans")
    got = select_at(rows, keys, span.withColumn("_targets", targets), few=few)
    pair = got.groupBy(*keys, F.floor(F.col("_id") / 2).cast("int").alias("_nth")).agg(F.max(F.when(F.col("_id") % 2 == 0, F.col("_v"))).alias("v0"), F.max(F.when(F.col("_id") % 2 == 1, F.col("_v"))).alias("v1"))
    sized = span.select(*_other(keys), F.col("_rows"))
    same = _same(keys)
    p = F.get(F.array(*[F.lit(float(x)) for x in probs]), F.col("_nth"))
    t = place(F.col("p")) - F.floor(place(F.col("p")))
    count = [] if "n" in keys else [F.col("_rows").alias("n")]
    return pair.join(sized, same).withColumn("p", p).select(*keys, "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * t).alias("q"), *count)


def wide_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per key with columns p5, p25, ..."""
    long = exact_quantiles(df, keys, value, probs)
    cols = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"p{round(p * 100):d}") for p in probs]
    return long.groupBy(*keys).agg(F.max("n").alias("n"), *cols)


def with_threshold(field: DataFrame, keys: Sequence[str], fracs: dict[str, float], value: str = "f") -> DataFrame:
    """Add, per name in ``fracs``, the value of the first cell in descending
    order whose running sum reaches that share of the key's total (NULL where
    the total is not positive). Equal cells are reached together.

    For gridded fields: a key holds at most one raster (ny * nx cells, fixed by
    the deposition), so one key is sorted in one task. Use
    :func:`mass_threshold` for values without such a bound.
    """
    n = tasks(field)
    if n:
        field = field.repartition(n, *keys)
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    f = field.withColumn("_c", F.sum(value).over(down)).withColumn("_t", F.sum(value).over(whole))
    for name, frac in fracs.items():
        hit = F.when(F.col("_c") >= frac * F.col("_t"), F.col(value))
        thr = F.coalesce(F.max(hit).over(whole), F.min(value).over(whole))
        f = f.withColumn(name, F.when(F.col("_t") > 0, thr))
    return f.drop("_c", "_t")


def mass_threshold(df: DataFrame, keys: Sequence[str], value: str, frac: float) -> DataFrame:
    """(keys, thr, total): value of the first cell, in descending order, whose
    running sum reaches ``frac`` of the total. Keys with total <= 0 are absent.

    The running sum of descending values grows as long as they are positive, so the answer is one of those.
    """
    rows = finite_rows(df, keys, value, value)
    total = rows.groupBy(*_other(keys)).agg(F.sum("_m").alias("_whole")).where("_whole > 0")
    same = _same(keys)
    up = rows.where("_v > 0")
    span = materialize(spans(up, keys).join(total, same).select(*keys, "_lo", "_hi", "_rows", "_whole", F.array(F.struct(F.lit(0).alias("_id"), (frac * F.col("_whole")).alias("at"))).alias("_targets")), "spans")
    got = select_at(up, keys, span, descending=True)
    return got.join(span.select(*_other(keys), "_whole"), same).select(*keys, F.col("_v").alias("thr"), F.col("_whole").alias("total"))


def top_sum(df: DataFrame, keys: Sequence[str], value: str, k: Column) -> DataFrame:
    """(keys, top, biggest, n): sum of |value| over the k largest signed values.

    ``k`` may use the row count column ``total``. Copies of the k-th value are
    counted only as often as needed, so ties cannot change the sum.
    """
    rows = finite_rows(df, keys, value)
    span = materialize(spans(rows, keys).withColumn("total", F.col("_total")).withColumn("_take", F.least(k.cast("double"), F.col("_total"))), "spans")
    got = select_at(rows, keys, span.withColumn("_targets", F.array(F.struct(F.lit(0).alias("_id"), F.col("_take").alias("at")))), descending=True)
    named, same = _other(keys), _same(keys)
    edge = span.select(*keys, "_take", "_hi", "_total").join(got.select(*named, "_v", "_before"), same).select(*keys, "_take", "_hi", "_total", F.col("_v").alias("_edge"), "_before")
    above = rows.join(edge.select(*named, "_edge"), same).where(F.col("_v") > F.col("_edge")).groupBy(*keys).agg(F.sum(F.abs("_v")).alias("_over"))
    whole = edge.join(above.withColumnsRenamed({c: f"_key_{c}" for c in keys}), same, "left")
    return whole.select(*keys, (F.coalesce("_over", F.lit(0.0)) + (F.col("_take") - F.col("_before")) * F.abs("_edge")).alias("top"), F.greatest(F.abs("_hi"), F.abs("_edge")).alias("biggest"), F.col("_total").alias("n"))


def lag_in_blocks(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``prev_<col>`` of the preceding row of each key, split by time block.

    Only one block of one key is sorted in a task; the row before a block's
    first comes from the last row of the key's previous non-empty block.
    """
    w = Window.partitionBy(*keys, block).orderBy(*order)
    last = (
        df.groupBy(*keys, block)
        .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("tail"))
        .withColumn("carry", F.lag("tail").over(Window.partitionBy(*keys).orderBy(block)))
        .select(*keys, block, "carry")
    )
    out = df.withColumn("_prev", F.lag(F.struct(*cols)).over(w)).join(last, [*keys, block])
    out = out.withColumn("_prev", F.coalesce("_prev", "carry"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols])
