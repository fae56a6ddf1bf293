"""Raking of token weights to source, language and topic shares, and sampling by the calibrated numbers of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, text_of, unit_hash

#: Exponents that temper token shares into target shares, in the order of raking.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.5}
SWEEPS, STEP, TOLERANCE = 12, 3, 1e-10
#: Share of all tokens that the sample holds on average.
RATE, SEED = 0.6, 20


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text: noise, figures, brief or prose."""
    return F.when(text.rlike("[#$%&*!]{2,}"), "noise").when(text.rlike("[0-9]"), "figures").when(F.length(text) < 400, "brief").otherwise("prose")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("long")


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, sweeps: int = SWEEPS, step: int = STEP) -> DataFrame:
    """Iterative proportional fitting of ``cells``, one row per combination that occurs, with its ``tokens``.

    The target share of a category is its token share to the power ``temper[dimension]``, scaled to sum 1. Each sweep
    scales the weights to the targets of one dimension after another; ``step`` sweeps make one job. It ends when every
    share is within ``TOLERANCE`` of its target, or after ``sweeps`` sweeps. Adds ``weight``; weights sum to 1.
    """
    targets = {name: f"{name}_target" for name in temper}
    for name, power in temper.items():
        tokens = cells.groupBy(F.col(name).alias("category")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("tempered"))
        whole = tokens.agg(F.sum("tempered")).first()[0] or 1.0
        tokens = tokens.select("category", (F.col("tempered") / whole).alias(targets[name]))
        cells = cells.join(tokens, F.col(name).eqNullSafe(F.col("category"))).drop("category")
    weighed = cells.withColumn("weight", F.col("tokens").cast("double"))
    share = {name: F.sum("weight").over(Window.partitionBy(name)) for name in temper}
    for _ in range(0, sweeps, step):
        for _ in range(step):
            for name in temper:
                weighed = weighed.withColumn("weight", F.when(share[name] > 0, F.col("weight") * F.col(targets[name]) / share[name]).otherwise(0.0))
        weighed = materialize(weighed, "mix-cells")
        gaps = [
            weighed.groupBy(name).agg(F.abs(F.sum("weight") - F.first(targets[name])).alias("gap")).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
            for name in temper
        ]
        if gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).first()[0] <= TOLERANCE:
            break
    return weighed.drop(*targets.values())


def calibrate(weighed: DataFrame, rate: float = RATE) -> DataFrame:
    """Adds ``expected`` and ``prob`` to raked cells.

    ``expected`` is the mean number of copies of a document, rate * total * weight / tokens: copies drawn so hold ``rate``
    of all tokens and meet every target in expectation, at any input size; a document of a rare cell is taken several
    times. ``prob`` is for a sample without repeats: min(1, c * weight / tokens), c such that the kept tokens are ``rate``
    of all on average; where cells are capped at 1 it misses the targets. A cell without tokens is kept at ``rate``. Only
    sums over the cells are needed: c grows from round to round while further cells reach 1.
    """
    some = weighed.filter("tokens > 0").select("tokens", "weight", (F.col("weight") / F.col("tokens")).alias("ratio"))
    total, mass = some.agg(F.sum("tokens"), F.sum("weight")).first()
    even = factor = rate * (total or 0) / (mass or 1.0)
    capped = 0
    while total:
        full = F.col("ratio") * F.lit(float(factor)) > 1 + 1e-12
        cells, kept, rest = some.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if cells == capped or not rest:
            break
        capped, factor = cells, (rate * total - kept) / rest
    ratio = F.col("weight") / F.col("tokens")
    return weighed.withColumns({
        "expected": F.when(F.col("tokens") > 0, F.lit(float(even)) * ratio).otherwise(rate),
        "prob": F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(factor)) * ratio)).otherwise(rate),
    })


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    temper: dict[str, float] = TEMPER, rate: float = RATE, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``weight`` (raked weight of a token), ``prob``, ``sampled``, ``expected`` and ``copies``.

    Only the token sums of the cells (source, language, topic) are raked. ``sampled`` is whether a sample without repeats
    takes the document: a hash of its id, the seed and its text lies below its cell's ``prob``. ``copies`` is how often the
    sample that meets the targets takes it: the whole part of its cell's ``expected`` number, and one more when the same hash
    lies below the rest, so a retried task and a repeated row decide alike. Null source or language is a category of its own; a null text has no tokens and the
    topic of an empty one; cells without tokens have weight 0. An empty table gives an empty result. All columns are kept;
    a new one gets underscores appended where its name is taken.
    """
    topic, tokens, weight, prob, sampled, expected, copies = fresh(docs, "topic", "tokens", "weight", "prob", "sampled", "expected", "copies")
    parts = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic_of(text_of(text_col))}
    sized = docs.withColumns({topic: parts["topic"], tokens: token_count(text_of(text_col))})
    cells = materialize(sized.groupBy(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens")), "mix-cells")
    probs = materialize(calibrate(rake(cells, temper), rate), "mix-probs").select(
        F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), F.col("topic").alias("cell_topic"),
        F.coalesce(F.col("weight") / F.nullif("tokens", F.lit(0)), F.lit(0.0)).alias("cell_weight"), F.col("prob").alias("cell_prob"), F.col("expected").alias("cell_expected"),
    )
    same = F.col(source_col).eqNullSafe(F.col("cell_source")) & F.col(lang_col).eqNullSafe(F.col("cell_lang")) & (F.col(topic) == F.col("cell_topic"))
    drawn = unit_hash(F.lit(seed), F.col(id_col), F.md5(text_of(text_col)))
    whole = F.floor("cell_expected")
    return sized.join(probs, same).select(
        *docs.columns, topic, tokens, F.col("cell_weight").alias(weight), F.col("cell_prob").alias(prob), (drawn < F.col("cell_prob")).alias(sampled),
        F.col("cell_expected").alias(expected), (whole + (drawn < F.col("cell_expected") - whole).cast("long")).alias(copies),
    )


def sample(docs: DataFrame, copy_col: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say, columns as they were.

    ``copy_col`` names a further column that numbers the copies of a row from 1.
    """
    mixed = mix(docs, **options)
    copies = F.col(mixed.columns[-1])
    (copy,) = [copy_col] if copy_col else fresh(mixed, "copy")
    drawn = mixed.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return drawn.select(*docs.columns, *([copy] if copy_col else []))
