import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from windprint.operators import ordered


def skewed(spark, n=6000, seed=0):
    """Two thirds of the rows share one key, a third of those one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    val = np.where(rng.random(n) < 0.33, 7.25, rng.standard_t(2, n) * 10)
    rows = [(str(k), float(v)) for k, v in zip(key, val)]
    return spark.createDataFrame(rows, "k string, v double"), key, val


def test_quantiles_equal_numpy_on_a_hot_key(spark):
    df, key, val = skewed(spark)
    probs = [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    got = {(r.k, r.p): r.q for r in ordered.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k in set(key):
        want = np.percentile(val[key == k], [100 * p for p in probs])
        assert np.allclose([got[(k, p)] for p in probs], want)


def test_quantiles_skip_non_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None), ("a", float("inf"))], "k string, v double")
    r = ordered.exact_quantiles(df, ["k"], "v", [0.5]).first()
    assert (r.q, r.n) == (2.0, 2)


def brute_threshold(v, frac):
    flat = np.sort(v)[::-1]
    cum = np.cumsum(flat) / v.sum()
    return flat[np.searchsorted(cum, frac)] if cum[-1] >= frac else flat[-1]


def test_both_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = {k: rng.gamma(0.5, 2.0, 900) - 0.05 for k in ("x", "y")}
    df = spark.createDataFrame([(k, float(a)) for k, arr in v.items() for a in arr], "k string, f double")
    for frac in (0.5, 0.8):
        a = {r.k: r.thr for r in ordered.mass_threshold(df, ["k"], "f", frac).collect()}
        b = {r.k: r.t for r in ordered.with_threshold(df, ["k"], {"t": frac}).select("k", "t").distinct().collect()}
        for k in v:
            want = brute_threshold(v[k], frac)
            assert np.isclose(a[k], want) and np.isclose(b[k], want)


def test_threshold_absent_for_non_positive_total(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 0.5)], "k string, f double")
    assert ordered.mass_threshold(df, ["k"], "f", 0.8).count() == 0
    assert ordered.with_threshold(df, ["k"], {"t": 0.8}).where("t is not null").count() == 0


def test_top_sum_counts_ties_once(spark):
    df, key, val = skewed(spark, 3000, 5)
    k = 250
    got = {r.k: (r.top, r.biggest, r.n) for r in ordered.top_sum(df, ["k"], "v", F.lit(float(k))).collect()}
    for name in set(key):
        x = np.sort(val[key == name])[::-1]
        top = np.abs(x[:k])
        assert np.allclose(got[name], (top.sum(), top.max(), len(x)))


def test_lag_across_blocks_equals_plain_lag(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.7 else "cold", int(t), float(z)) for t, z in zip(rng.permutation(2000), rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "k string, t long, z double").withColumn("blk", F.floor(F.col("t") / 97))
    got = ordered.lag_in_blocks(df, ["k"], "blk", ["t"], ["t", "z"]).select("k", "t", "prev_t", "prev_z")
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.lag("t").over(w).alias("prev_t"), F.lag("z").over(w).alias("prev_z"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_an_outlier_leaves_small_intervals(spark):
    rng = np.random.default_rng(9)
    n = 20_000
    df = spark.createDataFrame([("a", float(x)) for x in np.r_[rng.normal(size=n - 2), 1e200, -1e9]] + [("b", 2.0)] * 300 + [(None, 1.0), (None, 4.0)], "k string, v double")
    rows = ordered.finite_rows(df, ["k"], "v")
    targets = F.array(*[F.struct(F.lit(i).alias("_id"), F.ceil(F.lit(p) * F.col("_rows")).cast("double").alias("at")) for i, p in enumerate((0.05, 0.5, 0.95))])
    parts = ordered.narrowed(rows, ["k"], ordered.spans(rows, ["k"]).withColumn("_targets", targets), few=100).collect()
    assert all(r._rows <= 0.02 * n or r._lo == r._hi for r in parts) and sum(r.k == "a" for r in parts) == 3
    got = {(r.k, r.p): (r.q, r.n) for r in ordered.quantiles_of(rows, ["k"], [0.05, 0.5, 1.0], few=100).collect()}
    a = [r.v for r in df.where("k = 'a'").collect()]
    assert np.allclose([got["a", p][0] for p in (0.05, 0.5, 1.0)], np.quantile(a, [0.05, 0.5, 1.0]))
    assert got["b", 0.5] == (2.0, 300) and got[None, 0.5] == (2.5, 2)
