"""Vector searches against brute force."""

import numpy as np
import pytest

from windprint.llm import bit_search, norm_search
from windprint.llm.common import reachable

SCHEMA = "vec_id long, embedding array<double>, score double, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    reachable(spark)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(24) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    rows += [(i, list(rows[50][1])) for i in range(300, 420)]  # many equal vectors
    rows += [(500, None), (520, []), (540, [0.0] * 24), (560, [float("nan")] * 24), (580, [float("inf")] * 24), (600, [1.0] * 5), (620, [2.0] * 5), (None, rows[0][1]), (50, rows[50][1])]
    rows += [(640, [None] + [1.0] * 23)]
    return spark.createDataFrame([(i, v, 1.0, 1) for i, v in rows], SCHEMA)


def by_hand(rows, every, k, zero):
    good = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            good[r.vec_id] = v if zero is False else [int(np.floor(256 * x)) for x in v]
    out = []
    for q in sorted(good):
        if q % every == 0:
            scores = sorted(((sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])), key=lambda s: (-round(s[0], 9), s[1]))
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scores[:k])]
    return out


def test_bit_search(odd):
    got = sorted(map(tuple, bit_search.nearest(odd).select("query_id", "rank", "vec_id", "score").collect()))
    want = by_hand(odd.collect(), 20, 20, False)
    assert len(got) == len(want)
    hits = len({g[::2][:2] for g in got} & {w[::2][:2] for w in want})
    assert hits / len(want) > 0.97
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(scores[q, i] - s) < 1e-9 for q, _, i, s in got if (q, i) in scores)
    assert bit_search.nearest(odd.limit(0)).count() == 0


def test_bit_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2_000, 64)), rng.standard_normal((20, 64))
    mid, half = bit_search.estimate(*bit_search.encode(x, 3), q, 3, 2.4)
    inside = np.abs(q @ x.T - mid) <= half
    assert inside.mean() > 0.97


@pytest.mark.parametrize("k", [5, 1_000])
def test_norm_search(odd, k):
    got = sorted(map(tuple, norm_search.highest(odd, k=k).collect()))
    assert got == by_hand(odd.collect(), 50, k, True)
    assert norm_search.highest(odd.limit(0)).count() == 0
