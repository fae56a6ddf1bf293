"""N-gram Jaccard join against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from windprint.llm import jaccard_join as jj
from windprint.llm.common import reachable

SCHEMA = "doc_id long, text string, node long, n int, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def by_hand(rows, percent):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                up[find(x)] = find(y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, n):
    w = list(words)
    for p in rng.choice(len(w), n, replace=False):
        w[p] = f"e{rng.integers(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out, base = [], [f"b{i}" for i in range(220)]
    out += [(i, edited(rng, base, int(rng.integers(0, 7)))) for i in range(150)]  # around the threshold among themselves
    for k in range(60):  # pairs of every small size, a word more or another one
        w = [f"s{k}-{i}" for i in range(k + 1)]
        out += [(1_000 + 3 * k, " ".join(w)), (1_001 + 3 * k, " ".join([*w, "more"])), (1_002 + 3 * k, " ".join([*w[:-1], "other"]))]
    chain = [f"c{i}" for i in range(400)]
    out += [(9_000 - i, " ".join(chain[i * 4 : i * 4 + 240])) for i in range(30)]  # each links with its neighbours
    out += [(None, out[3][1]), (7, "Two Words"), (8, "two\twords"), (8, "two words"), (9, None), (10, ""), (11, " \n\t "), (12, "x"), (12, out[300][1]), (13, "lone " * 30_000), (14, "lone " * 29_000), (5, out[5][1]), (5, out[5][1])]
    return out


@pytest.mark.parametrize("percent", [90, 70])
def test_against_all_pairs(spark, rows, percent):
    reachable(spark)
    docs = spark.createDataFrame([(i, t, 1, 2, "l") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in jj.join(docs, percent=percent).collect()), key=repr)
    assert got == by_hand(rows, percent)


def test_listing_again(spark, rows, monkeypatch):
    """Without head rounds and with a first listing of one pair, the passes still find every link."""
    reachable(spark)
    monkeypatch.setattr(jj, "LISTED", 1)
    monkeypatch.setattr(jj, "MORE", 2)
    monkeypatch.setattr(jj, "ROUNDS", 0)
    some = rows[:150]
    docs = spark.createDataFrame([(i, t, 1, 2, "l") for i, t in some], SCHEMA)
    assert sorted((tuple(r) for r in jj.join(docs).collect()), key=repr) == by_hand(some, 90)


def test_empty(spark):
    reachable(spark)
    assert jj.join(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_tiles_hold_all_links(percent):
    first, parts = jj.tiles(3_000, percent)
    for x in range(1, 3_000):
        y = 100 * x // percent
        band = np.searchsorted(first, [x, y], side="right") - 1
        differ = (x + y) * (100 - percent) // (100 + percent)
        if band[0] < 0:
            assert x == y and differ == 0 or y < first[0] and differ == 0
        else:
            assert band[1] - band[0] <= 1 and differ < parts[band[0]]


def test_bitmaps_never_part_links():
    rng = np.random.default_rng(4)
    for n in (1, 9, 64, 65, 700):
        e = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = np.sort(np.r_[e[n // 20 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)])
        bits = jj.bitmaps(np.r_[e, f], np.r_[np.zeros(n, int), np.ones(n, int)], np.array([n, n]))
        apart = int(np.bitwise_count(jj.folded(bits[:1], 8) ^ jj.folded(bits[1:], 8)).sum())
        assert apart <= 2 * n - 2 * jj.overlap(e, f) and jj.overlap(e, f) == len(np.intersect1d(e, f))
        assert jj.may_link(np.array([n]), np.array([n]), np.array([apart]), 90)[0] or 100 * jj.overlap(e, f) < 90 * (2 * n - jj.overlap(e, f))


def test_query(spark):
    from windprint.llm.queries import op11_jaccard_join

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op11_jaccard_join(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 3 and out.filter(F.col("component_id") > F.col("doc_id")).isEmpty()
    assert sorted(map(tuple, out.collect()), key=repr) == by_hand(docs, 90)
