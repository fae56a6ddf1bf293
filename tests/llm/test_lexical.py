"""Ranked lexical search against plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from windprint.llm import lexical
from windprint.llm.common import reachable

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string, score long, item_id long, rank string", "item_id long, text string, key string, doc_id string"


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    bags = [(i, Counter(split(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = {}
    for item, times in asked.items():
        scored = []
        for place, (i, b) in enumerate(bags):
            m = 25 + 75 * b.total() * n_docs // max(n_terms, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in times.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, place))
        for rank, (s, null, i, _) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (None if null else i, -s)
    return out


def shown(df):
    rows = df.collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def odd(spark):
    reachable(spark)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "A1", "z"]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(400)]
    docs += [(5, docs[5][1]), (5, "w9 w9 w9"), (None, docs[7][1]), (None, None), (900, None), (901, ""), (902, " .,; \n"), (903, text(40_000)), *[(1000 + i, "w50 w51-w52 NAÏVE") for i in range(150)]]
    items = [(i, text(12)) for i in range(20)] + [(3, "w1 W1"), (50, None), (51, ""), (52, "!?"), (53, "nowhere"), (None, "w40 w41"), (54, "w50, w50: w51"), (55, "the " + "w0 " * 5_000)]
    return docs, items


def frames(spark, odd):
    docs, items = odd
    return spark.createDataFrame([(*d, 1, 2, "r") for d in docs], DOCS), spark.createDataFrame([(*i, "k", "d") for i in items], ITEMS)


def test_against_plain_scoring(spark, odd):
    docs, items = frames(spark, odd)
    want = by_hand(*odd)
    assert shown(lexical.search(docs, items)) == want
    assert {i for i, _ in want}.isdisjoint({50, 51, 52, 53})


def test_passes_agree(spark, odd):
    docs, items = frames(spark, odd)
    assert shown(lexical.search(docs, items, k=3, asked_at_once=60)) == by_hand(*odd, k=3)


def test_empty(spark, odd):
    docs, items = frames(spark, odd)
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, items).count() == lexical.search(docs, nothing).count() == lexical.search(none, nothing).count() == 0


def test_blocks_hold_the_list_and_summaries_bound(odd):
    rng = np.random.default_rng(1)
    n, v = 700, 40
    lists = [np.sort(rng.choice(v, rng.integers(1, 12), replace=False)) for _ in range(n)]
    table = pa.table({"id": range(n), "key": range(n), "terms": pa.array(lists, pa.list_(pa.int32())), "impacts": pa.array([rng.integers(1, 10**6, len(x)) for x in lists], pa.list_(pa.int64()))})
    shard = lexical.Shard(table, v)
    for t in range(v):
        blocks = shard.blocks(t)
        assert sorted(np.concatenate(blocks)) == sorted(shard.posting(t)) == [i for i in range(n) if t in lists[i]]
        for b in blocks:
            assert len(b) <= lexical.BLOCK
            term, most = shard.summary(b)
            item = rng.choice(v, 10, replace=False)
            times = rng.integers(1, 4, 10)
            bound = sum(dict(zip(term, most)).get(x, 0) * c for x, c in zip(item, times))
            assert (shard.scores(b, item, times) <= bound).all()
