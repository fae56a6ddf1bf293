"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from windprint.llm import bpe, dart_minhash, line_dedup, mixing, pii, quality, sharding, suffix_dedup
from windprint.llm.common import reachable

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    reachable(spark)
    p = "\n".join(f"line {i} of a passage that several documents share with each other" for i in range(8))
    rows = [
        (1, p + "\nalone here"), (2, "start\n" + p), (3, p), (3, p), (4, None), (5, ""), (None, p), (6, "one\ntwo"), (7, "  \n\n\n \n"),
        (8, "word " * 30_000 + "end\n" + p), (9, "äöü " * 40 + p), (10, ""), (11, "x" * 60_000),
    ]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", None, 5, "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sharding(spark, odd, nothing):
    for docs in (odd, documents(spark)):
        n = docs.count()
        got = sharding.shard_documents(docs).toPandas()
        want = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).toPandas()
        assert sorted(got["size"]) == sorted(want["n"] + 8) and len(got) == n
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        assert (got.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
        assert got["shard"].between(0, 23).all()
    sizes = got.groupby("shard")["size"].sum()
    heaviest = got.groupby("text_crc32")["size"].sum().max()
    assert sizes.max() <= max(heaviest, got["size"].sum() / 24 + heaviest)
    assert sharding.shard_documents(nothing).count() == 0


def minimax(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, need, fill = (low + high) // 2, 1, 0
        for s in sizes:
            need, fill = (need, fill + s) if fill + s <= mid else (need + 1, s)
        low, high = (low, mid) if need <= k else (mid + 1, high)
    return low


def test_cuts_are_minimax(spark):
    rng = np.random.default_rng(2)
    for n, k in ((40, 7), (5, 8), (1, 1), (300, 24)):
        sizes = [int(x) for x in rng.integers(1, 500, n)]
        starts = sharding._cuts(spark.createDataFrame(list(enumerate(sizes)), "cell int, size long"), k)
        parts = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], n])]
        assert len(parts) <= k and sum(parts) == sum(sizes) and max(parts) == minimax(sizes, k)


def lines_by_hand(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        ls = t.split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if "".join(w).strip() and first.setdefault(w, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out[i] = ("\n".join(x for j, x in enumerate(ls) if j not in gone), len(ls), len(gone))
    return out


def test_line_dedup(spark, odd, nothing):
    docs = documents(spark)
    want = lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == want and sum(n for *_, n in want.values()) > 0
    rows = line_dedup.repeated_lines(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= {"size", "label", "kept_text"}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0 and by[1][0].kept_text == "alone here" and by[2][0].kept_text == "start"
    assert [r.n_removed for r in by[3]] == [8, 8] and by[4][0].kept_text is None and by[5][0].n_lines == 1 and by[7][0].n_removed == 0
    assert line_dedup.without_repeats(odd).columns == odd.columns and line_dedup.without_repeats(nothing).count() == 0


def test_mixing(spark, odd, nothing):
    m = mixing.mix(documents(spark)).toPandas()
    weight = m["weight"] * m["tokens"]
    for name, power in mixing.TEMPER.items():
        target = m.groupby(name)["tokens"].sum() ** power
        share = weight.groupby(m[name]).sum()
        assert np.allclose(share, target / target.sum(), atol=1e-4)
    assert np.isclose((m["expected"] * m["tokens"]).sum(), mixing.RATE * m["tokens"].sum(), rtol=1e-6)
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.filter("weight is null or weight < 0 or expected is null or copies is null").count() == 0
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == 0


def test_mixing_sample_without_repeats(spark, odd, nothing):
    """The kept tokens are the rate of all on average although rare cells are capped; c by going through the cells in order."""
    rows = [("a", "x", "prose", 9000, 0.45), ("b", "x", "prose", 900, 0.25), ("c", "y", "prose", 90, 0.2), ("d", "y", "brief", 10, 0.1), ("e", "y", "brief", 0, 0.0)]
    cells = mixing.calibrate(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")).toPandas()
    some = cells[cells["tokens"] > 0].assign(ratio=lambda c: c["weight"] / c["tokens"]).sort_values("ratio", ascending=False)
    left, mass = mixing.RATE * some["tokens"].sum(), some["weight"].sum()
    for _, c in some.iterrows():
        if left / mass * c["ratio"] <= 1:
            break
        left, mass = left - c["tokens"], mass - c["weight"]
    assert np.allclose(some["prob"], np.minimum(1, left / mass * some["ratio"])) and (some["prob"] == 1).sum() == 3
    assert np.isclose((some["prob"] * some["tokens"]).sum(), mixing.RATE * some["tokens"].sum())
    assert cells.loc[cells["tokens"] == 0, "prob"].tolist() == [mixing.RATE]
    m = mixing.mix(documents(spark)).toPandas()
    assert m["prob"].between(0, 1).all() and m.loc[m["prob"] == 1, "sampled"].all() and not m["sampled"].all()
    assert mixing.mix(odd).filter("prob is null or sampled is null").count() == 0 and "sampled" in mixing.mix(nothing).columns


def test_mixing_sample_meets_targets(spark, odd, nothing):
    sizes = [(900_000, 2000), (4000, 80), (300_000, 700), (3000, 70), (150_000, 400), (2000, 30), (50_000, 100), (1000, 15)]
    rows = [(s, lang, t, *sizes.pop(0)) for s in "ab" for lang in ("en", "de") for t in ("prose", "brief")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    c = mixing.calibrate(mixing.rake(cells)).toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = mixing.mix(docs).toPandas()
    for part, mean, near in ((c, c["expected"], 1e-5), (m, m["copies"], 0.02)):
        kept, total = mean * part["tokens"], part["tokens"].sum()
        assert (mean > 1).any() and abs(kept.sum() / total - mixing.RATE) < near
        for name, power in mixing.TEMPER.items():
            target = part.groupby(name)["tokens"].sum() ** power
            assert np.allclose(kept.groupby(part[name]).sum() / kept.sum(), target / target.sum(), atol=near), name
    few = mixing.mix(documents(spark))
    drawn = mixing.sample(documents(spark), copy_col="copy")
    assert few.agg(F.sum("copies")).first()[0] == mixing.sample(documents(spark)).count() == drawn.select("doc_id", "copy").distinct().count()
    assert mixing.mix(odd).filter("copies is null or copies < 0").count() == 0 and mixing.sample(nothing).count() == 0


PII = [
    (1, "card 4111 1111 1111 1111, again 4111111111111111; not 4111111111111112"), (2, "4111111111111111"), (3, "born 1999-02-28, not 1999-02-30 nor 2023-13-01"),
    (4, "host 10.0.0.255 not 10.0.0.256"), (5, "Call +1 (017) 555-7713!"), (6, "a.b9@mail7.example.com, a.b9@mail7.example.com"), (7, "078-05-1120 but 000-12-3456"),
    (8, None), (9, ""), (10, "no numbers"), (11, "4" * 50_000), (1, "4111111111111111"),
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(d)) % 10 == 0


def test_pii(spark, nothing):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in PII], "doc_id long, text string, kinds string, n_replaced int")
    rows = pii.pseudonymise(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        if r.text is not None and r.doc_id != 4:  # an address keeps four numbers, not their lengths
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", r.new_text)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", r.text))
    cards = re.findall(r"[0-9](?:[ ]?[0-9]){15}", got[1][0].new_text)
    assert cards[0].replace(" ", "") == cards[1] == got[2][0].new_text == got[1][1].new_text != "4111111111111111" and luhn(cards[1])
    assert cards[2] == "4111111111111112" and got[1][0]["n_replaced_"] == 2
    assert "1999-02-30" in got[3][0].new_text and "1999-02-28" not in got[3][0].new_text
    assert "10.0.0.256" in got[4][0].new_text and "10.0.0.255" not in got[4][0].new_text
    a, b = got[6][0].new_text.split(", ")
    assert a == b != "a.b9@mail7.example.com" and a.endswith("@mail7.example.com")
    assert "000-12-3456" in got[7][0].new_text and "078-05-1120" not in got[7][0].new_text and got[7][0]["kinds_"] == ["ssn"]
    assert got[8][0].new_text is None and got[10][0].new_text == "no numbers" and got[11][0]["n_replaced_"] == 0
    assert pii.pseudonymise(nothing).count() == 0


RUNS = [
    ("10045 2023-05-17", "date", "10045 ", ""), ("1 4111 1111 1111 1111", "card", "1 ", ""), ("4111 1111 1111 1111 12", "card", "", " 12"),
    ("4111111111111111 123", "card", "", " 123"), ("1234 123-45-6789", "ssn", "1234 ", ""), ("1234 4111 1111 1111 1111", "card", "1234 ", ""),
    ("7 3782-822463-10005 99", "card", "7 ", " 99"), ("4111 1111 1111 1111 10.0.0.255", "card,ip", "", ""), ("4111 1111 1111 1111 5500 0000 0000 0004", "card", "", ""),
    ("4111111111111111 2023-05-17", "card,date", "", ""), ("000-12-3456 2023-05-17", "date", "000-12-3456 ", ""), ("1899-01-01 2023-05-17", "date", "1899-01-01 ", ""),
    ("41111 11111 11111 1", "card", "", ""), ("1 " * 30_000, "", "1 " * 30_000, ""), ("1111 2222 3333 4445", "", "1111 2222 3333 4445", ""),
]


def test_pii_next_to_other_numbers(spark):
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RUNS)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    single = pii.pseudonymise(spark.createDataFrame([("4111 1111 1111 1111",)], "text string")).first().new_text
    for i, (text, kinds, before, after) in enumerate(RUNS):
        new = got[i].new_text
        assert ",".join(got[i].kinds) == kinds and new.startswith(before) and new.endswith(after) and (new != text) == bool(kinds), text
        if kinds.startswith("card"):
            assert "4111 1111 1111 1111" not in new and "4111111111111111" not in new and ("4111 1111 1111 1111" not in text or single in new), text
        assert not kinds.endswith(("date", "ssn", "ip")) or new.split(" ")[-1] != text.split(" ")[-1], text
    assert got[8].n_replaced == 2 and [got[i].n_replaced for i in (0, 1, 7, 13)] == [1, 1, 2, 0]


def test_feistel_is_a_permutation(spark):
    n = spark.range(229 * 319).select(F.expr(pii.feistel_number("id", 229, 319, "'k'")).alias("y"))
    assert n.agg(F.countDistinct("y"), F.min("y"), F.max("y")).first()[:] == (73051, 0, 73050)
    t = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("t")).select(F.expr(pii.feistel_text("t", "'k'")).alias("y"))
    assert t.distinct().count() == 10_000 and t.filter("y rlike '^[0-9]{4}$'").count() == 10_000


def test_quality(spark, odd, nothing):
    reachable(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    apart = got[got["held_out"]]
    assert len(apart) > 40 and (apart["predicted"] == apart["quality"]).mean() > 0.95
    assert apart[apart["quality"] == 1]["predicted"].mean() > 0.97
    few = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(odd, few).toPandas()
    assert len(rows) == odd.count() and rows["score"].between(0, 1).all()
    assert quality.classify(odd, few.limit(0)).filter("score != 0.5").count() == 0
    assert quality.classify(nothing, few).count() == 0


def test_bpe(spark, odd, nothing):
    reachable(spark)
    enc = bpe.encoding(bpe.RANKS)
    more = [(-1, " " * 40_000 + "b"), (-2, "x \n\ny  " * 9_000), (-3, "é" * 3_000 + "''s're " * 5_000 + "\n" * 20_000 + "end"), (-4, "a" * 16_380 + "'re " + "b'll" * 5_000)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = bpe.round_trip(docs).collect()
    assert len(got) == docs.count()
    want = {(r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in docs.collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want
    assert all(bytes(r.decoded) == enc.decode_bytes(r.ids) for r in got)
    assert bpe.encode(odd.withColumnRenamed("label", "ids")).columns[-1] == "ids_" and bpe.encode(nothing).count() == 0


def shingle_sets(texts):
    out = []
    for t in texts:
        w, counts, s = (t or "").lower().split(), {}, set()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
            s.add((g, counts[g]))
        out.append(s)
    return out


def classes_by_hand(rows, least=0.8):
    ids, sets = [i for i, _ in rows], shingle_sets([t for _, t in rows])
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_copies(spark, odd, nothing):
    reachable(spark)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for i in range(60):  # a dense group, near the threshold among itself
        w = list(base)
        for j in rng.choice(300, 3, replace=False):
            w[j] = f"v{rng.integers(10**6)}"
        rows.append((10_000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}
    want = classes_by_hand(rows)
    assert got == want and sum(k != v for k, v in want.items()) > 60
    some = dart_minhash.classes(odd).collect()
    assert len(some) == odd.count() and all((r.class_id is None) == (r.doc_id is None) for r in some)
    assert {r.doc_id: r.class_id for r in some if r.doc_id in (4, 5, 7, 10)} == {4: 4, 5: 5, 7: 7, 10: 10}
    assert {r.class_id for r in some if r.doc_id in (1, 2, 3)} == {1}
    copies = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (2, "another text that nobody else has at all"), (3, "t t2 t3 t4 t5"), (3, "t t2 t3 t4 t5"), (None, "a b c d e f g h i j k l"), (None, "only here, without an id, that is"), (7, None), (8, "")]
    left = dart_minhash.one_of_each(spark.createDataFrame([(i, t, None, None, None, 5, "q") for i, t in copies], SCHEMA))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in (copies[0], copies[2], copies[3], copies[6], copies[7], copies[8]))
    assert dart_minhash.one_of_each(odd).columns == odd.columns and dart_minhash.classes(nothing).count() == 0


def test_exact_pass_over_mixed_buckets(spark):
    reachable(spark)
    rows = [("b", i, lab, main, 6, 3) for i, lab, main in ((1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1))]
    sets = {1: range(0, 100), 2: range(2, 102), 3: range(4, 104), 4: range(6, 106), 5: range(500, 600), 6: range(501, 601)}
    table = spark.createDataFrame([(k, np.array(v, "<u4").tobytes()) for k, v in sets.items()], "node long, shingles binary")
    got = dart_minhash._exact(spark.createDataFrame([(1, *r[1:]) for r in rows], "bucket long, node long, label long, main long, all long, minor long"), table, 0.8)
    assert {frozenset((r.u, r.v)) for r in got.collect()} == {frozenset(x) for x in ((4, 1), (4, 2), (4, 3), (5, 6))}
    joined = dart_minhash._exact(spark.createDataFrame([(1, *r[1:]) for r in rows], "bucket long, node long, label long, main long, all long, minor long"), table, 0.8, of_classes=True)
    assert {frozenset((r.u, r.v)) for r in joined.collect()} == {frozenset(x) for x in ((4, 1), (5, 6))}


def test_components_of_a_long_chain(spark):
    ids = [int(x) for x in np.random.default_rng(3).permutation(10**6)[:300]]
    chain = [*zip(ids, ids[1:]), *zip(range(2_000_000, 2_000_200), range(2_000_001, 2_000_201))]
    got = {r.node: r.label for r in dart_minhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got.keys() == {*ids, *range(2_000_000, 2_000_201)}
    assert len({got[i] for i in ids}) == 1 and len(set(got.values())) == 2 and {*got.values()} <= got.keys()


def repeats_by_hand(rows):
    first, out = {}, []
    for i, t in rows:
        for p in range(len(t) - 49):
            k = t[p : p + 50]
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [suffix_dedup.MANY_DOCS, 1])
def test_suffix_dedup(spark, odd, nothing, many):
    reachable(spark)
    for docs in (documents(spark).select("doc_id", "text"), odd.filter("doc_id is not null and doc_id not in (8, 11)").select("doc_id", "text")):
        got = suffix_dedup.remove_repeats(docs, many_docs=many).withColumn("kept", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == repeats_by_hand([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    rest = suffix_dedup.remove_repeats(odd, many_docs=many).filter("doc_id is null").collect()
    assert len(rest) == 1 and rest[0].n_removed == 0
    assert suffix_dedup.remove_repeats(nothing, many_docs=many).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5, 256])
def test_two_stage_order(letters):
    data = np.random.default_rng(letters).integers(0, letters, 2_000).astype(np.uint8)
    order = suffix_dedup.suffix_order(data, suffix_dedup.eight(data))
    b = data.tobytes()
    assert sorted(order) == list(range(2_000)) and all(b[i : i + 50] <= b[j : j + 50] for i, j in zip(order, order[1:]))


def test_only_wanted_windows_are_sorted():
    """Windows that are asked for come in the same order and classes as among all suffixes, and few others are sorted."""
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5, 256):
        data = rng.integers(0, letters, 900).astype(np.uint8)
        data = np.concatenate([data, data[200:500], data])
        n, word = len(data), suffix_dedup.eight(data)
        for share in (0.02, 0.5):
            inside = (rng.random(n) < share) & (np.arange(n) <= n - suffix_dedup.LENGTH)
            some = suffix_dedup.suffix_order(data, word, wanted=inside)
            every = suffix_dedup.suffix_order(data, word)
            assert list(some[inside[some]]) == list(every[inside[every]])
            order, group = suffix_dedup.equal_windows(data, inside)
            window = [data[i : i + suffix_dedup.LENGTH].tobytes() for i in order]
            assert sorted(order) == list(np.nonzero(inside)[0])
            assert all((x == y) == (g == h) for x, y, g, h in zip(window, window[1:], group, group[1:]))
            if letters > 2 and share < 0.1:
                assert len(some) < n / 5


def test_short_phrases_shared_by_chance_move_no_texts():
    """Texts with a common phrase in different surroundings have no common gram; a repeat of 50 bytes at any place has."""
    rng = np.random.default_rng(5)

    def letters(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    def sent(texts):
        def row(block, i, text):
            return pa.table({"block": pa.array([block], pa.int32()), "doc": pa.array([i], pa.int64()), "md5": [str(i)], "text": pa.array([text.encode()], pa.binary())})

        tables = [row(i, i, t) for i, t in enumerate(texts)]
        grams = pa.concat_tables([suffix_dedup._gram_rows(1, suffix_dedup.MANY_DOCS)((pa.scalar(i),), t) for i, t in enumerate(tables)])
        states = suffix_dedup._shared_rows((pa.scalar(0),), grams)
        got = [suffix_dedup._context_rows(1)((pa.scalar(i),), t, states.filter(pc.equal(states.column("block"), i))) for i, t in enumerate(tables)]
        covered = suffix_dedup._cover_rows((pa.scalar(0),), pa.concat_tables(got))
        return sum(t.num_rows for t in got), covered.column("block").to_pylist()

    phrase = "in the light of the words of "
    assert sent([letters(80) + phrase + letters(80) for _ in range(60)]) == (0, [])
    for _ in range(60):
        repeat, a, b = letters(suffix_dedup.LENGTH), *rng.integers(0, 70, 2)
        assert sent([letters(a) + repeat + letters(70 - a), letters(b) + repeat + letters(70 - b)])[1] == [1]


def test_updates_equal_a_plain_loop():
    """The classifier's updates against follow-the-regularised-leader written out for one coordinate at a time."""
    rng = np.random.default_rng(7)
    rows = [(float(rng.integers(2)), np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.random(6)) for _ in range(60)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + np.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for label, number, value in rows:
            w = [weight(i) for i in number]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
            for i, a, x in zip(number, w, value):
                g = (p - label) * x
                s = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * a, n.get(i, 0.0) + g * g
    got = quality.fit(rows)
    assert np.allclose(got[:40], [weight(i) for i in range(40)], atol=1e-5) and not got[40:].any()
