"""N-gram Jaccard join: size-banded tiles, bitmap bounds, then exact intersections of sorted arrays.

Sets are dealt to tiles by size, so that two sets similar enough to link share a tile. In a tile the universe of
elements is cut to one part more than two linked sets may differ in elements, so they agree in a whole part: members
of a tile meet where a part's elements are the same, not all with all.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced
from .dart_minhash import components
from .words import LOWER, mix, raw, shingles, words

#: Words of a shingle, and least similarity of a link in hundredths.
WIDTH, PERCENT = 3, 90
#: Members of a block in a tile task; pairs of two classes that one task lists at first, and by how much more when that was too few.
BLOCK, LISTED, MORE = 1_024, 32, 16
#: Rows of a tile task, about, and pairs that it looks at together.
BATCH, PAIRS = 20_000, 1 << 20
#: Rounds in which members meet one further head of their bucket before all classes in it meet.
ROUNDS = 1
MOST_BITS = 1 << 15


def elements(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of texts: sorted 64-bit hashes of different shingles, and text numbers."""
    data, offsets = raw(column)
    h, text = shingles(*words(LOWER[data], offsets, split_marks=False), len(column), width)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


@lru_cache(maxsize=64)
def tiles(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and the number of parts of each tile, for sets of up to ``most`` elements.

    Band t holds the sizes from ``first[t]`` to below ``first[t + 1]``, tile t the bands t and t + 1. A set of band t links
    with larger ones of bands t and t + 1 only. Sets of x and y elements that link differ in at most (x + y) (100 -
    percent) / (100 + percent) elements; a tile has one part more than that for its largest pair. Smaller sets than
    ``first[0]`` link with equal ones alone.
    """
    apart = lambda x, y: (x + y) * (100 - percent) // (100 + percent)
    low = next(x for x in range(1, 202) if 100 * x // percent > x or apart(x, x))
    first, parts = [low, low + 1], []
    while first[-2] <= most:
        largest = first[-1] - 1
        parts.append(apart(largest, 100 * largest // percent) + 1)
        first.append(100 * largest // percent + 1)
    return np.array(first), np.array([*parts, 1])


def slots(element: np.ndarray, text: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text a hash of every part of its set, in its own tile and the one below: hashes and text numbers."""
    first, parts = tiles(int(size.max(initial=1)), percent)
    band = np.searchsorted(first, size, side="right") - 1
    keys, owners = [], []
    for down in (0, 1):
        tile = band - down
        count = np.where(tile >= 0, parts[tile], 0)
        begin = np.cumsum(count) - count
        some = tile[text] >= 0
        e, t = element[some], text[some]
        salt = mix(tile.astype(np.uint64) + np.uint64(1 << 40))
        part = ((mix(e ^ salt[t]) >> np.uint64(32)) * count[t].astype(np.uint64)) >> np.uint64(32)
        held = np.zeros(int(count.sum()), np.uint64)
        np.add.at(held, begin[t] + part.astype(np.int64), mix(e + np.uint64(0x9E3779B97F4A7C15)))
        owner = np.repeat(np.arange(len(size)), count)
        place = (np.arange(len(held)) - begin[owner]).astype(np.uint64)
        keys.append(mix(held + mix((tile[owner].astype(np.uint64) << np.uint64(32)) + place)))
        owners.append(owner)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], owner[order]


def bitmaps(element: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set as many bits as it has elements, about (a power of two): bit b says whether an odd number of elements hash to b.

    The bits in which two sets differ are then no more than the elements in which they do.
    """
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 64, MOST_BITS)
    begin = np.cumsum(width) - width
    bit = (mix(element * np.uint64(0xC2B2AE3D27D4EB4F)) & (width[text] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(begin[text] + bit, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[b // 8 : (b + w) // 8].tobytes() for b, w in zip(begin, width)]


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, wider ones folded to ``width`` bytes: bits that meet are added modulo 2."""
    sizes, out = np.array([len(b) for b in bits]), np.zeros((len(bits), width // 8), np.uint64)
    for n in np.unique(sizes):
        rows = np.nonzero(sizes == n)[0]
        wide = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), n // width, width // 8)
        out[rows] = np.bitwise_xor.reduce(wide, axis=1)
    return out


def may_link(x: np.ndarray, y: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of x and y elements whose bitmaps differ in ``apart`` bits link? Their overlap is at most (x + y - apart) / 2."""
    most = np.minimum((x + y - apart) // 2, np.minimum(x, y))
    return 100 * most >= percent * (x + y - most)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays of different elements."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _digest(element: np.ndarray, text: np.ndarray, n: int) -> list[pa.Array]:
    out = []
    for salt in (1, 2):
        h = np.zeros(n, np.uint64)
        np.add.at(h, text, mix(element + np.uint64(salt << 60)))
        out.append(_signed(h))
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``key, id, n, a, b, slots, bits`` of every row: size and 128-bit digest of its set, the hashes of its parts, its bitmap."""

    def sketched(batches):
        for batch in sliced(batches, "text", 1 << 18):
            element, text = elements(batch.column("text"), width)
            size = np.bincount(text, minlength=batch.num_rows)
            a, b = _digest(element, text, batch.num_rows)
            key, owner = slots(element, text, size, percent)
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))].astype(np.int32)
            yield pa.record_batch({
                "key": batch.column("key"), "id": batch.column("id"), "n": pa.array(size.astype(np.int64)), "a": a, "b": b,
                "slots": pa.ListArray.from_arrays(pa.array(ends), _signed(key)), "bits": pa.array(bitmaps(element, text, size), pa.binary()),
            })

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketched, "key long, id long, n long, a long, b long, slots array<long>, bits binary")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, n, bits, elements`` of the wanted nodes (``node, id, a, b, n, bits``): their sets as sorted arrays, made again from the texts.

    A row that shares the id of a node but not its set is left out by the digest.
    """

    def made(batches):
        for batch in sliced(batches, "text", 1 << 18):
            element, text = elements(batch.column("text"), width)
            ends = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))]
            a, b = _digest(element, text, batch.num_rows)
            same = pc.and_(pc.equal(a, batch.column("a")), pc.equal(b, batch.column("b")))
            sets = pa.array([element[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("bits"), sets], ["node", "n", "bits", "elements"]).filter(same)

    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text"))
    found = texts.join(wanted, F.col("text_id").eqNullSafe(F.col("id"))).select("text", "node", "a", "b", "n", "bits")
    return found.mapInArrow(made, "node long, n long, bits binary, elements binary").dropDuplicates(["node"])


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose bitmaps allow a link; ``sets`` are node, n, bits."""

    def bound(batches):
        for batch in batches:
            for part in (batch.slice(i, 1_024) for i in range(0, batch.num_rows, 1_024)):
                x, y = part.column("x").to_pylist(), part.column("y").to_pylist()
                width = np.minimum([len(b) for b in x], [len(b) for b in y])
                apart = np.zeros(len(x), np.int64)
                for w in np.unique(width):
                    rows = np.nonzero(width == w)[0]
                    apart[rows] = np.bitwise_count(folded([x[i] for i in rows], int(w)) ^ folded([y[i] for i in rows], int(w))).sum(1)
                keep = may_link(part.column("n").to_numpy(), part.column("m").to_numpy(), apart, percent)
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"]).filter(pa.array(keep))

    u = sets.select(F.col("node").alias("u"), F.col("n"), F.col("bits").alias("x"))
    v = sets.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("y"))
    sized = pairs.join(u, "u").join(v, "v").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sized.select("u", "v", "n", "m", "x", "y").mapInArrow(bound, "u long, v long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link; ``sets`` are node, elements."""

    def check(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep = []
                for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = overlap(x, y)
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # only sets that some pair needs are dealt out
    pairs = materialize(pairs, "join-pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("needed")).distinct()
    sets = sets.join(needed, F.col("node") == F.col("needed"), "left_semi").select("node", "elements")
    u, v = (sets.select(F.col("node").alias(c), F.col("elements").alias(e)) for c, e in (("u", "x"), ("v", "y")))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the classes that links (u, v) join made one; nodes without a label are their own."""
    named = links.join(labels.toDF("u", "x"), "u", "left").join(labels.toDF("v", "y"), "v", "left")
    into = components(materialize(named.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")), "join-links")).toDF("old", "into")
    fresh_ = into.join(labels.select(F.col("label").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("into").alias("label"))
    moved = labels.join(into, F.col("label") == F.col("old"), "left").select("node", F.coalesce("into", "label").alias("label"))
    return materialize(moved.union(fresh_), "join-labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``slot, node, label, main, minor, all``: members of the buckets that hold several classes.

    ``main`` is the largest class, ``all`` the members, ``minor`` those outside it.
    """
    named = members.join(labels, "node", "left").select("slot", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("slot", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("slot").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    mixed = mixed.filter("classes > 1").select("slot", F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("minor"), "all")
    return materialize(named.join(mixed, "slot"), "join-mixed")


def _pairs(segment: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (side 0, side 1) of all rows that meet; rows are sorted by segment and side."""
    n = int(segment[-1]) + 1
    zeros, ones = np.bincount(segment[side == 0], minlength=n), np.bincount(segment[side == 1], minlength=n)
    first = np.r_[0, np.cumsum(zeros + ones)[:-1]] + zeros
    left = np.nonzero(side == 0)[0]
    count = ones[segment[left]]
    x = np.repeat(left, count)
    return x, first[segment[x]] + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)


def _apart(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps differ; of two widths the wider is folded."""
    width = np.array([len(b) for b in bits])
    out, least = np.zeros(len(x), np.int64), np.minimum(width[x], width[y])
    for w in np.unique(least):
        some = np.nonzero(least == w)[0]
        rows = np.unique(np.r_[x[some], y[some]])
        at = np.zeros(len(bits), np.int64)
        at[rows] = np.arange(len(rows))
        packed = folded([bits[i] for i in rows], int(w))
        for part in np.array_split(some, max(1, len(some) * int(w) >> 22)):
            out[part] = np.bitwise_count(packed[at[x[part]]] ^ packed[at[y[part]]]).sum(1)
    return out


def _met(rows: DataFrame, sets: DataFrame, percent: int, listed: int) -> DataFrame:
    """Pairs (u, v) of different classes in a bucket whose bitmaps allow a link.

    Members outside the largest class meet all members, in blocks; many small buckets share a task. Of two classes a
    task lists the ``listed`` nearest pairs; for those that it leaves a row with their ``slot`` alone says so.
    """
    blocks = {k: F.ceil(F.col(k) / BLOCK).cast("int") for k in ("minor", "all")}
    own = {k: F.pmod(F.xxhash64("node", F.lit(k)), n.cast("long")).cast("int") for k, n in blocks.items()}
    zero = rows.filter("label != main").select("slot", own["minor"].alias("i"), F.explode(F.sequence(F.lit(0), blocks["all"] - 1)).alias("j"), F.lit(0).alias("side"), "node", "label")
    one = rows.select("slot", F.explode(F.sequence(F.lit(0), blocks["minor"] - 1)).alias("i"), own["all"].alias("j"), F.lit(1).alias("side"), "node", "label")
    batches = rows.count() // BATCH + 1
    batch = F.pmod(F.xxhash64("slot", "i", "j"), F.lit(batches)).alias("batch")
    full = zero.union(one).join(sets.select(F.col("node").alias("m"), "n", "bits"), F.col("node") == F.col("m")).select(batch, "slot", "i", "j", "side", "node", "label", "n", "bits")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("slot", "i", "j", "side")])
        slot, i, j, side, node, label, n = (table.column(c).to_numpy() for c in ("slot", "i", "j", "side", "node", "label", "n"))
        bits = table.column("bits").to_pylist()
        segment = np.cumsum(np.r_[False, (slot[1:] != slot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        found = []
        # a few whole segments at a time: about as many pairs as one full block makes
        sizes = np.bincount(segment)
        ends = np.cumsum(sizes)
        cost = np.cumsum(sizes.astype(np.int64) ** 2) // PAIRS
        for group in np.split(np.arange(len(sizes)), np.nonzero(np.diff(cost))[0] + 1):
            low, high = int(ends[group[0]] - sizes[group[0]]), int(ends[group[-1]])
            x, y = _pairs(segment[low:high] - segment[low], side[low:high])
            x, y = x + low, y + low
            fits = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[fits], y[fits]
            swap = node[x] < node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            # a pair that met in several buckets is looked at once
            order = np.lexsort((node[y], node[x]))
            x, y = x[order], y[order]
            once = np.r_[True, (node[x[1:]] != node[x[:-1]]) | (node[y[1:]] != node[y[:-1]])] if len(x) else np.zeros(0, bool)
            x, y = x[once], y[once]
            apart = _apart(bits, x, y)
            near = may_link(n[x], n[y], apart, percent)
            found.append(np.stack([x[near], y[near], apart[near]]))
        x, y, apart = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        a, b = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((apart, b, a))
        x, y, a, b = x[order], y[order], a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        nth = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
        keep = nth < listed
        left = np.unique(slot[x[~keep]])
        none = pa.nulls(len(left), pa.int64())
        return pa.concat_tables([
            pa.table({"u": node[x[keep]], "v": node[y[keep]], "slot": pa.nulls(int(keep.sum()), pa.int64())}), pa.table({"u": none, "v": none, "slot": left}),
        ])

    return full.groupBy("batch").applyInArrow(meet, "u long, v long, slot long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: the size of its set, and the smallest id that links reach.

    A row's set are its different shingles of ``width`` words (runs of characters other than ASCII white space, A-Z lowered); with
    fewer words the whole sequence is one. Two rows link when 100 |A and B| >= ``percent`` |A or B|. Every link between
    different sets is found: linked sets agree in a part of a common tile (see ``tiles``). Rows of equal sets are
    one node. In each bucket (tile, part and its elements) members meet a few heads, the first in several hashed
    orders, first; buckets that then still hold several classes are gone through in blocks of ``BLOCK``, where members
    outside the largest class meet all others by their bitmaps. Whoever the bitmaps can't part is compared exactly. A
    task lists the nearest ``LISTED`` pairs of two classes; where it had to leave some and the classes didn't become one,
    the pass is made again with more, until nothing is left out. So no link between classes is lost, and a large
    group of copies makes no square of pairs. Shingles and sets are told apart by hashes of 64 and 128 bits.

    Nulls: a null text has no words; rows without words have no shingles, link with nothing and have their own id as
    component. A row with null id takes part; its component is the smallest id it reaches, null if none. Rows that share an id are
    nodes of their own. An empty table gives none. Other columns are ignored.
    """
    sk = materialize(sketch(docs, id_col, text_col, width, percent), "join-sketch")
    some = sk.filter("n > 0")
    equal = materialize(some.groupBy("a", "b").agg(F.min("key").alias("node")), "join-equal")
    nodes = some.join(equal.select("node"), F.col("key") == F.col("node"), "left_semi").withColumnRenamed("key", "node")
    in_slot = nodes.select("node", F.explode("slots").alias("slot")).repartition("slot")
    heads = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("o"), "node"))["node"].alias(f"h{k}") for k in range(2)]
    buckets = in_slot.groupBy("slot").agg(*heads, F.min("node").alias("first"), F.max("node").alias("last")).filter("first != last")
    members = materialize(in_slot.join(buckets.select("slot", F.array("h0", "h1").alias("heads")), "slot"), "join-members")
    kept = members.select(F.col("node").alias("m")).distinct()
    marks = nodes.join(kept, F.col("node") == F.col("m"), "left_semi").select("node", "id", "a", "b", "n", "bits")
    sets = materialize(_sets(docs, marks, id_col, text_col, width), "join-sets")

    def linked(ends: DataFrame) -> DataFrame:
        pairs = ends.filter("head != node").select(F.greatest("head", "node").alias("u"), F.least("head", "node").alias("v")).distinct()
        return _linked(_near(pairs, sets, percent), sets, percent)

    labels = components(materialize(linked(members.select("node", F.explode("heads").alias("head"))), "join-links"))
    members = members.select("slot", "node")
    mixed = _mixed(members, labels)
    for k in range(2, 2 + ROUNDS):
        if mixed.isEmpty():
            break
        # a further head from outside the largest class, for all who aren't of its class
        head = mixed.filter("label != main").groupBy("slot").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("o"), "node", "label")).alias("h"))
        ends = mixed.join(head, "slot").filter("label != h.label").select("node", F.col("h.node").alias("head"))
        labels = _merged(labels, linked(ends))
        mixed = _mixed(mixed.select("slot", "node"), labels)
    listed = LISTED
    while not mixed.isEmpty():
        met = materialize(_met(mixed, sets, percent, listed), "join-met")
        labels = _merged(labels, _linked(met.filter("slot is null").select("u", "v"), sets, percent))
        again = met.filter("slot is not null").select("slot").distinct()
        if again.isEmpty():
            break
        mixed, listed = _mixed(mixed.select("slot", "node").join(again, "slot", "left_semi"), labels), listed * MORE
    rows = sk.select("id", "n", "a", "b").join(equal, ["a", "b"], "left")
    named = rows.join(labels.toDF("labelled", "label"), F.col("node") == F.col("labelled"), "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("class"))
    least = named.filter("class is not null").groupBy(F.col("class").alias("of")).agg(F.min("id").alias("least"))
    out = named.join(least, F.col("class") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
