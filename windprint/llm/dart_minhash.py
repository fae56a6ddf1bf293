"""Near-duplicate documents by DartMinHash signatures, banded joining and verified similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, sliced
from .words import LOWER, mix, raw, shingles, words

#: Words of a shingle, least weighted Jaccard similarity of a link, bands of a signature and coordinates of a band.
WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 36, 7
#: Smallest rank interval; members of a block in the exact pass over mixed buckets.
FINEST, BLOCK = 1 / 64, 256


def elements(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The weighted shingle sets of texts as unit elements: hashes and text numbers.

    Words are runs of bytes other than white space, ASCII letters lowered. A shingle that occurs w times has the
    weight w: it gives one element for each unit interval of weight, so sets of equal elements are equal weighted sets.
    """
    data, offsets = raw(column)
    h, text = shingles(*words(LOWER[data], offsets, split_marks=False), len(column), width)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(h))
    unit = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    return mix(h + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), text


def intervals():
    """Rank intervals: begin, width of a cell and number of cells; each but the first is as long as all before it."""
    yield 0.0, FINEST, 1
    begin = FINEST
    while True:
        yield begin, min(begin, 1.0), max(1, int(begin))
        begin *= 2


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts of a Poisson law from uniform numbers."""
    p = np.exp(-mean) * np.cumprod(np.r_[1.0, mean / np.arange(1, 16)])
    return np.searchsorted(np.cumsum(p), u, side="right").astype(np.int64)


def signatures(element: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """``size`` coordinates for each text; two texts agree in one with the probability of their weighted Jaccard similarity.

    Darts fall on each element's region of unit weight at the points of a Poisson process along the rank axis. They
    are drawn from hashes of the element and the cell of the rank axis alone, so equal regions get equal darts. Each
    dart has a hashed coordinate, and each coordinate keeps its earliest dart. Intervals of growing rank are taken
    until every coordinate of a text is hit; texts without elements keep zeros.
    """
    out = np.zeros(n_texts * size, np.uint64)
    hit = np.zeros(n_texts * size, bool)
    open_ = np.bincount(text, minlength=n_texts) > 0
    for begin, cell, cells in intervals():
        live = open_[text]
        if not live.any():
            return out.reshape(n_texts, size)
        element, text = element[live], text[live]
        step = max(1, (1 << 21) // cells)
        found = []
        for s in range(0, len(element), step):
            place = np.arange(cells, dtype=np.uint64) + np.uint64(int(begin / FINEST) << 20)
            seed = mix((element[s : s + step, None] ^ mix(place)[None, :]).ravel())
            owner = np.repeat(text[s : s + step], cells)
            count = poisson((seed >> np.uint64(11)).astype(np.float64) / (1 << 53), cell)
            some = np.nonzero(count)[0]
            count = count[some]
            which = np.repeat(some, count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(seed[which] + (nth + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            coordinate = ((dart >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            rank = (which % cells) * cell + (mix(dart) >> np.uint64(11)).astype(np.float64) * (cell / (1 << 53))
            found.append((owner[which] * size + coordinate.astype(np.int64), rank, dart))
        slot, rank, dart = (np.concatenate(x) for x in zip(*found))
        free = ~hit[slot]
        slot, rank, dart = slot[free], rank[free], dart[free]
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out[slot[first]], hit[slot[first]] = dart[first], True
        open_ &= ~hit.reshape(n_texts, size).all(1)
    raise AssertionError


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: ``id``, a 128-bit digest of its weighted shingle set (nulls without shingles), a hash for each band, and the set as sorted 32-bit hashes."""

    def sketched(batches):
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            element, text = elements(batch.column("text"))
            count = np.bincount(text, minlength=n)
            ends = np.concatenate([[0], np.cumsum(count)])
            digest = np.zeros((2, n), np.uint64)
            for i, salt in enumerate((1, 2)):
                np.add.at(digest[i], text, mix(element + np.uint64(salt << 60)))
            sig = signatures(element, text, n, bands * rows).reshape(n, bands, rows)
            h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
            for i in range(rows):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, i])
            short = (element >> np.uint64(32)).astype("<u4")
            order = np.lexsort((short, text))
            short = short[order]
            none = pa.array(count == 0)
            parts = [short[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.record_batch({
                "id": batch.column("id"), "a": pa.compute.if_else(none, None, _signed(digest[0])), "b": pa.compute.if_else(none, None, _signed(digest[1])),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), _signed(h.ravel())),
                "shingles": pa.array(parts, pa.binary()),
            })

    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(sketched, "id long, a long, b long, bands array<long>, shingles binary")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of unit elements, given as sorted hashes."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    # an element occurs once in a set but for rare equal hashes
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(len(both) - shared, 1)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (u, v): one node of its connected component, the same for all of it.

    Nodes are taken in a hashed order. In each round every node points to its first neighbour before it, and edges are
    drawn anew between what their ends point to, equal ones being one: a star vanishes in one round, and a chain has
    no long run in that order, whatever its ids. Then the pointers are followed, from the first round to the last. The
    edges of each round are written, so a lost executor costs its tasks only; the pointers follow from them by one
    aggregation.
    """
    x, y = (F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("id")) for c in ("u", "v"))
    ends = materialize(edges.filter("u != v").select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "near-edges")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    rounds = []
    while not ends.isEmpty():
        up = ends.groupBy(F.col("u").alias("low")).agg(F.min("v").alias("high"))
        moved = ends.join(up.select(F.col("low").alias("u"), F.col("high").alias("x")), "u")
        moved = moved.join(up.select(F.col("low").alias("v"), F.col("high").alias("y")), "v", "left").select("x", F.coalesce("y", "v").alias("y"))
        ends = materialize(moved.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "near-edges")
        rounds.append(up)
    labels = nodes.select("node", F.col("node").alias("label"))
    for up in rounds:
        labels = labels.join(up.withColumnRenamed("low", "label"), "label", "left").select("node", F.coalesce("high", "label").alias("label"))
    labels = materialize(labels.select("node.id", "label.id").toDF("node", "label"), "near-labels")
    # a label may itself have been moved in the round that reached it
    while True:
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = materialize(labels.join(further, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "near-labels")
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of at least that similarity."""

    def check(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keep = [similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= least for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    sized = pairs.join(y, "v").join(x, "u")
    least_size, most_size = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    return sized.filter(least_size >= most_size * least).select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``id, class_id, copy_of`` of every row: the smallest id of its class, and of the rows with the same shingles.

    Two documents are linked when their weighted sets of five-word shingles have a Jaccard similarity of ``least`` or
    more and their DartMinHash signatures agree in all coordinates of a band; classes are the connected components
    of links. A pair of similarity 0.8 shares a band with probability 0.9998.

    Documents of equal sets collapse to one node first. In each bucket (band and its hash) every node is compared
    with two heads, the first in two hashed orders, not with all others: the pairs are at most twice the members.
    Buckets that then hold several classes are gone through exactly: their members outside the largest class meet all
    members, in blocks, inside tasks that emit links between classes alone, and none twice. So no link between bucket
    members of different classes is lost, and a group of thousands of copies never makes all pairs. Similarities are
    exact up to equal 32-bit hashes of different shingles.

    Nulls: a row with null id is in no class (both columns null). Null and empty texts, or blank ones, have no
    shingles and are a class of their own each. Texts under five words have one shingle of all their words. Rows
    that share an id count as one document. Extra columns are ignored.
    """
    sk = materialize(sketch(docs, id_col, text_col, bands, rows), "near-sketch")
    some = sk.filter(F.col("id").isNotNull() & F.col("a").isNotNull())
    copies = materialize(some.groupBy("a", "b").agg(F.min("id").alias("node")), "near-copies")
    nodes = some.join(copies.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "node"), (F.col("id") == F.col("node")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")))
    in_band = nodes.select("node", F.explode("bands").alias("bucket"))
    # the same orders for all bands: a node of a dense group meets the same few heads in most of its buckets
    first, second = (F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("o"), "node")).alias(f"h{k}") for k in (1, 2))
    heads = in_band.groupBy("bucket").agg(first, second, F.max("node").alias("most"), F.min("node").alias("least"))
    heads = materialize(heads.filter("most != least").select("bucket", F.array("h1.node", "h2.node").alias("heads")), "near-heads")
    members = materialize(in_band.join(heads, "bucket"), "near-members")
    sets = materialize(nodes.join(members.select(F.col("node").alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi").select("node", "shingles"), "near-sets")
    labels = components(materialize(_checked(_pairs(members), sets, least), "near-links"))
    # buckets that are still mixed are gone through exactly
    named, mixed = _mixed(members, labels)
    if not mixed.isEmpty():
        more = components(materialize(_exact(named.join(mixed, "bucket"), sets, least, of_classes=True).distinct(), "near-rest"))
        joined = named.select("node", "label").distinct().join(more.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left")
        labels = materialize(joined.select("node", F.coalesce("into", "label").alias("label")), "near-labels")
    smallest = labels.groupBy("label").agg(F.min("node").alias("class"))
    class_of = labels.join(smallest, "label").select(F.col("node").alias("labelled"), F.col("class").alias("label"))
    whole = sk.select("id", "a", "b").join(copies, ["a", "b"], "left")
    named_rows = whole.join(class_of, F.col("node") == F.col("labelled"), "left")
    return named_rows.select(
        F.col("id").alias(id_col),
        F.coalesce("label", "node", "id").alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("copy_of"),
    ).withColumn("class_id", F.when(F.col(id_col).isNotNull(), F.col("class_id")))


def _pairs(members: DataFrame) -> DataFrame:
    """Each member with the heads of its bucket, once, the larger id as ``u``."""
    ends = members.select("node", F.explode("heads").alias("head")).filter("head != node")
    return ends.select(F.greatest("head", "node").alias("u"), F.least("head", "node").alias("v")).distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their class, and the buckets of several: largest class, members, and members outside it.

    A bucket of two is left out: its pair was compared.
    """
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("labels"))
    mixed = mixed.filter("labels > 1 and all > 2").select("bucket", F.col("main.label").alias("main"), "all", (F.col("all") - F.col("main.n")).alias("minor"))
    return named, materialize(mixed, "near-mixed")


def _exact(rows: DataFrame, sets: DataFrame, least: float, of_classes: bool = False) -> DataFrame:
    """Links between members of different classes in mixed buckets; rows are bucket, node, label, main, all, minor.

    With ``of_classes`` pairs of classes are returned instead, and classes that a task has joined are one to it: as few
    pairs as show what belongs together.
    """
    blocks = {"minor": F.ceil(F.col("minor") / BLOCK).cast("int"), "all": F.ceil(F.col("all") / BLOCK).cast("int")}
    own = {k: F.pmod(F.xxhash64("node", F.lit(k)), n.cast("long")).cast("int") for k, n in blocks.items()}
    outside = F.col("label") != F.col("main")
    # side 0: members outside the main class, once for each block of all members; side 1: every member, once for each block of those
    zero = rows.filter(outside).select("bucket", own["minor"].alias("i"), F.explode(F.sequence(F.lit(0), blocks["all"] - 1)).alias("j"), F.lit(0).alias("side"), "node", "label")
    one = rows.select("bucket", F.explode(F.sequence(F.lit(0), blocks["minor"] - 1)).alias("i"), own["all"].alias("j"), F.lit(1).alias("side"), "node", "label")
    full = zero.union(one).join(sets.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("bucket", "i", "j", "side", "node", "label", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        side, node, label = (table.column(c).to_numpy() for c in ("side", "node", "label"))
        held = [np.frombuffer(s, "<u4") for s in table.column("shingles").to_pylist()]
        size = np.array([len(h) for h in held])
        own, u, v = label.copy(), [], []
        for x in np.nonzero(side == 0)[0]:
            fits = np.nonzero((side == 1) & (own != own[x]) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x])))[0]
            for y in fits:
                if own[y] != own[x] and similarity(held[x], held[y]) >= least:
                    u.append(label[x] if of_classes else node[x])
                    v.append(label[y] if of_classes else node[y])
                    if of_classes:
                        own[own == own[y]] = own[x]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each class of near copies.

    Every row is a member of its own, whatever its id: of two rows that share an id and hold different texts each stays
    or goes with its own class, and of repeated rows one stays. A row with null id stays only where no row of its class
    has an id. Rows without shingles (null, empty and blank texts) all stay. An empty table gives none.
    """
    (key,) = fresh(docs, "row_key")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows")
    found = classes(keyed, key, text_col).select(F.col(key).alias("k"), "class_id")
    named = found.join(keyed.select(F.col(key).alias("k"), F.col(id_col).alias("i")), "k")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "k")).alias("m")).select(F.col("m.k").alias("kept"))
    return keyed.join(first, F.col(key) == F.col("kept"), "left_semi").drop(key)
