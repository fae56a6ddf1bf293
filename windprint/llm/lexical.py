"""Ranked lexical search by posting lists in blocks of similar documents with coordinatewise-maximum summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sliced
from .words import LOWER, mix, raw, terms

#: Different (item, term) pairs that are asked in one pass, about: what a task holds of the items.
ASKED = 500_000
#: Documents whose lists a task holds at once, and documents of a block.
SHARD, BLOCK = 8_192, 64
#: Documents that each item's first threshold is taken from, at least, where as many hold one of its terms.
ANCHORS = 400
SIGNATURE_BITS = 24


@dataclass(frozen=True)
class Asked:
    """Items as rows of a sparse matrix over their own vocabulary: sorted term hashes, and each item's terms and times."""

    ids: pa.Array
    vocabulary: np.ndarray
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[item], self.start[item + 1])
        return self.term[part], self.times[part]


def _counted(rows: DataFrame) -> DataFrame:
    """``id, term, times``: how often each item has each term; rows that share an id are one item."""

    def split(batches):
        for batch in sliced(batches, "text", 1 << 18):
            data, offsets = raw(batch.column("text"))
            h, text = terms(LOWER[data], offsets)
            yield pa.record_batch({"id": batch.column("id").take(pa.array(text)), "term": pa.array(h.view(np.int64))})

    return rows.mapInArrow(split, "id long, term long").groupBy("id", "term").agg(F.count(F.lit(1)).alias("times"))


def _asked(counted: DataFrame) -> Asked:
    """The items of one pass, on the driver: about ``ASKED`` pairs."""
    table = counted.toArrow().sort_by([("id", "ascending"), ("term", "ascending")])
    ids = table.column("id").combine_chunks()
    hashes = table.column("term").to_numpy().view(np.uint64)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    own = pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    new = np.r_[True, (own[1:] != own[:-1]) | (null[1:] != null[:-1])] if len(own) else np.zeros(0, bool)
    start = np.r_[np.nonzero(new)[0], len(own)]
    return Asked(ids.take(pa.array(start[:-1])), vocabulary, start, term, table.column("times").to_numpy())


def vectors(docs: DataFrame, asked: Asked, id_col: str, text_col: str) -> DataFrame:
    """``key, id, n, terms, counts`` of every row: its terms with repeats, and its counts of the asked terms, by number."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(asked.vocabulary)

    def count(batches):
        known = vocabulary.value
        for batch in sliced(batches, "text", 1 << 18):
            data, offsets = raw(batch.column("text"))
            h, text = terms(LOWER[data], offsets)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            some = known[at] == h
            pair, times = np.unique(text[some] * len(known) + at[some], return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(pair // len(known), minlength=batch.num_rows))].astype(np.int32)
            yield pa.record_batch({
                "key": batch.column("key"), "id": batch.column("id"), "n": pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int64)),
                "terms": pa.ListArray.from_arrays(pa.array(ends), pa.array((pair % len(known)).astype(np.int32))),
                "counts": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
            })

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "key long, id long, n long, terms array<int>, counts array<long>")


def impacts(found: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``key, id, terms, impacts, signature`` of the documents that hold an asked term.

    An impact is what one occurrence of the term in an item adds to the score, in integers. The signature is a
    similarity hash of the document's impacts: documents near to each other in angle share its leading bits often.
    """
    weights = found.sparkSession.sparkContext.broadcast(weight)

    def weigh(batches):
        w = weights.value
        sign = 1.0 - 2.0 * ((mix(np.arange(1, len(w) + 1, dtype=np.uint64))[:, None] >> np.arange(SIGNATURE_BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        for whole in batches:
            for batch in (whole.slice(i, 2_048) for i in range(0, whole.num_rows, 2_048)):
                ends, term, tf = _lists(batch, "terms", "counts")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                m = 25 + 75 * batch.column("n").to_numpy() * n_docs // max(n_terms, 1)
                impact = w[term] * (1_000_000_000 * tf // (1_000 * tf + 8 * m[owner]))
                signature = np.zeros(batch.num_rows, np.int64)
                for bit in range(SIGNATURE_BITS):
                    side = np.bincount(owner, impact * sign[term, bit], batch.num_rows) > 0
                    signature = signature * 2 + side
                yield pa.record_batch({
                    "key": batch.column("key"), "id": batch.column("id"), "terms": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(term)),
                    "impacts": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(impact)), "signature": pa.array(signature),
                })

    return found.filter(F.size("terms") > 0).mapInArrow(weigh, "key long, id long, terms array<int>, impacts array<long>, signature long")


def _lists(batch: pa.RecordBatch | pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """Ends of the rows' lists from 0 on, and the values of list columns of equal lengths."""
    columns = [batch.column(n) for n in names]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    ends = np.r_[0, np.cumsum(columns[0].value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return ends, *[c.flatten().to_numpy(zero_copy_only=False) for c in columns]


class Shard:
    """Some documents' vectors by document and by term."""

    def __init__(self, table: pa.Table, n_terms: int):
        self.table = table
        self.ends, self.term, self.impact = _lists(table, "terms", "impacts")
        self.owner = np.repeat(np.arange(table.num_rows), np.diff(self.ends))
        order = np.lexsort((self.owner, self.term))
        self.listed, self.heaviest = self.owner[order], np.zeros(n_terms, np.int64)
        self.list_start = np.searchsorted(self.term[order], np.arange(n_terms + 1))
        np.maximum.at(self.heaviest, self.term, self.impact)
        self.dense = np.zeros(n_terms, np.int64)
        # nulls come last among equal scores
        self.rank_id = pa.compute.fill_null(table.column("id"), np.iinfo(np.int64).max).to_numpy()
        self.key = table.column("key").to_numpy()

    def posting(self, term: int) -> np.ndarray:
        return self.listed[self.list_start[term] : self.list_start[term + 1]]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the documents, one document after another, and where each one's begin."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        begin = np.cumsum(sizes) - sizes
        return np.repeat(self.ends[docs] - begin, sizes) + np.arange(sizes.sum()), begin

    def scores(self, docs: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of documents, each with at least one entry."""
        if not len(docs):
            return np.zeros(0, np.int64)
        self.dense[term] = times
        at, begin = self.entries(docs)
        out = np.add.reduceat(self.impact[at] * self.dense[self.term[at]], begin)
        self.dense[term] = 0
        return out

    def blocks(self, term: int) -> list[np.ndarray]:
        """The term's posting list cut to blocks of documents near to each other.

        Leaders, evenly spread over the list in the order of signatures, gather the documents whose impacts have the
        largest inner product with theirs; what a leader has gathered makes blocks of at most ``BLOCK``.
        """
        docs = self.posting(term)
        if len(docs) <= BLOCK:
            return [docs]
        leaders = docs[:: BLOCK // 2]
        best, own = np.full(len(docs), -1.0), np.zeros(len(docs), np.int64)
        at, begin = self.entries(docs)
        impact, place = self.impact[at].astype(np.float64), self.term[at]
        dense = np.zeros(len(self.dense))
        for i, leader in enumerate(leaders):
            mine = slice(self.ends[leader], self.ends[leader + 1])
            length = np.sqrt((self.impact[mine].astype(np.float64) ** 2).sum()) or 1.0
            dense[self.term[mine]] = self.impact[mine] / length
            near = np.add.reduceat(impact * dense[place], begin)
            dense[self.term[mine]] = 0
            own[near > best], best = i, np.maximum(near, best)
        order = np.argsort(own, kind="stable")
        groups = np.split(docs[order], np.nonzero(np.diff(own[order]))[0] + 1)
        return [g[i : i + BLOCK] for g in groups for i in range(0, len(g), BLOCK)]

    def summary(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coordinatewise maximum of the documents' vectors, as terms and impacts."""
        at, _ = self.entries(docs)
        order = np.argsort(self.term[at], kind="stable")
        at = at[order]
        first = np.nonzero(np.r_[True, np.diff(self.term[at]) != 0])[0]
        return self.term[at[first]], np.maximum.reduceat(self.impact[at], first)


def _needed(shard: Shard, asked: Asked, floor: np.ndarray) -> dict[int, list[int]]:
    """For each term the items that need its list here: terms beyond those which together can't reach the item's floor.

    Terms are added up from the least possible contribution on; a document that holds only terms left out stays below.
    """
    out: dict[int, list[int]] = {}
    for item in range(len(asked.ids)):
        term, times = asked.of(item)
        most = shard.heaviest[term] * times
        order = np.argsort(most, kind="stable")
        for t in term[order][np.cumsum(most[order]) >= max(floor[item], 1)]:
            if shard.heaviest[t]:
                out.setdefault(int(t), []).append(item)
    return out


def _found(shard: Shard, asked: Asked, pairs: dict[int, list[np.ndarray]], floor: np.ndarray, k: int) -> pa.RecordBatch:
    """The exact scores of (item: documents), of each item the ``k`` highest that reach its floor."""
    items, rows, scores = [], [], []
    for item, parts in pairs.items():
        docs = np.unique(np.concatenate(parts))
        score = shard.scores(docs, *asked.of(item))
        some = score >= max(floor[item], 1)
        docs, score = docs[some], score[some]
        best = np.lexsort((shard.key[docs], shard.rank_id[docs], -score))[:k]
        items.append(np.full(len(best), item))
        rows.append(docs[best])
        scores.append(score[best])
    item, row, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (items, rows, scores))
    return pa.record_batch({"item": pa.array(item), "item_id": asked.ids.take(pa.array(item)), "key": pa.array(shard.key[row]), "id": shard.table.column("id").combine_chunks().take(pa.array(row)), "score": pa.array(score)})


def _shards(batches, n_terms: int):
    """The rows of a task, ``SHARD`` at a time."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == SHARD:
                yield Shard(pa.Table.from_batches(held), n_terms)
                held, rows = [], 0
    if rows:
        yield Shard(pa.Table.from_batches(held), n_terms)


_HITS = "item long, item_id long, key long, id long, score long"


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def thresholds(index: DataFrame, asked: Asked, frequency: np.ndarray, k: int) -> np.ndarray:
    """For each item a score that its ``k``-th best document reaches: the k-th best of those with one of its rarest terms; 0 with fewer.

    The rarest terms are taken until ``ANCHORS`` documents hold one (or all terms are).
    """
    anchors: dict[int, list[int]] = {}
    for item in range(len(asked.ids)):
        term, _ = asked.of(item)
        term = term[frequency[term] > 0]
        term = term[np.argsort(frequency[term], kind="stable")]
        before = np.cumsum(frequency[term]) - frequency[term]
        for t in term[before < ANCHORS]:
            anchors.setdefault(int(t), []).append(item)
    shared = index.sparkSession.sparkContext.broadcast((asked, anchors))

    def try_anchors(batches):
        asked, anchors = shared.value
        for shard in _shards(batches, len(asked.vocabulary)):
            pairs: dict[int, list[np.ndarray]] = {}
            for t, items in anchors.items():
                if len(docs := shard.posting(t)):
                    for item in items:
                        pairs.setdefault(item, []).append(docs)
            yield _found(shard, asked, pairs, np.zeros(len(asked.ids), np.int64), k)

    floor = np.zeros(len(asked.ids), np.int64)
    for r in _best(index.mapInArrow(try_anchors, _HITS), k).filter(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    return floor


def _pass(docs: DataFrame, counted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The answers for the items of one pass."""
    asked = _asked(counted)
    found = materialize(vectors(docs, asked, id_col, text_col), "lexical-vectors")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(asked.vocabulary), np.int64)
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    frequency[held.column("term").to_numpy()] = held.column("n").to_numpy()
    weight = np.floor(1_000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype(np.int64)
    weighed = materialize(impacts(found, weight, n_docs, n_terms), "lexical-impacts")
    # documents near to each other lie side by side; the key parts groups of copies
    index = materialize(weighed.repartitionByRange("signature", "key").sortWithinPartitions("signature", "key"), "lexical-index")
    floor = thresholds(index, asked, frequency, k)
    shared = docs.sparkSession.sparkContext.broadcast((asked, floor))

    def search_lists(batches):
        asked, floor = shared.value
        for shard in _shards(batches, len(asked.vocabulary)):
            pairs: dict[int, list[np.ndarray]] = {}
            for t, items in _needed(shard, asked, floor).items():
                for block in shard.blocks(t):
                    term, most = shard.summary(block)
                    shard.dense[term] = most
                    for item in items:
                        own, times = asked.of(item)
                        if (shard.dense[own] * times).sum() >= max(floor[item], 1):
                            pairs.setdefault(item, []).append(block)
                    shard.dense[term] = 0
            yield _found(shard, asked, pairs, floor, k)

    return _best(index.mapInArrow(search_lists, _HITS), k).select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", asked_at_once: int = ASKED) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: ``item_id, rank, doc_id, score`` (named as the id columns).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered, of the whole text. N counts
    the documents with a term, L all terms, n one document's; df the documents that hold a term, tf its occurrences in
    one. Of each occurrence of a term in the item a document gets w * ((10**9 tf) div (1000 tf + 8 m)), with w =
    floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; all but w in whole numbers.

    Documents are reduced to their counts of asked terms, sorted by a similarity hash of their impacts and held in
    shards of ``SHARD``. There each list of a term is cut to blocks around leaders, whose summary has the largest
    impact of any member in each coordinate. The product of summary and item is an exact upper bound for all members: a block
    is skipped only where it lies below the item's floor, a score that ``k`` documents are known to reach. A list isn't
    opened for an item where its terms of at most that contribution together can't reach the floor. All other
    documents are scored exactly. Terms are told apart by 64-bit hashes. Items are asked in passes of about
    ``asked_at_once`` (item, term) pairs, which is what the driver and a task hold of them.

    Nulls: a null text has no terms. A null id (document or item) is an id like any other; null document ids come last
    among equal scores. Rows of ``items`` that share an id are one item, its terms add up. Each row of ``docs`` is a
    document of its own, also when rows repeat. Items without terms, or whose terms no document holds, and empty
    tables give no rows. Other columns are ignored.
    """
    counted = materialize(_counted(items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))), "lexical-asked")
    part = F.pmod(F.xxhash64("id"), F.lit(-(-counted.count() // asked_at_once) or 1)).alias("part")
    parts = [r["part"] for r in counted.select(part).distinct().collect()]
    done = [docs.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")]
    done += [_pass(docs, counted.filter(part == i), k, id_col, text_col) for i in parts]
    return reduce(DataFrame.unionByName, done).toDF(item_col, "rank", id_col, "score")
