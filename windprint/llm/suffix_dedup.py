"""Removal of byte strings that repeat across documents, by two-stage suffix sorting of the places that may repeat."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windprint.sources.shared_table import shared_folder

from .common import materialize
from .words import powers, prefix_hash, raw

#: Length of a repeat in bytes; bytes of a gram; grams of a window; bytes that a gram is widened by, which every window has left or right of it.
LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Bytes of a block of documents, grams of a bucket, and documents of one block, or blocks, from which on a gram is hot.
BLOCK_BYTES, BUCKET_GRAMS, MANY_DOCS, MANY_BLOCKS = 1 << 22, 1 << 20, 64, 256
SORT_BYTES = 1 << 21


# ---- suffix sorting -------------------------------------------------------------------------------------------------


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    out = np.concatenate([data, np.zeros(63, np.uint8)]).astype(np.uint64)
    for i in (1, 2, 4):
        out = out[:-i] << np.uint64(8 * i) | out[i:]
    return out


def suffix_order(data: np.ndarray, word: np.ndarray, length: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``data``, or those ``wanted`` and some others, in the order of their first ``length`` bytes, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. The others are induced: buckets of equal first
    bytes are scanned in ascending order, and the predecessor of each suffix met, if it begins with a larger byte, is
    next in its own bucket; runs of one byte follow in rounds. A suffix is induced from its successors up to the next
    one sorted directly, so besides the wanted only these are needed.
    """
    n = len(data)
    # the next different byte decides; the end of the text is smaller than every byte
    changes = data[1:] != data[:-1]
    change = np.nonzero(changes)[0]
    following = np.cumsum(changes) - changes
    ends = np.append(change, n - 1)[np.append(following, len(change))[:n]]
    smaller = (ends < n - 1) & (data[np.minimum(ends + 1, n - 1)] > data)
    direct = np.nonzero(smaller)[0]
    needed = np.ones(n, bool)
    if wanted is not None:
        some = np.nonzero(wanted)[0]
        last = np.append(direct, n - 1)[np.searchsorted(direct, some)]
        needed = np.cumsum(np.bincount(some, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n] > 0
        direct = direct[needed[direct]]
    direct = direct[np.lexsort([word[direct + i] for i in range(8 * ((length - 1) // 8), -1, -8)])]
    at = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and needed[n - 1]:
        induced[data[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest of all
    out = []
    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        rounds = [part]
        while len(part):
            part = part[part > 0] - 1
            part = part[(data[part] == c) & needed[part]]
            rounds.append(part)
        bucket = np.concatenate([*rounds, direct[at[c] : at[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = data[before]
        larger = (byte > c) & needed[before]
        before, byte = before[larger], byte[larger]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for b, chunk in zip(*_runs(byte, before)):
            induced[b].append(chunk)
    return np.concatenate(out)


def _runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(key):
        return key, []
    start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    return key[start], np.split(value, start[1:])


def equal_windows(data: np.ndarray, inside: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Window starts where ``inside`` holds, in suffix order, and the number of the class of equal windows of each.

    Neighbours in suffix order whose common prefix reaches ``length`` are of one class.
    """
    word = eight(data)
    order = suffix_order(data, word, length, inside)
    order = order[inside[order]]
    same = np.ones(max(len(order) - 1, 0), bool)
    for i in (*range(0, length - 8, 8), length - 8):
        same &= word[order[1:] + i] == word[order[:-1] + i]
    return order, np.concatenate([[0], np.cumsum(~same)]) if len(order) else order


# ---- grams that windows of equal content share -----------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with the same wide gram: first and last window start, the wide gram's place and 64-bit hash.

    The smallest gram of a window follows from its bytes alone (smallest 32-bit hash, the leftmost of equals). So does
    the wide gram: the smallest with the ``SIDE`` bytes before it where the window has them, else with those after it.
    Equal windows thus have equal wide grams at equal places, while chance, which gives more and more texts the same
    short gram the more texts there are, hardly ever gives them the same wide one. Windows don't cross documents.
    """
    found = []
    step = np.searchsorted(offsets, np.arange(0, offsets[-1] + 1, 1 << 19), side="left")
    for a, b in zip(step, np.append(step[1:], len(offsets) - 1)):
        if b > a and offsets[b] - offsets[a] >= LENGTH:
            found.append(_anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], offsets[a]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))


def _anchors(data, offsets, base):
    prefix = prefix_hash(data)
    h = _scrambled((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix))[1][: len(prefix) - GRAM])
    key = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= GRAMS:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < GRAMS:
        key = np.minimum(key[: size - GRAMS], key[GRAMS - size :])
    starts = np.ones(len(key), bool)
    for i in range(1, LENGTH):
        at = offsets[1:-1] - i
        starts[at[at >= 0]] = False
    window = np.nonzero(starts)[0]
    place = (key[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place -= np.where(place - window >= SIDE, SIDE, 0)
    new = np.nonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])[0]
    last = np.append(new[1:], len(window)) - 1
    place = place[new]
    return window[new] + base, window[last] + base, place + base, _scrambled((prefix[place + GRAM + SIDE] - prefix[place]) * powers(len(prefix))[1][place])


def _scrambled(h):
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Block:
    """A block of documents: bytes one after another in the order of ids, and the anchors."""

    def __init__(self, table: pa.Table, anchored: bool = True):
        self.table = table.sort_by([("doc", "ascending"), ("md5", "ascending")])
        column = self.table.column("text")
        self.data, self.offsets = raw(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string()))
        self.docs = self.table.column("doc").to_numpy()
        if anchored:
            self.first, self.last, self.place, self.gram = anchors(self.data, self.offsets)
            self.owner = self.docs[np.searchsorted(self.offsets, self.place, side="right") - 1]
            # distinct grams in order, an anchor's number in that order, and how many documents have each; owners ascend
            order = np.argsort(self.gram, kind="stable")
            gram, owner = self.gram[order], self.owner[order]
            new = np.ones(len(order), bool)
            new[1:] = gram[1:] != gram[:-1]
            self.grams, self.which = gram[new], np.empty(len(order), np.int64)
            self.which[order] = number = np.cumsum(new) - 1
            new[1:] |= owner[1:] != owner[:-1]
            self.n_docs = np.bincount(number[new], minlength=len(self.grams))


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _unpacked(b: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = len(b) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(b, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _by_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the ordered grams begins, and the end."""
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else np.uint64(63)
    limits = (np.arange(buckets + 1, dtype=object) << int(shift)) if buckets > 1 else [0, 1 << 64]
    return np.array([np.searchsorted(grams, np.uint64(x)) if x < 1 << 64 else len(grams) for x in limits])


def _gram_rows(buckets: int, many_docs: int):
    """For each bucket the distinct grams of a block (their lower half is enough inside a bucket) and how many documents have each."""

    def rows(key, table):
        b = Block(table)
        level = ((b.n_docs > 1).astype(np.uint8) + (b.n_docs > many_docs)).astype(np.uint8)
        at = _by_bucket(b.grams, buckets)
        some = [i for i in range(buckets) if at[i] < at[i + 1]]
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "block": pa.array([key[0].as_py()] * len(some), pa.int32()),
            "packed": pa.array([_packed((b.grams[at[i] : at[i + 1]] & np.uint64(0xFFFFFFFF)).astype("<u4"), level[at[i] : at[i + 1]]) for i in some], pa.binary()),
        })

    return rows


def _shared_rows(key, table):
    """Which grams of each block are shared (1) or hot (2): in several documents, or in very many."""
    got = [_unpacked(p, "<u4", "u1") for p in table.column("packed").to_pylist()]
    gram, level = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    _, which, blocks = np.unique(gram, return_inverse=True, return_counts=True)
    most = np.zeros(len(blocks), np.uint8)
    np.maximum.at(most, which, level)
    state = np.where((most > 1) | (blocks > MANY_BLOCKS), 2, np.where((most > 0) | (blocks > 1), 1, 0)).astype(np.uint8)[which]
    ends = np.cumsum([len(g[0]) for g in got])[:-1]
    return pa.table({
        "bucket": pa.array([key[0].as_py()] * len(got), pa.int32()), "block": table.column("block"),
        "state": pa.array([np.packbits(np.stack([s & 1, s >> 1]).ravel()).tobytes() for s in np.split(state, ends)], pa.binary()),
    }).cast(pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("state", pa.binary())]))


def _states(b: Block, table: pa.Table, buckets: int) -> np.ndarray:
    """The state of each distinct gram of a block from the answers of all buckets."""
    at, state = _by_bucket(b.grams, buckets), np.zeros(len(b.grams), np.uint8)
    for i, bits in zip(table.column("bucket").to_pylist(), table.column("state").to_pylist()):
        n = at[i + 1] - at[i]
        both = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n)
        state[at[i] : at[i + 1]] = both[:n] + 2 * both[n:]
    return state


# ---- places that may repeat ---------------------------------------------------------------------------------------------


def _context_rows(buckets: int):
    """From each block: contexts (the bytes of all windows of an anchor) for the buckets of grams, and what is settled at once.

    Rows of kind 0 hold contexts of shared grams and go to the bucket of the gram. Those of kind 1 hold single windows
    of hot grams, by 128 bits of hash, and go to the bucket of the window: the block's equal windows, found by sorting
    suffixes, are one entry. Equal contexts of a block are one entry too, that of the smallest id; the others are
    covered by it, which rows of kind 2 say. Packed: place in the block, id, then length and bytes, or hash.
    """

    def rows(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, out = key[0].as_py(), []
        if not table.num_rows or not answers.num_rows:
            return _empty()
        b = Block(table)
        state = _states(b, answers, buckets)[b.which]
        size = b.last - b.first + LENGTH
        settled: list[np.ndarray] = []

        def whole(i: np.ndarray):
            settled.append(np.stack([b.first[i], b.last[i]]))

        # every context by a hash of its bytes and the gram's place in it
        prefix = prefix_hash(b.data)
        inverse = powers(len(prefix))[1]
        for kind in (1, 2):
            some = np.nonzero(state == kind)[0]
            if not len(some):
                continue
            first, end = b.first[some], b.first[some] + size[some]
            hashed = (prefix[end] - prefix[first]) * inverse[first]
            # one key sorts all four; where two contexts have the same by chance, they at most stay two entries
            order = np.argsort((b.gram[some] ^ hashed) * np.uint64(0x9E3779B97F4A7C15) + (size[some] * LENGTH + b.place[some] - first).astype(np.uint64), kind="stable")
            same = np.ones(len(order), bool)
            for x in (b.gram[some], hashed, size[some], b.place[some] - first):
                same[1:] &= x[order[1:]] == x[order[:-1]]
            same[0] = False
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            later = same & (b.owner[some][order] > b.owner[some][order[head]])
            whole(some[order[later]])
            kept = some[order[~later]]
            if kind == 2:
                out += _window_rows(b, kept, buckets)
                continue
            kept = kept[np.argsort(b.gram[kept], kind="stable")]
            at = _by_bucket(b.gram[kept], buckets)
            for i in range(buckets):
                k = kept[at[i] : at[i + 1]]
                if len(k):
                    idx = np.repeat(b.first[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(size[k].sum())
                    out.append((0, i, _packed(b.first[k].astype("<i4"), b.owner[k].astype("<i8"), b.gram[k].astype("<u8"), size[k].astype("u1")), b.data[idx].tobytes()))
        if settled:
            first, last = np.concatenate(settled, axis=1)
            out.append((2, block % buckets, _packed(first.astype("<i4"), (last - first + 1).astype("u1")), b""))
        return pa.table({
            "kind": pa.array([o[0] for o in out], pa.int32()), "bucket": pa.array([o[1] for o in out], pa.int32()),
            "block": pa.array([block] * len(out), pa.int32()), "packed": pa.array([o[2] for o in out], pa.binary()), "bytes": pa.array([o[3] for o in out], pa.binary()),
        })

    return rows


def _empty() -> pa.Table:
    return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "packed": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})


def _window_rows(b: Block, kept: np.ndarray, buckets: int) -> list:
    size, out = b.last[kept] - b.first[kept] + LENGTH, []
    cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), SORT_BYTES))
    for s, e in zip(cut, np.append(cut[1:], len(kept))):
        k, n = kept[s:e], size[s:e]
        if not len(k):
            continue
        idx = np.repeat(b.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        left = np.repeat(np.cumsum(n), n) - np.arange(n.sum())
        order, group = equal_windows(b.data[idx], left >= LENGTH)
        start, owner = idx[order], np.repeat(b.owner[k], n)[order]
        best = np.lexsort((start, owner, group))
        first = np.r_[True, group[best][1:] != group[best][:-1]]
        least = owner[best][np.maximum.accumulate(np.where(first, np.arange(len(best)), 0))]
        # the block's other equal windows of larger ids are covered, those of the same id share its fate: all are sent
        keep = first | (owner[best] == least)
        gone = best[~keep]
        if len(gone):
            out.append((2, int(start[gone[0]]) % buckets, _packed(start[gone].astype("<i4"), np.ones(len(gone), "u1")), b""))
        best = best[keep]
        pre = prefix_hash(b.data[idx])
        inv = powers(len(pre))[1]
        hashes = [(pre[order[best] + LENGTH] - pre[order[best]]) * inv[order[best]]]
        odd = prefix_hash(b.data[idx] ^ np.uint8(0xA5))
        hashes.append((odd[order[best] + LENGTH] - odd[order[best]]) * inv[order[best]] * np.uint64(0xD6E8FEB86659FD93))
        top = hashes[0] * np.uint64(0x9E3779B97F4A7C15)
        by = np.argsort(top, kind="stable")
        at = _by_bucket(top[by], buckets)
        for i in range(buckets):
            j = by[at[i] : at[i + 1]]
            if len(j):
                out.append((1, i, _packed(start[best[j]].astype("<i4"), owner[best[j]].astype("<i8"), hashes[0][j].astype("<u8"), hashes[1][j].astype("<u8")), b""))
    return out


def _cover_rows(key, table):
    """For each block the windows (place, number of windows) that a smaller id has too."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kind = np.array(table.column("kind").to_pylist())
    block, packed, data = (table.column(c).to_pylist() for c in ("block", "packed", "bytes"))
    for r in np.nonzero(kind == 2)[0]:
        place, count = _unpacked(packed[r], "<i4", "u1")
        out.append((np.full(len(place), block[r]), place, count))
    rows = np.nonzero(kind == 1)[0]
    if len(rows):
        got = [_unpacked(packed[r], "<i4", "<i8", "<u8", "<u8") for r in rows]
        place, owner, x, y = (np.concatenate([g[i] for g in got]) for i in range(4))
        home = np.repeat([block[r] for r in rows], [len(g[0]) for g in got])
        order = np.lexsort((owner, y, x))
        new = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]
        least = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        gone = order[owner[order] > least]
        out.append((home[gone], place[gone], np.ones(len(gone), np.uint8)))
    rows = np.nonzero(kind == 0)[0]
    if len(rows):
        got = [_unpacked(packed[r], "<i4", "<i8", "<u8", "u1") for r in rows]
        place, owner, gram, size = (np.concatenate([g[i] for g in got]) for i in range(4))
        home = np.repeat([block[r] for r in rows], [len(g[0]) for g in got])
        text = np.frombuffer(b"".join(data[r] for r in rows), np.uint8)
        out += _contexts(place, owner, gram, size.astype(np.int64), home, text)
    if not out:
        return pa.table({"block": pa.array([], pa.int32()), "covered": pa.array([], pa.binary())})
    home, place, count = (np.concatenate([o[i] for o in out]) for i in range(3))
    order = np.argsort(home, kind="stable")
    home, place, count = home[order], place[order], count[order]
    start = np.nonzero(np.r_[True, home[1:] != home[:-1]])[0] if len(home) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(home))
    return pa.table({
        "block": pa.array(home[start].astype(np.int32), pa.int32()),
        "covered": pa.array([_packed(place[a:b].astype("<i4"), count[a:b].astype("u1")) for a, b in zip(start, ends)], pa.binary()),
    })


def _contexts(place, owner, gram, size, home, text):
    """Covered windows of contexts: equal contexts are one, the rest of a gram's contexts are sorted by suffixes."""
    starts = np.cumsum(size) - size
    prefix = prefix_hash(text)
    hashed = (prefix[starts + size] - prefix[starts]) * powers(len(prefix))[1][starts]
    order = np.lexsort((owner, size, hashed, gram))
    g, h, s, o = gram[order], hashed[order], size[order], owner[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    gone = o > o[head]
    covered = [(home[order[gone]], place[order[gone]], (size[order[gone]] - LENGTH + 1).astype(np.uint8))]
    kept = order[~gone]  # contexts of the smallest id among equals
    # a gram with one context of one id has nothing more to compare
    g, distinct = gram[kept], new[~gone] | np.r_[True, owner[kept][1:] != owner[kept][:-1]]
    _, which = np.unique(g, return_inverse=True)
    kept = kept[np.bincount(which, distinct)[which] > 1]
    total = np.cumsum(size[kept])
    limit = 0
    a = 0
    while a < len(kept):
        # a piece ends between two grams
        limit = (total[a - 1] if a else 0) + SORT_BYTES
        b = max(int(np.searchsorted(total, limit)), a + 1)
        while b < len(kept) and gram[kept[b]] == gram[kept[b - 1]]:
            b += 1
        k, n = kept[a:b], size[kept[a:b]]
        idx = np.repeat(starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        left = np.repeat(np.cumsum(n), n) - np.arange(n.sum())
        at, group = equal_windows(text[idx], left >= LENGTH)
        context = np.repeat(np.arange(len(k)), n)[at]
        own = owner[k][context]
        least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, own)
        hit = own > least[group]
        where = place[k][context] + (at - (np.cumsum(n) - n)[context])
        covered.append((home[k][context[hit]], where[hit], np.ones(int(hit.sum()), np.uint8)))
        a = b
    return covered


# ---- removal ---------------------------------------------------------------------------------------------------------------


def _removed(key, table: pa.Table, covers: pa.Table) -> pa.Table:
    b = Block(table, anchored=False)
    edge = np.zeros(len(b.data) + 1, np.int32)
    for packed in covers.column("covered").to_pylist() if covers.num_rows else []:
        place, count = _unpacked(packed, "<i4", "u1")
        np.add.at(edge, place, 1)
        np.add.at(edge, place.astype(np.int64) + count + (LENGTH - 1), -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept, n_removed, n_spans = [], [], []
    for s, e in zip(b.offsets, b.offsets[1:]):
        g = gone[s:e]
        n_removed.append(int(g.sum()))
        n_spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        kept.append(b.data[s:e][~g].tobytes())
    return pa.table({"md5": b.table.column("md5"), "doc": b.table.column("doc"), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def _blocked(spark: SparkSession, docs: DataFrame, firsts: DataFrame, blocks: int) -> DataFrame:
    """The first documents of each text, in a table bucketed by block: later passes meet it without moving it."""
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block")

    def first(key, table: pa.Table, keep: pa.Table) -> pa.Table:
        wanted = set(zip(keep.column("first_doc").to_pylist(), keep.column("first_md5").to_pylist()))
        mask, seen = [], set()
        for pair in zip(table.column("doc").to_pylist(), table.column("md5").to_pylist()):
            mask.append(pair in wanted and pair not in seen)
            seen.add(pair)
        return table.filter(pa.array(mask, pa.bool_()))

    rows = docs.filter(F.col("doc").isNotNull()).select(block, "doc", F.md5(F.col("text").cast("binary")).alias("md5"), F.col("text").cast("binary").alias("text"))
    keep = firsts.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("first_block"), F.col("doc").alias("first_doc"), F.col("md5").alias("first_md5"))
    kept = rows.groupBy("block").cogroup(keep.groupBy("first_block")).applyInArrow(first, "block int, doc long, md5 string, text binary")
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    kept.write.option("path", shared_folder(spark, "suffix-blocks")).option("compression", "zstd").bucketBy(blocks, "block").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many_docs: int = MANY_DOCS) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` of every row: its text without what smaller ids have too.

    Each byte covered by a 50-byte string that also starts in a document of a smaller id is removed. Strings are
    judged on the input and never cross documents. How it works, at any size:

    1. Rows of equal texts collapse to the smallest id. The first documents go to blocks of bounded size, by hash.
    2. Each 50-byte window has a smallest 16-byte gram, a function of its bytes, which the window's longer side widens
       to 33. Wide grams that only one document has are settled by comparing the blocks' distinct ones, in buckets of
       bounded size.
    3. For the others, the bytes around each gram (its context) go to the gram's bucket. Equal contexts collapse;
       the different contexts of a gram are concatenated, their suffixes are put in order by two-stage sorting, and
       neighbours with a common prefix of 50 bytes form classes; members above the smallest id of a class are covered.
       Grams of very many documents are split: blocks sort the suffixes around them and send single windows, by hash.
    4. The answers return to the blocks, where covered bytes are merged and cut.

    Nulls: a null text counts as empty; a null id is in no order, so nothing is removed from such a row, nor because
    of it. Texts under 50 bytes stay. Rows of equal id don't cover each other. ``kept`` is binary, as a cut may fall
    inside a character. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = materialize(rows.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("md5"), F.when((F.octet_length("text") < LENGTH) | F.col("doc").isNull(), F.col("text").cast("binary")).alias("as_is")), "suffix-rows")
    firsts = materialize(short.filter(F.col("as_is").isNull()).groupBy("md5").agg(F.min("doc").alias("doc"), F.first("n_bytes").alias("n")), "suffix-firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    blocks = max(-(-total // BLOCK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << max(0, (total // (GRAMS // 4) // BUCKET_GRAMS).bit_length())
    buckets = max(buckets, 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    table = _blocked(spark, rows, firsts, blocks)

    grams = table.groupBy("block").applyInArrow(_gram_rows(buckets, many_docs), "bucket int, block int, packed binary")
    states = materialize(grams.groupBy("bucket").applyInArrow(_shared_rows, "bucket int, block int, state binary"), "suffix-states").withColumnRenamed("block", "to_block")
    contexts = table.groupBy("block").cogroup(states.groupBy("to_block")).applyInArrow(_context_rows(buckets), "kind int, bucket int, block int, packed binary, bytes binary")
    covers = materialize(contexts.groupBy("bucket").applyInArrow(_cover_rows, "block int, covered binary"), "suffix-covers").withColumnRenamed("block", "to_block")
    done = table.groupBy("block").cogroup(covers.groupBy("to_block")).applyInArrow(_removed, "md5 string, doc long, n_removed long, n_spans long, kept binary")
    same = done.select(F.col("md5").alias("first_md5"), F.col("doc").alias("first_doc"), "n_removed", "n_spans", "kept")
    joined = short.join(same, F.col("as_is").isNull() & (F.col("md5") == F.col("first_md5")), "left")
    copy = F.col("as_is").isNull() & (F.col("doc") > F.col("first_doc"))
    return joined.select(
        F.col("doc").alias(id_col), "n_bytes",
        F.when(F.col("as_is").isNotNull(), F.lit(0)).when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(F.col("as_is").isNotNull(), F.lit(0)).when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("as_is").isNotNull(), F.col("as_is")).when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
