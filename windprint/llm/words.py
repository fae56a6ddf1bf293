"""Vectorised word and shingle hashes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after another, and the n + 1 offsets; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, a function of their bytes alone."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, split_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, in order.

    A word is a run of bytes other than white space; with ``split_marks`` runs of letters or digits and runs of other
    marks are words of their own. Bytes beyond ASCII count as letters.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = (~_SPACE[data]).astype(np.int8)
    if split_marks:
        kind += _LETTER[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.nonzero(edge)[0]
    start, end = at[:-1], at[1:]
    some = kind[start] > 0
    start, end = start[some], end[some]
    return span_hash(prefix_hash(data), start, end), np.searchsorted(offsets, start, side="right") - 1


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``width`` words; a text of fewer words gives one shingle of all it has."""
    counts = np.bincount(text, minlength=n_texts)
    h = np.zeros(len(word), np.uint64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    for i in range(width):
        shifted = np.zeros(len(word), np.uint64)
        if i < len(word):
            shifted[: len(word) - i] = word[i:]
        h = np.where(left > i, mix(h * np.uint64(0xD6E8FEB86659FD93) + shifted), h)
    keep = (left >= width) | ((place == 0) & (left < width))
    return h[keep], text[keep]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ASCII letters, digits and bytes beyond ASCII, in order; case as it is."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _LETTER[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.nonzero(edge)[0]
    start, end = at[:-1], at[1:]
    some = kind[start]
    start, end = start[some], end[some]
    return span_hash(prefix_hash(data), start, end), np.searchsorted(offsets, start, side="right") - 1
