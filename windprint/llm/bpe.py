"""Byte-level BPE of whole texts; long ones by overlapping chunks that are stitched where their boundaries agree."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a chunk, and how many it shares with the next.
CHUNK, OVERLAP = 16_384, 512
#: A match that ends this near to the end of its chunk may look different with more text behind it.
MARGIN = 3


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and where each one's begin (one end more than tokens)."""
    enc = encoding(path)
    tokens = [enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum([len(t) for t in tokens])]


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, start: int, whole: bool = False) -> list[int]:
    """Ends of the matches in a chunk that begins at ``start``: those that later text can't change and where a cut is safe.

    A cut is safe where the character before it isn't white space: only the look-ahead of the white-space rule
    could see across it. ``whole`` says that no text follows the chunk.
    """
    last = len(text) - (0 if whole else MARGIN)
    return [start + e for m in pattern().finditer(text) if (e := m.end()) <= last and not text[e - 1].isspace()]


def cuts(text: str, chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the text may be cut into pieces, from each chunk's start and its boundaries in its first and last overlap.

    The first chunk begins at a true boundary. A boundary of it that the next chunk has as well is true, and from
    there on all boundaries of the next chunk are true, and so on. Where two chunks don't agree anywhere, the true
    matches are followed from the last cut on until they meet a boundary of a later chunk.
    """
    out, true = [], set(chunks[0][2]) if chunks else set()
    k = 1
    while k < len(chunks):
        common = true.intersection(chunks[k][1])
        if common:
            out.append(min(common))
            true = {e for e in chunks[k][2] if e > out[-1]}
            k += 1
            continue
        known = {}
        for j in range(len(chunks) - 1, k - 1, -1):
            known.update({e: j for e in (*chunks[j][2], *chunks[j][1])})
        for m in pattern().finditer(text, out[-1] if out else 0):
            if (j := known.get(m.end())) is not None:
                out.append(m.end())
                true = {e for e in chunks[j][2] if e > out[-1]}
                k = j + 1
                break
        else:
            break
    return out


def _texts(column: pa.Array) -> list[str]:
    return [b"" if b is None else b for b in column.cast(pa.large_binary()).to_pylist()]


def _encoded(texts: list[bytes], path: str) -> pa.Array:
    enc = encoding(path)
    ids = [enc.encode_to_numpy(t.decode("utf-8", "replace"), disallowed_special=()).astype(np.int32) if t else np.zeros(0, np.int32) for t in texts]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(docs: DataFrame, text_col: str = "text", path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text (null: of an empty one), in place of nothing else.

    Texts of at most ``chunk`` characters are one chunk and are encoded where they are read. Each longer text, once
    however often it occurs, is cut to overlapping chunks, which are pre-tokenised in parallel; chunks are stitched
    where their boundaries agree, and the pieces between are encoded in parallel and put together. All rows and
    columns are kept; the new column gets underscores appended where its name is taken.
    """
    ids, key = fresh(docs, "ids", "text_key")
    length = F.coalesce(F.char_length(text_col), F.lit(0))

    def direct(batches):
        for batch in sliced(batches, text_col):
            yield batch.append_column(ids, _encoded(_texts(batch.column(batch.schema.get_field_index(text_col))), path))

    whole = docs.filter(length <= chunk).mapInArrow(direct, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))

    long = docs.filter(length > chunk).withColumn(key, F.md5(F.col(text_col).cast("binary")))
    # grouped by key where it is used: a written table would lose that partitioning and be shuffled again
    texts = long.groupBy(F.col(key).alias("key")).agg(F.first(text_col).alias("text"))

    def cut(batches):
        for batch in sliced(batches, "text"):
            for k, t in zip(batch.column("key").to_pylist(), _texts(batch.column("text"))):
                t = t.decode("utf-8", "replace")
                starts = list(range(0, len(t), chunk))
                yield pa.record_batch({"key": [k] * len(starts), "start": pa.array(starts, pa.int64()), "last": [s + chunk + overlap >= len(t) for s in starts], "part": [t[s : s + chunk + overlap] for s in starts]})

    def pretokenise(batches):
        for batch in sliced(batches, "part"):
            heads, tails = [], []
            for s, last, t in zip(batch.column("start").to_pylist(), batch.column("last").to_pylist(), batch.column("part").to_pylist()):
                ends = boundaries(t, s, last)
                heads.append([e for e in ends if e < s + overlap])
                tails.append([e for e in ends if e >= s + chunk])
            kind = pa.list_(pa.int64())
            yield pa.record_batch({"key": batch.column("key"), "start": batch.column("start"), "head": pa.array(heads, kind), "tail": pa.array(tails, kind)})

    parts = texts.mapInArrow(cut, "key string, start long, last boolean, part string").repartition(F.col("key"), F.col("start"))
    ends = parts.mapInArrow(pretokenise, "key string, start long, head array<long>, tail array<long>")
    # one row for each long text: its chunks' boundaries in the overlaps
    chunks = ends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "head", "tail"))).alias("chunks"))

    def stitch(batches):
        for batch in sliced(batches, "text"):
            for k, t, c in zip(batch.column("key").to_pylist(), _texts(batch.column("text")), batch.column("chunks").to_pylist()):
                t = t.decode("utf-8", "replace")
                at = [0, *cuts(t, [(x["start"], x["head"], x["tail"]) for x in c]), len(t)]
                yield pa.record_batch({"key": [k] * (len(at) - 1), "piece": pa.array(range(len(at) - 1), pa.int32()), "text": [t[a:b] for a, b in zip(at, at[1:])]})

    def encode_pieces(batches):
        for batch in sliced(batches, "text"):
            yield pa.record_batch({"key": batch.column("key"), "piece": batch.column("piece"), "ids": _encoded(_texts(batch.column("text")), path)})

    pieces = texts.join(chunks, "key").select("key", "text", "chunks").mapInArrow(stitch, "key string, piece int, text string").repartition(F.col("key"), F.col("piece"))
    done = pieces.mapInArrow(encode_pieces, "key string, piece int, ids array<int>").groupBy("key").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("text_ids"))
    stitched = long.join(done, F.col(key) == F.col("key")).select(*docs.columns, F.col("text_ids").alias(ids))
    return whole.unionByName(stitched)


def _decoded(ids: np.ndarray, path: str) -> bytes:
    data, start = token_bytes(path)
    size = start[ids + 1] - start[ids]
    return data[np.repeat(start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()


def _id_lists(batches, ids_col: str, limit: int = 1 << 16):
    """Parts of about ``limit`` ids, or one row, with the rows' ids; a null list has none."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids_col))
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())].astype(np.int64)
        ids, start = column.flatten().to_numpy(), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start), [ids[a:b] for a, b in zip(ends[start:end], ends[start + 1 : end + 1])]
            start = end


def decode(encoded: DataFrame, ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids one after another; a null list gives none."""
    (name,) = fresh(encoded, "decoded")

    def joined(batches):
        for part, lists in _id_lists(batches, ids_col):
            yield part.append_column(name, pa.array([_decoded(x, path) for x in lists], pa.binary()))

    return encoded.mapInArrow(joined, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(encoded: DataFrame, ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """``encoded`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: SHA-256 of the decimal ids joined by a space, and of the bytes that the ids decode to.

    Ids are decoded and hashed where they are read, so the bytes aren't handed on. A null list counts as an empty one.
    """
    names = fresh(encoded, "n_tokens", "ids_sha256", "decoded_sha256")

    def hashed(batches):
        for part, lists in _id_lists(batches, ids_col):
            part = part.append_column(names[0], pa.array([len(x) for x in lists], pa.int64()))
            part = part.append_column(names[1], pa.array([hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in lists], pa.string()))
            yield part.append_column(names[2], pa.array([hashlib.sha256(_decoded(x, path)).hexdigest() for x in lists], pa.string()))

    return encoded.mapInArrow(hashed, T.StructType([*encoded.schema.fields, *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.StringType(), T.StringType()))]]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``id, ids, decoded`` of every row: encoded, then decoded again."""
    return decode(encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", path).select("id", "ids"), "ids", path).withColumnRenamed("id", id_col)
