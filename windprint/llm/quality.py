"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced, text_of
from .words import mix, raw, words

#: Feature 0 is the constant; hashed unigrams and bigrams share the rest.
BITS = 18
#: At most so many labelled rows are learnt from, those of the smallest hashes of their id: the bound of the fit.
TRAINING_ROWS = 8_192
EPOCHS, ALPHA, BETA, L1, L2 = 6, 3.0, 1.0, 0.3, 0.01
THRESHOLD, FOLDS = 0.3, 5


def held_out(id_col: str) -> Column:
    """Whether a row belongs to the fold that is never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors of whole texts: row ends (n + 1), feature numbers and values (1 + log of the count, scaled)."""
    data, offsets = raw(column)
    word, text = words(data, offsets, split_marks=True)
    pair = mix(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
    # a word said twice is the same feature whichever word it is
    pair = np.where(word[:-1] == word[1:], np.uint64(1 << 63), pair)[text[:-1] == text[1:]] if len(word) else word
    row = np.concatenate([np.arange(len(column)), text, text[:-1][text[:-1] == text[1:]]]).astype(np.uint64)
    hashed = np.concatenate([word, pair]) >> np.uint64(64 - BITS)
    number = np.concatenate([np.zeros(len(column), np.uint64), np.maximum(hashed, np.uint64(1))])
    key, count = np.unique((row << np.uint64(BITS)) | number, return_counts=True)
    row, number = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int32)
    value = np.where(number > 0, 1 + np.log(count), 0.0)
    size = np.sqrt(np.bincount(row, value * value, minlength=len(column)))
    value = np.where(number > 0, value / np.where(size > 0, size, 1)[row], 1.0)
    return np.searchsorted(row, np.arange(len(column) + 1)), number, value


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal updates over (label, feature numbers, values), in order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(i):
        lead = np.where(np.abs(z[i]) > L1, np.sign(z[i]) * L1 - z[i], 0.0)
        return lead / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, i, x in rows:
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out fold.

    At most ``TRAINING_ROWS`` ids are used. An id labelled several times has its largest label; null ids and labels
    are left out. Texts become sparse vectors in parallel; one task then makes the updates in the order of hashed
    ids. Without any labelled row all weights are 0.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(TRAINING_ROWS)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("label_id"))

    def sparse(batches):
        for batch in sliced(batches, "text"):
            ends, number, value = features(batch.column("text"))
            number, value = number.astype("<i4"), value.astype("<f4")
            yield pa.record_batch({
                "place": batch.column("place"), "label": batch.column("label"),
                "number": pa.array([number[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                "value": pa.array([value[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
            })

    def learn(batches):
        got = [(y, np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4").astype(np.float64)) for b in batches
               for y, i, x in zip(*(b.column(c).to_pylist() for c in ("label", "number", "value")))]
        if got:
            yield pa.record_batch({"weights": pa.array([fit(got).tobytes()], pa.binary())})

    vectors = rows.select(F.xxhash64("id", "text").alias("place"), "label", "text").mapInArrow(sparse, "place long, label double, number binary, value binary")
    model = vectors.repartition(1).sortWithinPartitions("place", "label").mapInArrow(learn, "weights binary").first()
    return np.frombuffer(bytes(model["weights"]), "<f4") if model else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 by whole text, as a sparse dot product.

    A null or empty text has the score of the constant alone. All rows and columns stay; the new column gets
    underscores appended where its name is taken. The weights (1 MB, whatever the input) are broadcast.
    """
    (name,) = fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches):
        for batch in sliced(batches, text_col):
            ends, number, value = features(batch.column(batch.schema.get_field_index(text_col)))
            total = np.add.reduceat(shared.value[number] * value, ends[:-1])
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))))

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row, by a model learnt outside the held-out fold."""
    weights = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return score(rows, weights).select(id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
