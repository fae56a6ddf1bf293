"""A corpus pipeline: quality filter, line dedup, near-dedup, mixing and encoding, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windprint.llm import bpe, dart_minhash, line_dedup, mixing, quality
from windprint.llm.common import fresh, materialize, reachable, table

#: The classifier is learnt, near copies are joined and texts are encoded in Python tasks: no SQL for the whole.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of the corpus, doesn't reject.

    A null or empty text has the score of the constant; repeated rows and ties are judged alike; an empty table gives none.
    """
    reachable(spark)
    (score,) = fresh(docs, "score")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line passages; documents of which nothing is left go.

    Null and empty texts stay as they are told by ``line_dedup.without_repeats``; the first of repeated rows keeps its lines.
    """
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id; of repeated rows one.

    Rows that share an id are judged each by its text; null, empty and blank texts are no copies of each other and stay.
    """
    reachable(spark)
    return dart_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic meet the targets."""
    return mixing.sample(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: ``doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256``.

    A null text is encoded as an empty one; every row gives a row, also where rows repeat.
    """
    reachable(spark)
    coded = bpe.digests(bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
