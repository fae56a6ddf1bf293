"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from windprint.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns and 0 < docs.count() and (name == "mixing" or docs.count() <= n), name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.filter("n_tokens = 0").count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}_" for i in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES} and "pipeline" in names


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, row_key int, tokens string"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names; no stage loses or alters what it isn't meant to."""
    plain = "Some ordinary words about a river and the town beside it, told at length by somebody who knew both of them well. "
    rows = [(1, plain * 3), (1, plain * 3), (2, plain * 3), (2, "An entirely different text that shares its id with another one and nothing else at all."), (3, None), (4, ""), (None, "A text without an id, yet with enough words to have shingles of its own."), (5, plain * 20_000), (6, "one\ntwo\nthree"), (None, None)]
    docs = spark.createDataFrame([(i, t, None if n % 2 else "en", None if n % 3 else "s", None if n % 4 else 7, 1.0, "x", n, None) for n, (i, t) in enumerate(rows)], ODD)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in list(stages.items())[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "test-odd")
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        kept = sorted((str(r.doc_id), r.row_key) for r in out.collect())
        if name == "near-dedup":
            assert {k for _, k in kept} >= {0, 3, 4, 5, 6, 7, 8, 9} and not {1, 2} & {k for _, k in kept}
        if name == "line dedup":
            assert {k for _, k in kept} >= {0, 3, 6, 8}
    coded = stages["encoding"](spark, docs, SF).collect()
    assert len(coded) == len(rows) and sum(r.n_tokens == 0 for r in coded) == 3


def test_stitching_over_given_texts(spark):
    """Small chunks over the whole given table: the same ids as without chunks."""
    from windprint.llm import bpe

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 5 = 0")
    small = {r.doc_id: r.ids for r in bpe.encode(docs, chunk=64, overlap=24).collect()}
    whole = {r.doc_id: r.ids for r in bpe.encode(docs, chunk=1 << 30).collect()}
    assert small == whole and len(whole) == docs.count()
