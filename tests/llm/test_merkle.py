"""Merkle manifest against a plain recursion, with superblocks of four so that several rungs are needed."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from windprint.llm import merkle
from windprint.llm.common import reachable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, proof string"


def digest(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes, at):
    """The root over ``nodes`` and the siblings of the node ``at``."""
    proof = []
    while len(nodes) > 1:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        proof += [n for i, n in enumerate(run) if i != at % 2]
        nodes, at = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], proof


def plain_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def by_hand(rows):
    trees = {}
    for i, text, lang, source, n, *_ in rows:
        trees.setdefault(lang, []).append((i is not None, i or 0, plain_leaf(i, source, lang, n, text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(v) for k, v in trees.items()}
    roots = [climb([x[2] for x in trees[k]], 0)[0] for k in names]
    out = []
    for place, k in enumerate(names):
        root, above = climb(roots, place)
        for at, (known, i, leaf) in enumerate(trees[k]):
            sub, proof = climb([x[2] for x in trees[k]], at)
            out.append((i if known else None, leaf, sub, root, tuple(proof + above)))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof").collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    reachable(spark)
    rows = [(i, f"text {i}", lang, "s", i * 3, "x", "y") for lang, ids in {"a": range(0, 90, 2), "b": [7], "Z": range(1, 34, 2), "é": [3, 5], None: [11, 12, 13]}.items() for i in ids]
    rows += [(2, "other text", "a", None, None, "x", "y"), (4, "text 4", "a", "s", 12, "x", "y"), (None, None, "a", None, None, "x", "y"), (None, "", None, "", 0, "x", "y"), (2**60 + 1, "ä" * 50_000, "b", "s", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_manifest(odd):
    docs, rows = odd
    for depth in (1, 2, 12):
        assert shown(merkle.document_manifest(docs, depth=depth)) == by_hand(rows)


def test_tampering_is_found(odd):
    docs, rows = odd
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.document_manifest(docs, {"n_chars": changed}, depth=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.folded_root == r.root) == (r.claimed == r.leaf) == (r.doc_id is None or r.doc_id % 3 != 0)
        assert r.folded_root == merkle.fold(r.claimed, r.proof, r.sides)


def test_empty(odd, spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.document_manifest(none).count() == 0


def test_query_on_documents(spark):
    from windprint.llm.queries import op12_merkle

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = {r.doc_id: r for r in op12_merkle(spark, sf).collect()}
    for i, leaf, sub, root, proof in by_hand(rows):
        r = got[i]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, sub, root, digest(*proof))
        assert r.verified == (r.folded_root == root) == (zlib.crc32(str(i).encode()) % 7 != 0)
