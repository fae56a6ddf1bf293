"""Merkle manifest of a data set: subtrees by superblock, finished together with the outer nodes they need.

A tree per category (``tree``) has its rows' digests as leaves, in order; every two neighbours become the digest of
their hexadecimal digests one after another, a last node without a neighbour the digest of itself alone, until one
node is left. The roots of the trees, in order, are the leaves of one more tree with the root of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Levels that are reduced inside one superblock: it has at most 2 to this power nodes (``depth``).
LEVELS = 12

_NODES = "tree string, pos long, node string"
_OUTER = "tree string, pos long, proof array<string>, sides string, top string"


def leaf(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` for a null, else its UTF-8 byte count, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def _levels(nodes: list[str], first: int, depth: int) -> list[list[str]]:
    """The nodes of each level of a superblock, from its own up: ``depth`` times, or until one is left where it is all of its tree.

    That is so if it begins the tree (``first`` is 0) and isn't full; a full one comes to one node either way.
    """
    whole = first == 0 and len(nodes) < 1 << depth
    out = [nodes]
    while len(out[-1]) > 1 or not whole and len(out) <= depth:
        low = out[-1]
        out.append([_digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def _path(levels: list[list[str]], at: int) -> tuple[list[str], str]:
    """Siblings of a node from the bottom up, and for each level where the sibling stands: L, R, or N for none."""
    proof, sides = [], ""
    for nodes in levels[:-1]:
        other = at ^ 1
        if other < len(nodes):
            proof.append(nodes[other])
        sides += "N" if other >= len(nodes) else "R" if other > at else "L"
        at >>= 1
    return proof, sides


def fold(node: str, proof: Sequence[str], sides: str) -> str:
    """The root that a node and its siblings lead to."""
    siblings = iter(proof)
    for side in sides:
        node = _digest(node) if side == "N" else _digest(node, next(siblings)) if side == "R" else _digest(next(siblings), node)
    return node


def positions(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``pos``, its place from 0 within its tree by ``order``.

    Rows are dealt by ranges of (tree, order) and counted by range and tree, so neither a tree nor the driver gathers
    them; the small table of counts alone is summed by tree.
    """
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    listed = materialize(dealt.withColumn("seq", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("seq", 33)
    runs = listed.groupBy(F.col(tree).alias("run_tree"), part.alias("run")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("run_tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run_tree", "run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = listed.join(runs, (F.col(tree) == F.col("run_tree")) & (part == F.col("run")))
    return placed.select(*rows.columns, (F.col("seq") - F.col("first") + F.col("before")).alias("pos"))


def _superblock(depth: int) -> Column:
    return F.shiftright("pos", depth)


def _reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """The root of each superblock, numbered as a node of the level above."""

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = _levels(group["node"].tolist(), int(group["pos"].iloc[0]), depth)
        return pd.DataFrame({"tree": [key[0]], "pos": [int(key[1])], "node": levels[-1]})

    return nodes.select("tree", "pos", "node", _superblock(depth).alias("block")).groupBy("tree", "block").applyInPandas(reduce, _NODES)


def _climb(nodes: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """Written tables of nodes, each of the superblocks of the one before; the last has one node for each tree."""
    rungs = [nodes]
    while True:
        rungs.append(materialize(_reduced(rungs[-1], depth), name))
        if rungs[-1].filter("pos > 0").isEmpty():
            return rungs


def _descend(rungs: list[DataFrame], outer: DataFrame, depth: int, name: str) -> DataFrame:
    """The outer path (``proof``, ``sides``) and the root of all (``top``) of each node of the second rung.

    ``outer`` has them for the last rung. On each rung nodes and the outer path of their superblock meet in one task.
    """

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        levels = _levels(nodes["node"].tolist(), int(nodes["pos"].iloc[0]), depth)
        tail, sides, top = (above[c].iloc[0] for c in ("proof", "sides", "top"))
        paths = [_path(levels, i) for i in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "proof": [p + list(tail) for p, _ in paths], "sides": [s + sides for _, s in paths], "top": top})

    for nodes in reversed(rungs[1:-1]):
        left = nodes.select("tree", "pos", "node", _superblock(depth).alias("block")).groupBy("tree", "block")
        outer = materialize(left.cogroup(outer.withColumnRenamed("tree", "above").groupBy("above", "pos")).applyInPandas(finish, _OUTER), name)
    return outer


def manifest(rows: DataFrame, tree: str, order: Sequence[str], leaf_col: str, claimed: str | None = None, depth: int = LEVELS) -> DataFrame:
    """``rows`` with each leaf's place in its tree, its proof, and the root to which a claimed leaf folds.

    ``rows`` has a row for each leaf: its category ``tree``, the columns of its order, its digest ``leaf_col`` in
    lowercase hexadecimal, and the digest ``claimed`` to be checked (None or null: the leaf itself). Added are ``pos``
    (from 0 in its tree), ``subroot``, ``root``, ``proof`` (siblings from the leaf to the root), ``sides`` (for each
    level L, R or N: the sibling is left, right, none), and ``folded_root``; the columns of ``rows`` must not have
    these names, nor ``tree_key``, ``block``, ``place`` and ``tie``; their types must be castable to strings and back.

    Superblocks of 2**``depth`` leaves are reduced on their own; their roots again, until each tree has one node; then the roots
    of the trees likewise. On the way down the outer path of every superblock is cogrouped with its nodes, and at the
    leaves one task does the local reduction, joins local and outer proof and folds. No group has more than 2**``depth``
    nodes, however large a tree.

    Nulls: a null category is a tree of its own, before all others; trees are ordered by the bytes of their name. In a
    tree null order values come first and equal ones by digest; equal rows are leaves of their own. A table without rows gives none.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    listed = materialize(rows.withColumns({"tree_key": key, "tie": F.monotonically_increasing_id()}), "merkle-leaves")
    ordered = materialize(positions(listed, "tree_key", [*order, leaf_col, "tie"], "merkle-dealt").drop("tie"), "merkle-order")
    leaves = ordered.select(F.col("tree_key").alias("tree"), "pos", F.col(leaf_col).alias("node"))
    rungs = _climb(leaves, depth, "merkle-rung")
    roots = rungs[-1].select("tree", F.col("node").alias("subroot"))

    # the tree of the trees' roots
    forest = materialize(positions(roots.withColumn("all", F.lit("")), "all", ["tree"], "merkle-roots"), "merkle-forest")
    top_rungs = _climb(forest.select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("node")), depth, "merkle-top")
    crown = top_rungs[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("proof"), F.lit("").alias("sides"), F.col("node").alias("top"))
    crown = _descend(top_rungs, crown, depth, "merkle-crown")

    def join_top(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        levels = _levels(nodes["subroot"].tolist(), int(nodes["pos"].iloc[0]), depth)
        tail, sides, top = (above[c].iloc[0] for c in ("proof", "sides", "top"))
        paths = [_path(levels, i) for i in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["tree"], "pos": 0, "proof": [p + list(tail) for p, _ in paths], "sides": [s + sides for _, s in paths], "top": top})

    named = forest.select("all", "tree", "pos", "subroot", _superblock(depth).alias("block")).groupBy("all", "block")
    outer = materialize(named.cogroup(crown.select(F.col("tree").alias("above"), "pos", "proof", "sides", "top").groupBy("above", "pos")).applyInPandas(join_top, _OUTER), "merkle-outer")
    outer = _descend(rungs, outer, depth, "merkle-outer").join(roots.withColumnRenamed("tree", "root_tree"), F.col("tree") == F.col("root_tree")).drop("root_tree")

    kept = [c for c in ordered.columns if c != "tree_key"]
    new = ["subroot", "root", "proof", "sides", "folded_root"]
    # as strings, so that pandas makes no floating-point numbers of integers beside nulls
    schema = ", ".join(f"`{c}` string" for c in kept) + ", subroot string, root string, proof array<string>, sides string, folded_root string"

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place").reset_index(drop=True)
        levels = _levels(nodes[leaf_col].tolist(), int(nodes["place"].iloc[0]), depth)
        tail, sides = list(above["proof"].iloc[0]), above["sides"].iloc[0]
        paths = [_path(levels, i) for i in range(len(nodes))]
        out = nodes[kept].copy()
        out["subroot"], out["root"] = above["subroot"].iloc[0], above["top"].iloc[0]
        out["proof"], out["sides"] = [p + tail for p, _ in paths], [s + sides for _, s in paths]
        shown = levels[0] if claimed is None else [c if isinstance(c, str) else own for c, own in zip(nodes[claimed], levels[0])]
        out["folded_root"] = [fold(n, p, s) for n, p, s in zip(shown, out["proof"], out["sides"])]
        return out

    left = ordered.select("tree_key", _superblock(depth).alias("block"), F.col("pos").alias("place"), *[F.col(c).cast("string").alias(c) for c in kept]).groupBy("tree_key", "block")
    right = outer.select(F.col("tree").alias("above"), F.col("pos").alias("above_pos"), "proof", "sides", "top", "subroot").groupBy("above", "above_pos")
    done = left.cogroup(right).applyInPandas(finish, schema)
    return done.select(*[F.col(c).cast(ordered.schema[c].dataType).alias(c) for c in kept], *new)


def document_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, id_col: str = "doc_id", tree_col: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), depth: int = LEVELS) -> DataFrame:
    """``manifest`` of a table of documents: ``id, leaf, claimed, pos, subroot, root, proof, sides, folded_root``.

    A leaf is the digest of the row's ``fields``. ``tampered`` has other values for some fields (columns of ``docs``):
    the leaf made with them is the claimed one, that a check of the manifest has to find out.
    """
    own = [F.col(f) for f in fields]
    claimed = leaf(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("category"), leaf(*own).alias("leaf"), claimed.alias("claimed"))
    return manifest(rows, "category", ["id"], "leaf", "claimed", depth).withColumnRenamed("id", id_col).drop("category")
