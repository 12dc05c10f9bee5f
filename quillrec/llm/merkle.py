"""Merkle manifest of a table: a tree of hashes for each group of rows, and one tree over the groups' roots.

Nodes are rows (tree, idx, digest). On every level nodes meet their siblings by equijoins on computed sibling indices:
idx XOR 1 in binary trees, in wider ones the other slots of the run, one shift at a time. Nodes in slot zero then emit
the parents. The joined levels hold each node's siblings, from which proofs are read downwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.operators.ranks import with_global_rank
from quillrec.session import stage

BLOCK_LEVELS = 6  # lowest levels of a proof, read from one group of at most 2 * 2^6 nodes
CHAINED = 8  # joins of one plan on the way down


class Tree(NamedTuple):
    """`levels` (tree, idx, n, digest, before, after) from the leaves up; `tops` (tree, top)."""

    levels: list[DataFrame]
    tops: DataFrame


class Manifest(NamedTuple):
    """`leaves` (rows with `_tree`, `_idx`), the trees of the groups, the tree over them, and its root (None if empty)."""

    leaves: DataFrame
    groups: Tree
    whole: Tree
    root: str | None
    arity: int


def digest_of(fields: Sequence[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and its text."""
    texts = [x.cast("string") for x in fields]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    return F.sha2(F.concat(*parts), 256)


def _linked(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests of their siblings to the left (`before`) and to the right (`after`)."""
    slot, found = F.col("idx") % arity, nodes
    before, after = [], []
    for shift in range(1, arity):
        # The node whose sibling, `shift` slots on and around, is this one.
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot - shift + arity) % arity
        name = f"_{shift}"
        found = found.join(nodes.select("tree", place.cast("long").alias("idx"), F.col("digest").alias(name)), ["tree", "idx"], "left")
        held = F.coalesce(F.col(name), F.lit(""))
        before.append(F.when(slot + shift >= arity, held).otherwise(""))
        after.append(F.when(slot + shift < arity, held).otherwise(""))
    return found.select("tree", "idx", "n", "digest", F.concat(*before).alias("before"), F.concat(*after).alias("after"))


def build_tree(nodes: DataFrame, arity: int) -> Tree:
    """Trees over nodes (tree, idx, n, digest): n nodes of a tree, idx from 0 without gaps.

    One staged table a level, of all trees at once, each a `arity`-th of the one below. A lone node is its tree's top.
    """
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    tops = [nodes]
    while most > 1:
        linked = stage(_linked(nodes.where(F.col("n") > 1), arity))
        levels.append(linked)
        nodes = linked.where(F.col("idx") % arity == 0).select(
            "tree",
            F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).cast("long").alias("n"),
            F.sha2(F.concat("digest", "after"), 256).alias("digest"),
        )
        tops.append(nodes)
        most = -(-most // arity)
    top, *others = [x.where(F.col("n") == 1).select("tree", F.col("digest").alias("top")) for x in tops]
    for other in others:
        top = top.unionByName(other)
    return Tree(levels, stage(top))


def build_manifest(docs: DataFrame, group: str, order: str, leaf: Column, arity: int = 2, *keep: Column) -> Manifest:
    """Trees over the rows of `docs`, one for each value of `group`, and one tree over their roots.

    Leaves stand in ascending `order`, null first; equal ones by their digest, so the result does not depend on how rows
    are stored. Groups stand in ascending order of their values, null first. Repeated rows are leaves of their own.
    An empty table has no root. Only `group`, `order`, the digest and `keep` are carried, so other columns cannot clash.
    """
    rows = docs.select(F.col(group).alias("_group"), F.col(order).alias("_order"), leaf.alias("_leaf"), *keep)
    by_place = [F.asc_nulls_first("_group"), F.asc_nulls_first("_order"), F.asc("_leaf")]
    ranked = stage(with_global_rank(stage(rows), by_place, "_rank"))
    sizes = ranked.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    trees = stage(with_global_rank(sizes, [F.asc_nulls_first("_group")], "_tree"))
    names = trees.withColumnRenamed("_group", "_name")
    placed = ranked.join(names, F.col("_group").eqNullSafe(F.col("_name")))
    leaves = stage(placed.withColumn("_idx", F.col("_rank") - F.col("_first")).drop("_name", "_first", "_rank"))
    groups = build_tree(leaves.select(F.col("_tree").alias("tree"), F.col("_idx").alias("idx"), F.col("_n").alias("n"), F.col("_leaf").alias("digest")), arity)
    count = trees.count()
    roots = groups.tops.select(
        F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.lit(count).cast("long").alias("n"), F.col("top").alias("digest")
    )
    whole = build_tree(roots, arity)
    found = whole.tops.first()
    return Manifest(leaves, groups, whole, found.top if found else None, arity)


def _paths(tree: Tree, tops: DataFrame, arity: int, down_to: int) -> DataFrame:
    """Paths (tree, idx, path, and the columns of `tops`) of the nodes of level `down_to` from their trees' tops.

    `tops` (tree, path, ...) has what lies above. A tree that ends at or below that level is there as idx 0.
    """
    own = [x for x in tops.columns if x not in ("tree", "path")]
    heights = range(len(tree.levels), down_to, -1)
    paths = None
    for step, height in enumerate(heights, 1):
        level = tree.levels[height - 1]
        # Trees that end at this height begin here; the others come from the level above.
        begins = level.where(F.col("idx") == 0).where(F.col("n") <= arity).select("tree")
        begins = tops.join(begins, "tree").withColumn("idx", F.lit(0).cast("long"))
        above = begins if paths is None else paths.unionByName(begins)
        up = above.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_above"), *own)
        nodes = level.select("tree", "idx", F.floor(F.col("idx") / arity).cast("long").alias("_up"), "before", "after")
        own_step = F.array(F.struct("before", "after"))
        paths = nodes.join(up, ["tree", "_up"]).select("tree", "idx", F.concat(own_step, "_above").alias("path"), *own)
        if step % CHAINED == 0:
            paths = stage(paths)
    if down_to >= len(tree.levels):
        low = tops
    else:
        low = tops.join(tree.levels[down_to].select("tree").distinct(), "tree", "left_anti")
    low = low.withColumn("idx", F.lit(0).cast("long"))
    return low if paths is None else paths.unionByName(low)


def with_proofs(manifest: Manifest) -> DataFrame:
    """The manifest's leaves with `_path`: (before, after) of each level from the leaf to the root, and `_subroot`.

    Down to BLOCK_LEVELS above the leaves, paths come level by level. From there on a block's nodes, a number bounded by
    the arity, are gathered with the path above them, and each leaf picks its own.
    """
    arity, tops = manifest.arity, manifest.groups.tops
    empty = F.expr("array()").cast("array<struct<before:string,after:string>>")
    top = manifest.whole.tops.select("tree", empty.alias("path"))
    upper = _paths(manifest.whole, top, arity, 0).select((F.col("idx") + 1).alias("tree"), "path")
    upper = stage(upper.join(tops, "tree"))
    depth = next(x for x in range(1, BLOCK_LEVELS + 1) if arity**x >= 2**BLOCK_LEVELS)
    depth = min(depth, len(manifest.groups.levels))
    paths = _paths(manifest.groups, upper, arity, depth)
    leaves = manifest.leaves.withColumn("_block", F.floor(F.col("_idx") / arity**depth).cast("long"))
    paths = paths.select(F.col("tree").alias("_tree"), F.col("idx").alias("_block"), F.col("path").alias("_above"), F.col("top").alias("_subroot"))
    if not depth:
        return leaves.join(paths, ["_tree", "_block"]).withColumnRenamed("_above", "_path").drop("_block")
    nodes = None
    for height, level in enumerate(manifest.groups.levels[:depth]):
        block = F.floor(F.col("idx") / arity ** (depth - height)).cast("long")
        width = F.lit(arity**height).cast("long")
        own = level.select(F.col("tree").alias("_tree"), block.alias("_block"), F.struct(width.alias("width"), "idx", "before", "after").alias("node"))
        nodes = own if nodes is None else nodes.unionByName(own)
    # At most arity ** depth leaves and what lies over them: under 2 * 2 ** BLOCK_LEVELS nodes in binary trees.
    blocks = nodes.groupBy("_tree", "_block").agg(F.array_sort(F.collect_list("node")).alias("_nodes"))
    joined = leaves.join(paths, ["_tree", "_block"]).join(blocks, ["_tree", "_block"], "left")
    mine = F.filter("_nodes", lambda x: x["idx"] == F.floor(F.col("_idx") / x["width"]))
    lower = F.transform(mine, lambda x: F.struct(x["before"].alias("before"), x["after"].alias("after")))
    return joined.withColumn("_path", F.concat(F.coalesce(lower, empty), "_above")).drop("_block", "_nodes", "_above")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["before"], digest, x["after"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def verified_rows(docs: DataFrame, group: str, order: str, leaf: Column, now: Column, arity: int = 2) -> DataFrame:
    """Every row's digests, proof and whether `now`, the digest of what the row is today, still leads to the root.

    Returns the column `order`, leaf, subroot, root, proof_sha256, folded_root, verified. See `build_manifest` for
    nulls, ties, repeated rows and empty tables; texts of any length are hashed in place.
    """
    manifest = build_manifest(docs, group, order, leaf, arity, now.alias("_now"))
    proofs = with_proofs(manifest).withColumn("_root", F.lit(manifest.root).cast("string"))
    return proofs.select(
        F.col("_order").alias(order), F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        F.sha2(siblings(F.col("_path")), 256).alias("proof_sha256"),
        folded(F.col("_now"), F.col("_path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
