"""Many trees as one table of nodes: (tree, node, name, kind, parent, child_ix, branch_len), parent null at a root.

Paths upward come from joins that double their reach in every round, so the number of jobs follows the logarithm of the
deepest path and no tree is ever held by one task or the driver. Rerooting reverses a path, pruning contracts one; both
are joins with the paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.plans.shared import materialised

COLUMNS = ("tree", "node", "name", "kind", "parent", "child_ix", "branch_len")


def paths(nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(tree, node, ancestor, dist, depth) of every node and each node above it, itself included at depth 0; of the nodes of
    start (tree, node, ...) alone where it is given, whose other columns come along. A round writes the rows that it adds."""
    start = nodes.select("tree", "node") if start is None else start
    fields = start.columns
    up = start.select(*fields, F.col("node").alias("ancestor"), F.lit(0.0).alias("dist"), F.lit(0).alias("depth"))
    jump = materialised(nodes.where("parent is not null").select("tree", F.col("node").alias("at"), F.col("parent").alias("to"), F.col("branch_len").alias("far"), F.lit(1).alias("steps")), "jump")
    while not jump.isEmpty():
        more = up.withColumnRenamed("ancestor", "at").join(jump, ["tree", "at"]).select(*fields, F.col("to").alias("ancestor"), (F.col("dist") + F.col("far")).alias("dist"), (F.col("depth") + F.col("steps")).alias("depth"))
        up = up.union(materialised(more, "paths"))
        then = jump.select("tree", F.col("at").alias("to"), F.col("to").alias("end"), F.col("far").alias("more"), F.col("steps").alias("on"))
        jump = materialised(jump.join(then, ["tree", "to"]).select("tree", "at", F.col("end").alias("to"), (F.col("far") + F.col("more")).alias("far"), (F.col("steps") + F.col("on")).alias("steps")), "jump")
    return up


def leaf_distances(nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(tree, a, b, d) of all pairs of leaves a < b of each tree, through the nearest node above both. A leaf may also be the
    root, as in a tree that was rerooted at it."""
    named = nodes.where("kind = 'LEAF'").select("tree", "node", "name")
    leaves = paths(nodes, named) if up is None else up.join(named, ["tree", "node"])
    leaves = leaves.select("tree", "ancestor", "name", "dist")
    other = leaves.select("tree", "ancestor", F.col("name").alias("b"), F.col("dist").alias("e"))
    return leaves.join(other, ["tree", "ancestor"]).where("name < b").groupBy("tree", F.col("name").alias("a"), "b").agg(F.round(F.min(F.col("dist") + F.col("e")), 9).alias("d"))


def clades(nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(tree, node, n_members, n_leaves, members): the nodes at or below each node, by rising number."""
    up = paths(nodes) if up is None else up
    kinds = up.join(nodes.select("tree", "node", "kind"), ["tree", "node"])
    below = kinds.groupBy("tree", F.col("ancestor").alias("at")).agg(F.count("*").alias("n_members"), F.sum((F.col("kind") == "LEAF").cast("long")).alias("n_leaves"), F.array_sort(F.collect_list("node")).alias("members"))
    return below.withColumnRenamed("at", "node")


def rerooted(nodes: DataFrame, leaves: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """The trees with the leaf that leaves (tree, leaf) names as their root: the path from it is turned round, and the old
    root, left with one child, goes; its two branches become one. Trees that leaves lacks stay as they are."""
    chosen = nodes.join(leaves.select("tree", F.col("leaf").alias("name")), ["tree", "name"]).where("kind = 'LEAF'").select("tree", "node")
    path = paths(nodes, materialised(chosen, "chosen")) if up is None else up.join(chosen, ["tree", "node"], "left_semi")
    path = path.select("tree", F.col("ancestor").alias("node"), "depth")
    length = nodes.select("tree", F.col("node").alias("below"), F.col("branch_len").alias("length"))
    before = path.select("tree", F.col("node").alias("below"), (F.col("depth") + 1).alias("depth")).join(length, ["tree", "below"])
    turned = path.join(before, ["tree", "depth"], "left").select("tree", "node", F.lit(True).alias("turned"), F.col("below").alias("up"), F.col("length").alias("len"))
    df = nodes.join(turned, ["tree", "node"], "left")
    # the old root stands at the path's end: what hangs on it now hangs on the path's node below it
    ends = nodes.where("parent is null").select("tree", F.col("node").alias("old")).join(turned.select("tree", F.col("node").alias("old"), F.col("up").alias("low"), F.col("len").alias("short")), ["tree", "old"])
    df = df.join(ends, "tree", "left").where("old is null or node <> old or up is null")
    hangs = F.col("turned").isNull() & F.col("old").isNotNull() & (F.col("parent") == F.col("old"))
    parent = F.when(F.col("turned"), F.col("up")).when(hangs, F.col("low")).otherwise(F.col("parent"))
    far = F.when(F.col("turned"), F.col("len")).when(hangs, F.col("branch_len") + F.col("short")).otherwise(F.col("branch_len"))
    return df.select("tree", "node", "name", "kind", parent.alias("parent"), "child_ix", far.alias("branch_len"))


def pruned(nodes: DataFrame, keep: Column, up: DataFrame | None = None) -> DataFrame:
    """The trees of the leaves for which keep holds: inner nodes with such leaves below two children or more, each under
    the nearest one above it. A tree without such leaves is gone; one with a single leaf is that leaf."""
    up = paths(nodes) if up is None else up
    leaves = nodes.where("kind = 'LEAF'").where(keep).select("tree", "node")
    alive = up.join(leaves, ["tree", "node"], "left_semi").select("tree", F.col("ancestor").alias("node")).distinct()
    forks = nodes.join(alive, ["tree", "node"], "left_semi").where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("tree", "node")
    left = forks.union(leaves)
    above = up.where("depth > 0").join(forks.select("tree", F.col("node").alias("ancestor")), ["tree", "ancestor"], "left_semi")
    nearest = above.groupBy("tree", "node").agg(F.min(F.struct("depth", "ancestor", "dist")).alias("m")).select("tree", "node", F.col("m.ancestor").alias("above"), F.col("m.dist").alias("far"))
    df = nodes.join(left, ["tree", "node"], "left_semi").join(nearest, ["tree", "node"], "left")
    return df.select("tree", "node", "name", "kind", F.col("above").alias("parent"), "child_ix", F.col("far").alias("branch_len"))
