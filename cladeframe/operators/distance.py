"""Pairwise distances from site patterns, and the two greedy tree builders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.alignment import ABSENT, is_residue, pieces
from cladeframe.operators.tree import Node, Tree


def pair_counts(patterns: DataFrame, columns: list[str], rule: str = "nj") -> DataFrame:
    """(t1, t2, matches, mismatches, d) of all pairs t1 < t2.

    nj: columns where either is missing are skipped. upgma: only columns where both hold the same gap are skipped, up to
    the shorter track's end.
    """
    pairs = F.array(*(F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]))
    df = patterns.select("n", F.explode(pairs).alias("p")).select("n", "p.*")
    x, y = F.col("x"), F.col("y")
    use = is_residue(x) & is_residue(y) if rule == "nj" else (x != ABSENT) & (y != ABSENT) & ~((x == y) & ~is_residue(x))
    sums = df.where(use).groupBy("t1", "t2").agg(F.sum(F.when(x == y, F.col("n")).otherwise(0)).cast("long").alias("matches"), F.sum(F.when(x != y, F.col("n")).otherwise(0)).cast("long").alias("mismatches"))
    return sums.withColumn("d", F.round(F.col("mismatches") / (F.col("matches") + F.col("mismatches")), 9))


def track_pairs(tracks: DataFrame, names: list[str], rule: str = "nj") -> DataFrame:
    """The same rows from tracks (block, track, seq) of any number of taxa: a stretch of a block is a 0/1 matrix of taxa by
    columns for each symbol, whose product with itself turned over counts the columns where two taxa both hold it. A task
    holds one stretch and one square of taxa; no row is made for a column, or for a pair in one."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, all_ = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        now, held = None, {}

        def add() -> None:
            width = max(map(len, held.values()), default=0)
            grid = np.zeros((len(held), width), np.uint8)  # 0: past the track's end
            for k, seq in enumerate(held.values()):
                grid[k, : len(seq)] = np.frombuffer(seq.encode(), np.uint8)
            at = np.ix_(list(held), list(held))
            ones = lambda x: (lambda m: (m @ m.T).astype(np.int64))(x.astype(np.float32))  # noqa: E731  # counts below 2^24
            gaps = [s for s in np.unique(grid) if chr(s) in "-.~ "]
            solid = (grid > 0) & ~np.isin(grid, gaps)
            for s in np.unique(grid[solid]):
                same[at] += ones(grid == s)
            all_[at] += ones(solid) if rule == "nj" else ones((grid > 0) & (grid != ord(ABSENT))) - sum(ones(grid == s) for s in gaps if chr(s) != ABSENT)

        for batch in batches:
            for block, stretch, track, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, stretch) != now:
                    add()
                    now, held = (block, stretch), {}
                held[track] = seq
        add()
        i, j = np.triu_indices(n, 1)
        there = all_[i, j] > 0
        i, j = i[there], j[there]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), same[i, j], all_[i, j])], names=["i", "j", "m", "n"])

    cut = pieces(tracks.where(F.col("track") < n)).select("block", "stretch", "track", "seq").repartition("block", "stretch").sortWithinPartitions("block", "stretch")
    sums = cut.mapInArrow(run, "i int, j int, m long, n long").groupBy("i", "j").agg(F.sum("m").alias("matches"), F.sum("n").alias("n"))
    name = lambda k: F.get(F.array(*map(F.lit, names)), F.col(k))
    df = sums.select(name("i").alias("t1"), name("j").alias("t2"), "matches", (F.col("n") - F.col("matches")).alias("mismatches"))
    return df.withColumn("d", F.round(F.col("mismatches") / (F.col("matches") + F.col("mismatches")), 9))


def closest_pair(dist: DataFrame) -> DataFrame:
    """The pair of least distance; ties to the first pair by name."""
    return dist.agg(F.min(F.struct("d", "t1", "t2")).alias("m")).select("m.t1", "m.t2", "m.d")


def neighbour_joining(names: list[str], d: list[list[float]]) -> Tree:
    """Join the pair of least d - r_i - r_j until two are left; those meet half-way under a node named root.

    The joined pair's place is taken by the new node, the freed place by the last cluster.
    """
    d = [row[:] for row in d]
    nodes = [Node(name) for name in names]
    made = 0
    while len(nodes) > 2:
        n = len(nodes)
        r = [sum(d[i][k] for k in range(n) if k != i) / (n - 2) for i in range(n)]
        _, i, j = min((d[i][j] - r[i] - r[j], i, j) for i in range(n) for j in range(i + 1, n))
        left = (d[i][j] + r[i] - r[j]) / 2
        made += 1
        new = Node(f"A{made}", [(nodes[i], left), (nodes[j], d[i][j] - left)])
        row = [(d[i][k] + d[j][k] - d[i][j]) / 2 for k in range(n)]
        _replace(nodes, d, i, j, new, row)
    half = d[0][1] / 2
    return Tree(Node("root", [(nodes[0], half), (nodes[1], half)]))


def upgma(names: list[str], d: list[list[float]]) -> Tree:
    """Join the closest pair, distances as means weighted by size; each branch is (d - h_left - h_right) / 2, and the
    new height is that plus the left height."""
    d = [row[:] for row in d]
    nodes, height, size, made = [Node(name) for name in names], [0.0] * len(names), [1] * len(names), 0
    while len(nodes) > 1:
        n = len(nodes)
        _, i, j = min((d[i][j], i, j) for i in range(n) for j in range(i + 1, n))
        branch = (d[i][j] - height[i] - height[j]) / 2
        made += 1
        new = Node(f"A{made}", [(nodes[i], branch), (nodes[j], branch)])
        row = [(size[i] * d[i][k] + size[j] * d[j][k]) / (size[i] + size[j]) for k in range(n)]
        height[i], size[i] = branch + height[i], size[i] + size[j]
        height[j], size[j] = height[-1], size[-1]
        height.pop()
        size.pop()
        _replace(nodes, d, i, j, new, row)
    return Tree(nodes[0])


def _replace(nodes: list[Node], d: list[list[float]], i: int, j: int, new: Node, row: list[float]) -> None:
    nodes[i] = new
    for k in range(len(nodes)):
        d[i][k] = d[k][i] = row[k]
    d[i][i] = 0.0
    last = len(nodes) - 1
    nodes[j] = nodes[last]
    for k in range(len(nodes)):
        d[j][k], d[k][j] = d[last][k], d[k][last]
    d[j][j] = 0.0
    nodes.pop()
    d.pop()
    for r in d:
        r.pop()


def matrix(dist: DataFrame, names: list[str]) -> list[list[float]]:
    """The distances of a few taxa as a square on the driver; pairs without a compared column are at distance 0."""
    at = {name: k for k, name in enumerate(names)}
    out = [[0.0] * len(names) for _ in names]
    for r in dist.collect():  # one row per pair of taxa
        out[at[r.t1]][at[r.t2]] = out[at[r.t2]][at[r.t1]] = float(r.d or 0.0)
    return out
