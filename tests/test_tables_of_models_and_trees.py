"""Many trees as a table against the single-tree operators; context hierarchies and transition tables from data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import models as m
from cladeframe.operators import alignment as al
from cladeframe.operators import forest as fr
from cladeframe.operators import hierarchy
from cladeframe.operators.tree import Node, Tree

NODES = "tree long, node int, name string, kind string, parent int, child_ix int, branch_len double"


def random_tree(rng, n):
    """A tree of n leaves by joining two at random, with its rows."""
    parts, made = [Node(f"l{k}") for k in range(n)], 0
    while len(parts) > 1:
        i, j = sorted(rng.choice(len(parts), 2, replace=False))
        made += 1
        parts[i] = Node(f"a{made}", [(parts[i], float(rng.integers(1, 50))), (parts.pop(j), float(rng.integers(1, 50)))])
    return Tree(parts[0])


def rows_of(number, tree):
    return [(number, k, name, kind, parent, ix, d) for k, name, kind, parent, ix, d, _ in tree.rows()]


@pytest.fixture(scope="module")
def trees():
    rng = np.random.default_rng(1)
    ladder = Node("l0")
    for k in range(1, 40):  # deeper than sixty-four nodes and than five rounds of doubling
        ladder = Node(f"a{k}", [(ladder, 1.0), (Node(f"l{k}"), 2.0)])
    return {0: Tree(ladder), **{k: random_tree(rng, int(n)) for k, n in enumerate([1, 2, 3, 5, 9, 17], 1)}}


@pytest.fixture(scope="module")
def nodes(spark, trees):
    return spark.createDataFrame([r for k, t in trees.items() for r in rows_of(k, t)], NODES)


def distances(tree):
    return {tuple(sorted(pair)): d for pair, d in tree.leaf_distances().items()}


def by_tree(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.tree, {})[r.a, r.b] = r.d
    return out


def test_distances_and_clades_of_a_forest(nodes, trees):
    got = by_tree(fr.leaf_distances(nodes))
    assert got == {k: {p: pytest.approx(d) for p, d in distances(t).items()} for k, t in trees.items() if len(t.nodes) > 1}
    found = {(r.tree, r.node): r for r in fr.clades(nodes).collect()}
    assert len(found) == sum(len(t.nodes) for t in trees.values())
    for k, t in trees.items():
        for x in t.nodes:
            r = found[k, t.ids[id(x)]]
            assert r.n_leaves == len(x.leaves()) and r.n_members == len(r.members) == 2 * r.n_leaves - 1 and r.members == sorted(r.members)


def shape(rows):
    """Nodes by the leaves below them, with their branch: what a table of one tree says whatever its numbers."""
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r)

    def below(r):
        return frozenset({r.name} if r.kind == "LEAF" else ()).union(*(below(c) for c in kids.get(r.node, ())))

    return sorted((sorted(below(r)), r.branch_len, len(kids.get(r.node, ()))) for r in rows)


def test_rerooting_a_forest(spark, nodes, trees):
    wanted = {k: "l1" for k in trees if len(trees[k].nodes) > 1 and k != 3}
    df = fr.rerooted(nodes, spark.createDataFrame(list(wanted.items()), "tree long, leaf string"))
    rows = df.collect()
    assert df.columns == list(fr.COLUMNS)
    got = by_tree(fr.leaf_distances(df))
    for k, t in trees.items():
        mine = [r for r in rows if r.tree == k]
        (root,) = [r for r in mine if r.parent is None]
        assert root.branch_len is None and len(mine) == len(t.nodes) - (k in wanted)  # the old root goes
        assert k not in wanted or (root.name == "l1" and [r.kind for r in mine if r.parent == root.node].__len__() == 1)
        assert got.get(k, {}) == {p: pytest.approx(d) for p, d in distances(t).items()}
    again = trees[5].rerooted("l1")
    plain = spark.createDataFrame(rows_of(5, again), NODES).collect()
    theirs = sorted((r.branch_len for r in plain if r.branch_len is not None))
    assert theirs == pytest.approx(sorted(r.branch_len for r in rows if r.tree == 5 and r.branch_len is not None))


def test_pruning_a_forest(spark, nodes, trees):
    names = ["l0", "l2", "l3", "l7", "l30", "l39"]
    df = fr.pruned(nodes, F.col("name").isin(names))
    rows, got = df.collect(), by_tree(fr.leaf_distances(df))
    for k, t in trees.items():
        mine = [r for r in rows if r.tree == k]
        left = [n for n in names if any(x.name == n and not x.children for x in t.nodes)]
        assert len(mine) == max(0, 2 * len(left) - 1) and sum(r.parent is None for r in mine) == bool(left)
        assert got.get(k, {}) == {p: pytest.approx(d) for p, d in distances(t).items() if set(p) <= set(left)}
        if len(left) > 1 and k:
            theirs = spark.createDataFrame(rows_of(k, t.pruned(set(left))), NODES).collect()
            assert [(a, n) for a, _, n in shape(mine)] == [(a, n) for a, _, n in shape(theirs)]
    assert fr.pruned(nodes, F.lit(False)).count() == 0


def test_no_trees(spark):
    none = spark.createDataFrame([], NODES)
    assert fr.leaf_distances(none).count() == fr.clades(none).count() == fr.pruned(none, F.lit(True)).count() == 0


def test_context_counts(spark):
    rows = [(0, 0, "ACGTNACG-ACCA", 0), (0, 1, "ACCTAACGTATCA", 0), (1, 0, "AC", 0), (1, 1, "G", 0)]
    sites = al.left_sites(spark.createDataFrame(rows, "block long, track int, seq string, phase int"), 2, 2, [0])
    want = {}
    for block in (0, 1):
        x, y = (next(r[2] for r in rows if r[0] == block and r[1] == k) for k in (0, 1))
        for i in range(min(len(x), len(y))):
            if x[i] in "ACGT" and y[i] in "ACGT":
                for k in range(3):
                    ctx = x[i - k : i] if i >= k else None
                    if ctx is not None and set(ctx) <= set("ACGT"):
                        n, changed = want.get(ctx, (0, 0))
                        want[ctx] = n + 1, changed + (x[i] != y[i])
    counts = hierarchy.context_counts(sites, "t0", "t1", 2)
    assert {r.ctx: (r.n, r.changed) for r in counts.collect()} == want
    (whole,) = hierarchy.context_counts(sites, "t0", "t1", 0).collect()
    assert (whole.ctx, whole.n, whole.changed) == ("", *want[""])


def test_orders_as_rows(spark):
    model = m.ContextModel.build(2, lambda f, c: m.Model("JC", (0.1 + sum("ACGT".index(x) * 4**k for k, x in enumerate(reversed(c))) / 100,)))
    rows = spark.createDataFrame([(c, x.params[0], len(c)) for (_, c), x in model.models.items()], "ctx string, alpha double, n int")
    as_dict = lambda df: {r.ctx: pytest.approx(r.alpha) for r in df.collect()}
    of = lambda held: {c: x.params[0] for (_, c), x in held.models.items()}
    assert as_dict(hierarchy.raised(rows, 2)) == of(model.raised()) and as_dict(hierarchy.lower(rows, 2)) == of(model.lower())
    assert as_dict(hierarchy.averaged(rows, 2, "alpha")) == of(model.averaged())


def test_transitions_and_densities(spark):
    times = spark.createDataFrame([(0.1,), (2.0,)], "t double")
    models = {"HKY": m.Model("HKY", (0.4, 0.2), (0.3, 0.2, 0.2, 0.3)), "GAP": m.Model("GAP", (0.3, 0.2))}
    got = {(r.model, r.t, r.a, r.b): r.p for r in hierarchy.transitions(times, models).collect()}
    assert len(got) == 2 * (16 + 9)
    for (name, t, a, b), p in got.items():
        states = "ACGT" if name == "HKY" else "N-."
        assert p == pytest.approx(models[name].at(t)[states.index(a), states.index(b)])
    x = [0.0, 0.5, 1.0, 7.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", hierarchy.gamma_at(F.col("x"), 2.5, 0.7).alias("p"))
    assert [r.p for r in df.orderBy("x").collect()] == pytest.approx([v**1.5 * math.exp(-v / 0.7) / (math.gamma(2.5) * 0.7**2.5) for v in x])
