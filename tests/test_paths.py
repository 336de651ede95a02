"""Paths upward: a round writes what it adds, and only the asked nodes' paths are followed."""

from pyspark.sql import functions as F

from cladeframe.operators import forest as fr


def chain(spark, n):
    rows = [(t, k, f"n{k:02d}", "LEAF" if k == n - 1 else "INTERNAL", k - 1 if k else None, 0, 0.5 if k else None) for t in range(3) for k in range(n)]
    return spark.createDataFrame(rows, "tree long, node int, name string, kind string, parent int, child_ix int, branch_len double")


def test_a_round_writes_only_the_rows_that_it_adds(spark, monkeypatch):
    written, plain = [], fr.materialised

    def counted(df, tag):
        out = plain(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(fr, "materialised", counted)
    up = fr.paths(chain(spark, 9)).collect()
    assert {(r.tree, r.node, r.ancestor, r.dist, r.depth) for r in up} == {(t, a, b, 0.5 * (a - b), a - b) for t in range(3) for a in range(9) for b in range(a + 1)}
    assert len(up) == 3 * 45
    assert sum(n for tag, n in written if tag == "paths") == 3 * 36  # each path of one branch or more, once


def test_paths_of_some_nodes(spark):
    nodes = chain(spark, 6)
    some = nodes.where("node in (2, 5) and tree < 2").select("tree", "node", "name")
    rows = fr.paths(nodes, some)
    assert rows.columns == ["tree", "node", "name", "ancestor", "dist", "depth"]
    assert {(r.tree, r.node, r.name, r.ancestor, r.depth) for r in rows.collect()} == {(t, a, f"n{a:02d}", b, a - b) for t in range(2) for a in (2, 5) for b in range(a + 1)}
    assert fr.paths(nodes, some.where(F.lit(False))).count() == 0
