"""Columns are counted in numpy, a stretch at a time, before Spark holds a row for any of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import models as m
from cladeframe.operators import alignment as al
from cladeframe.operators import likelihood, parsimony
from cladeframe.operators.tree import Node, Tree

TRACKS = "block long, track int, seq string, phase int"
NAMES = ["t0", "t1", "t2"]
TREE = Tree(Node("t0", [(Node("A1", [(Node("t1"), 0.2), (Node("t2"), 0.1)]), 0.3)]))
ROWS = [(0, 0, "ACGTAC-GTN-ACGTTGCA", 1), (0, 1, "AC-TACGG", 1), (0, 2, "A--TACGG.CGTACG-T", 1), (4, 0, "GG", 2), (4, 2, "", 2), (5, 1, "", 0), (6, 1, "ACGT", 0)]


def context_models():
    even = lambda f, c: m.Model("JC", (0.1 + 0.05 * f + 0.04 * sum(map("ACGT".index, c)),))
    plain = m.ContextModel.build(2, lambda f, c: even(0, c))
    periodic = m.ContextModel(1, {(f, c): even(f, c) for f in range(3) for c in ("", *"ACGT")}, periodic=True)
    gaps = m.ContextModel(1, {(0, ""): m.Model("GAP", (0.3, 0.2)), (0, "N"): m.Model("GAP", (0.2, 0.1)), (0, "-"): m.Model("GAP", (0.8, 0.1)), (0, "."): m.Model("GAP", (0.1, 1.5))})
    dual = m.ContextModel.random(1, "HKY", 0.05, np.random.default_rng(4), dual=True)
    nmer = m.NmerModel.random(2, np.random.default_rng(5)) if hasattr(m.NmerModel, "random") else None
    cases = [("MP", plain), ("TRCO", periodic), ("LCO", periodic), ("LCO", gaps), ("HOG", dual)]
    return cases + ([("NMER", nmer)] if nmer else [])


def test_by_frame_equals_the_sum_of_columns(spark, monkeypatch):
    monkeypatch.setattr(al, "STRETCH", 4)
    tracks = spark.createDataFrame(ROWS, TRACKS)
    for kind, model in context_models():
        each = likelihood.evaluate(tracks, TREE, model, kind, NAMES).collect()
        want = {f: (sum(r.col % 3 == f for r in each), pytest.approx(sum(r.ll for r in each if r.col % 3 == f))) for f in {r.col % 3 for r in each}}
        df = likelihood.evaluate_by_frame(tracks, TREE, model, kind, NAMES)
        got = df.groupBy("frame").agg(F.sum("n").alias("n"), F.sum("total").alias("ll")).collect()
        assert {r.frame: (r.n, r.ll) for r in got} == want, kind
        assert "Generate posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()  # no row for a column


def test_sparse_counts_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 1 << 40, 300) % 997 for _ in range(20)]
    want = dict(zip(*map(list, np.unique(np.concatenate(parts), return_counts=True)), strict=True))
    for dense, coded in ((1 << 22, 1 << 20), (1 << 22, 500), (64, 500)):
        monkeypatch.setattr(al, "DENSE_KEYS", dense)
        monkeypatch.setattr(al, "CODED", coded)
        got = {}
        for keys, n in al.summed_codes(iter(parts), 1000):
            for k, v in zip(keys, n, strict=True):
                got[k] = got.get(k, 0) + v
        assert got == want


def test_batches_of_stretches_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    tracks = spark.range(700).select(F.col("id").alias("block"), F.lit(0).alias("track"), F.lit("ACGT").alias("seq"), F.lit(0).alias("phase"))
    al.site_patterns(tracks, 1, "block").collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= al.BATCH_STRETCHES
    sizes = al.in_batches(tracks.coalesce(1), lambda batches: (b.slice(0, 1) for b in batches), "block long, track int, seq string, phase int").count()
    assert sizes == 3


def test_raised_gaps_of_random_histories(spark):
    from tests.test_engines import raised

    rng = np.random.default_rng(12)
    for _ in range(400):
        history = []
        for op in rng.integers(0, 3, rng.integers(0, 9)):
            if not history or history[-1][0] != op:
                history.append((int(op), int(rng.integers(1, 5))))
        child = sum(n for op, n in history if op != 2)
        gaps = sorted((int(p), int(rng.integers(1, 4))) for p in rng.integers(0, child + 2, rng.integers(0, 6)))
        want = raised(gaps, [("sid"[op], n) for op, n in history])
        got = parsimony.raise_gaps(np.array(gaps, np.int64).reshape(-1, 2), np.array([h[0] for h in history], np.int64), np.array([h[1] for h in history], np.int64))
        assert [tuple(map(int, g)) for g in got] == want, (gaps, history)


def test_runs_and_gaps_of_tracks(spark, monkeypatch):
    monkeypatch.setattr(al, "STRETCH", 4)
    tracks = spark.createDataFrame(ROWS, TRACKS)
    sites = al.wide_sites(tracks, 3)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(parsimony.track_runs(tracks, 0, 1)) == rows(parsimony.indel_runs(sites, "t0", "t1"))
    states = likelihood.pattern_table(spark, NAMES, lambda df: parsimony.fitch(df, TREE, F.col), ["A1"])
    want = parsimony.carried_gaps(parsimony.histories(parsimony.fitch(sites, TREE, F.col), TREE), TREE)
    assert rows(parsimony.gaps_of_tracks(tracks, TREE, NAMES, np.isin(states, list("ACGT")))) == rows(want)


def test_many_runs_of_one_block_in_time():
    n = 200_000  # insertions and gaps: looking at every gap for every run would be 4e10 steps
    op, size = np.tile([0, 1], n), np.ones(2 * n, np.int64)
    gaps = np.stack([np.arange(0, 2 * n, 2), np.ones(n, np.int64)], 1)
    assert len(parsimony.raise_gaps(gaps, op, size)) == 2 * n


def test_filters_counts_and_sums_of_tracks(spark, monkeypatch):
    monkeypatch.setattr(al, "STRETCH", 4)
    monkeypatch.setattr(likelihood, "MARK", 3)
    tracks = spark.createDataFrame(ROWS, TRACKS)
    rows = lambda df: sorted(map(str, df.collect()))
    for rule, keep in ((al.rule_by_count(2), al.by_count(3, 2)), (al.rule_by_species([0, 2]), al.by_species([0, 2]))):
        assert rows(al.kept_tracks(tracks, 3, rule)) == rows(al.to_tracks(al.keep_columns(al.blocks(tracks, 3), keep), 3))
    want = al.combined(tracks, 3).groupBy("track", F.floor(F.col("col") / 5).cast("long").alias("part"), "sym").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))
    assert rows(al.combined_counts(tracks, 3, 5)) == rows(want)
    engine = lambda df: likelihood.pattern_likelihood(df, TREE, m.Model("JC", (0.25,)), F.col)
    table = likelihood.pattern_table(spark, NAMES, engine, ["ll"])[:, 0]
    each = [tuple(r) for r in likelihood.with_likelihood(al.wide_sites(tracks, 3), NAMES, engine).select("block", "col", "ll").collect()]
    asked = [(b, i, j) for b in (0, 4, 6) for i in (-2, 0, 1, 5, 12) for j in (0, 4, 11, 40) if i <= j]
    ranges = spark.createDataFrame(asked, "block long, begin long, end long")
    got = likelihood.track_sums(likelihood.track_index(tracks, 3, table), ranges, table).collect()
    assert {tuple(r[:3]): r.total for r in got} == {(b, i, j): pytest.approx(sum(v for x, c, v in each if x == b and i <= c < j), abs=1e-9) for b, i, j in asked}
