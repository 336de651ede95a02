"""Columns are read, laid out and counted once for all that is scored of them."""

import pytest
from pyspark.sql import functions as F

from cladeframe import queries as q
from cladeframe.functions import models as m
from cladeframe.operators import alignment as al
from cladeframe.operators import likelihood
from cladeframe.plans.views import LETTERS, MAPPED, tracks_of
from tests.test_counted_columns import NAMES, ROWS, TRACKS, TREE


def test_every_character_becomes_the_symbol_of_its_lower_case(spark):
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    docs = spark.createDataFrame([(k, every[at : at + 4096]) for k, at in enumerate(range(0, len(every), 4096))], "doc_id long, text string")
    plain = docs.select("doc_id", F.regexp_replace(F.translate(F.lower("text"), LETTERS, MAPPED), "[^ACGT]", "-").alias("want"))
    got = tracks_of(docs).select((F.col("block") * 4 + F.col("track")).alias("doc_id"), "seq")
    assert plain.join(got, "doc_id").where("want = seq").count() == docs.count()
    assert "lower(" not in tracks_of(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_the_composite_reads_and_counts_the_columns_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words here") for k in range(8)], "doc_id long, text string")
    for df in (likelihood.gap_rewriting_by_frame(tracks_of(docs), q.TREE, q.CONTEXTS, q.GAP_CONTEXTS, q.NAMES), likelihood.evaluate_by_frame(tracks_of(docs), q.TREE, q.GAP_CONTEXTS, "LCO", q.NAMES)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "rpad(" not in plan
    monkeypatch.setattr(al, "STRETCH", 4)
    gaps = m.ContextModel(1, {(0, ""): m.Model("GAP", (0.3, 0.2)), (0, "N"): m.Model("GAP", (0.2, 0.1)), (0, "-"): m.Model("GAP", (0.8, 0.1)), (0, "."): m.Model("GAP", (0.1, 1.5))})
    bases = m.ContextModel.build(2, lambda f, c: m.Model("JC", (0.1 + 0.04 * sum(map("ACGT".index, c)),)))  # looks back farther
    tracks = spark.createDataFrame(ROWS, TRACKS)
    each = likelihood.gap_rewriting(tracks, TREE, bases, gaps, NAMES).groupBy((F.col("col") % 3).alias("frame")).agg(F.count("*").alias("n"), F.sum("ll").alias("ll")).collect()
    df = likelihood.gap_rewriting_by_frame(tracks, TREE, bases, gaps, NAMES)
    assert {r.frame: (r.n, r.ll) for r in df.groupBy("frame").agg(F.sum("n").alias("n"), F.sum("total").alias("ll")).collect()} == {r.frame: (r.n, pytest.approx(r.ll)) for r in each}
    # too many patterns to be scored unseen: those that occur are, with the same sums
    monkeypatch.setattr(likelihood, "TABULATED", 30)
    df = likelihood.gap_rewriting_by_frame(tracks, TREE, m.ContextModel(0, {(0, ""): m.Model("JC", (0.2,))}), gaps, NAMES)
    assert df.agg(F.sum("n")).first()[0] == sum(r.n for r in each)
