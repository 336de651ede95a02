"""Texts become tracks in numpy, once for each text, as the expressions of the SQL have them."""

import pyarrow as pa
from pyspark.sql import functions as F

from cladeframe import queries as q
from cladeframe.operators import alignment as al
from cladeframe.operators import likelihood
from cladeframe.plans.views import LETTERS, MAPPED, symbols, tracks_of

ODD = ["", "a", "Zz\r\n\t!", "naïve café", "Kİx", "日本 text 😀😀 end", "\u0000\u007f\u0080", "ΣΣ ΑΣ", None, "ACGT-acgt", "x" * 20_000 + "é" + "b" * 10]


def test_symbols_are_those_of_the_expressions(spark):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)] + [(None, "lost")], "doc_id long, text string")
    plain = F.regexp_replace(F.translate(F.lower("text"), LETTERS, MAPPED), "[^ACGT]", "-")
    want = {(r.doc_id // 4, r.doc_id % 4): r.seq for r in docs.where("text is not null and doc_id is not null").select("doc_id", plain.alias("seq")).collect()}
    got = {(r.block, r.track): r.seq for r in tracks_of(docs).collect()}
    assert got == want


def test_symbols_of_a_slice_of_a_batch():
    texts = pa.array(["ab", "é c", "", "zz"])
    assert symbols(texts.slice(1, 2)).to_pylist() == ["--G", ""]
    assert symbols(texts.slice(0, 0)).to_pylist() == []


def test_letters_are_mapped_once_and_in_numpy(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(8)], "doc_id long, text string")
    for df in (al.pieces(tracks_of(docs)), likelihood.evaluate_by_frame(tracks_of(docs), q.TREE, q.GAP_CONTEXTS, "LCO", q.NAMES)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "translate(" not in plan
        assert plan.count("ArrowEvalPython") == 1
    # blocks and tracks alone need no symbols
    assert "ArrowEvalPython" not in tracks_of(docs).select("block", "track")._jdf.queryExecution().optimizedPlan().toString()
