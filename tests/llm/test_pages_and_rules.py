"""Pages with bad markup or telling class names, and quality rules for many languages and scripts without case."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import html, rules


def prose(seed, n, letters="abcdefghij"):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def test_time_is_linear_in_malformed_pages():
    began = time.time()
    pages = ["<div>" * 110_000 + "x</b>" * 110_000, "<div><b>w" * 60_000 + "</i></section>" * 30_000, "<a '" * 200_000, "<" * 1_000_000, "<a " + "b" * 1_000_000, "<!-- " * 200_000, "<textarea>" * 100_000, "<p><li><td>" * 90_000]
    found = [html.blocks(p) for p in pages]
    assert time.time() - began < 20  # about a second for each MB on a slow machine; the square of that would be an hour
    assert found[0] == [("open", "x" * 110_000)]


@pytest.mark.parametrize(
    ("page", "open_", "aside"),
    [
        ('<body class="single has-sidebar header-fixed"><article><p>Main text', ["Main text"], []),
        ('<div class="content no-sidebar"><p>Body here', ["Body here"], []),
        ('<div data-id="menu"><p>Body words.', ["Body words."], []),
        ("<main class=header><p>a b</main><div id='footer'>f</div>", ["a b"], ["f"]),
        ('<div class="page-header"><p>Long text of the page</p><div class=menu>a b</div></div><p>x', ["Long text of the page", "x"], ["a b"]),
        ('<div class="header-wrap"><article>one two three</article></div><div class="sidebar">a b c d e</div>', ["one two three"], ["a b c d e"]),
        ('<article>one two</article><div class="related"><article>three four five six</article></div>', ["one two"], ["three four five six"]),
        ('<div class="comments"><p>a long comment is no main text</p></div><article></article>', [], ["a long comment is no main text"]),
        ('<div class="ad">buy this now</div>', [], ["buy this now"]),
        ("<p>a<script>var x='</p>'</script>b<!-- c --><p hidden class='x y'>d &amp; e", ["ab", "d & e"], []),
    ],
)
def test_containers(page, open_, aside):
    found = html.blocks(page)
    assert [t for role, t in found if role == "open"] == open_ and [t for role, t in found if role == "aside"] == aside


def test_pages_of_every_kind(spark):
    """Null pages and urls, repeated urls and rows, clashing columns, a page of 1 MB without an end tag."""
    long = "<div class='a'>" * 30_000 + "<p>" + prose(1, 60_000)
    rows = [(1, "http://a.x/1", f"<p>{prose(2, 30)}</p>"), (2, "http://a.x/1", f"<p>{prose(3, 30)}</p>"), (2, "http://a.x/1", f"<p>{prose(3, 30)}</p>"), (3, None, None), (4, None, "<p>alone"), (5, "no url", long), (None, "http://a.x/2", "<p>without a number")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "'t' AS text", "2 AS host", "true AS hit", "'g' AS gone", "0 AS size")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id or 0, r.url or "", r.text) for r in got.collect()))
    assert found == sorted([(1, "http://a.x/1", prose(2, 30)), (2, "http://a.x/1", prose(3, 30)), (2, "http://a.x/1", prose(3, 30)), (3, "", ""), (4, "", "alone"), (5, "no url", prose(1, 60_000)), (0, "http://a.x/2", "without a number")])


def test_names_travel_packed():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 33, 5000).astype(np.uint64))
    keys[7] = keys[6]
    assert (html.unpacked(html.packed(keys)) == keys).all() and len(html.packed(np.zeros(0, np.uint64))) < 20
    small, large = html.Names(1000), html.Names(1 << 40)
    assert (small.ranges, large.ranges) == (8, 16) and (small.map, large.map) == (20, 29)
    names = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    assert (large.slot(large.key(names)) == names >> np.uint64(64 - 29)).all()


def test_repeats_need_a_body(spark, monkeypatch):
    """What only set-aside parts share is not looked at; what a menu and a body share goes from the body."""
    menu = "home news about contact prices press jobs help terms"
    rows = [(k, f"http://a.x/{k}", f"<nav>{menu}</nav><p>{prose(20 + k, 40)}</p>") for k in range(5)] + [(9, "http://a.x/9", f"<p>{menu}</p><p>{prose(30, 40)}</p>")]
    for per, held in ((html.PER_RANGE, html.HELD), (1, 10)):
        monkeypatch.setattr(html, "PER_RANGE", per)
        monkeypatch.setattr(html, "HELD", held)
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: prose(20 + k, 40) for k in range(5)} | {9: prose(30, 40)}


DOCS = "doc_id long, text string, lang string, hash int, size int, guess string, used int, chars string, common string, pooled int, _words int"


def test_every_language_has_a_reference(spark):
    """Forty languages, three of them in scripts without case, each with its own list; strangers are held to what fits."""
    scripts = {38: "ابتثجحخدذر", 39: "अआइईउऊएऐ"}
    rng = np.random.default_rng(2)
    lists = {k: ["".join(rng.choice(list(scripts.get(k, "klmnopqrst")), 3)) + (chr(97 + k % 26) if k < 38 else "") for _ in range(6)] for k in range(40)}
    text = lambda k, seed: " ".join(w for x in prose(seed, 70, scripts.get(k, "abcdefghij")).split() for w in (x, str(rng.choice(lists[k]))))
    rows = [(100 * k + j, text(k, 100 * k + j), f"l{k:02}") for k in range(40) for j in range(4)]
    strangers = [(9000 + k, text(k, 9000 + k), None if k % 2 else "other?") for k in (3, 17, 38, 39)]
    strangers[1::2] = [(i, t, None) for i, t, _ in strangers[1::2]]
    rows += strangers + strangers[:1] + [(9900, prose(77, 80, "uvwxyz"), None), (9901, None, None), (9902, "", "l00"), (None, text(5, 1), "l05")]
    df = spark.createDataFrame([(*r, 1, 2, "g", 3, "c", "d", 4, 5) for r in rows], DOCS)
    found = rules.common_words(df)
    assert len(found) >= 40 and all(set(lists[k]) <= set(found[f"l{k:02}"]) for k in range(40))
    got = rules.judge(df.where("lang is null or lang <> 'other?'").unionByName(df.where("lang = 'other?'").withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k in range(40):
        for j in range(4):
            (r,) = by[100 * k + j]
            assert r.word_reference == f"l{k:02}" and r.word_distance > 0 and r.kept
    for i, _, _ in strangers:
        assert {r.word_reference for r in by[i]} == {f"l{i - 9000:02}"} and all(r.kept for r in by[i])
    assert by[9900][0].word_reference is None and by[9900][0].word_distance == 0
    assert by[9901][0].base_failed and by[9902][0].base_failed and by[None][0].word_reference == "l05"


def test_lists_too_long_to_send_are_joined(spark, monkeypatch):
    rows = [(k, f"{prose(k, 60)} {'ka lo mi ' * 12}", ("aa", "bb", None)[k % 3]) for k in range(12)]
    df = spark.createDataFrame([(*r, 1, 2, "g", 3, "c", "d", 4, 5) for r in rows], DOCS)
    want = sorted(map(str, rules.judge(df).collect()))
    monkeypatch.setattr(rules, "SENT", 0)
    assert sorted(map(str, rules.judge(df).collect())) == want


def test_rules_name_clashes(spark):
    rows = [(k, prose(k, 60), "aa") for k in range(4)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(tuple(r) for r in rules.judge(plain).collect())
    odd = plain.toDF("_id_", "_t_", "_l_")
    assert sorted(tuple(r) for r in rules.judge(odd, "_id_", "_t_", "_l_").collect()) == want
    assert len(rules.judge(plain, lang_col=None).collect()) == 4
