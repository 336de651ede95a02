"""The corpus operators against brute force, libraries and edge cases on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bpe, common, html, jaccard, langid, mixing, multiindex, pii, ppm, quality, rules
from cladeframe.llm.common import held_out
from cladeframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, score double, size string, node int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed, n, letters="abcdefghij"):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def corpus():
    base = [prose(k, 60 + 7 * k) for k in range(8)]
    near = base[0].split()
    near[30] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), base[2].upper(), None, "", " \n ", "one two", "one two", "one  TWO", "ha " * 400, prose(99, 6000), "a&b ### $$$ !!! " * 30]
    rows = [(k, t, ("en", "de", None)[k % 3], ("x", "y", None)[k % 3], 0.5, "s", 1) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, "null id text here", "en", "x", 0.1, "s", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_against_brute_force(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in corpus() if r[0] is not None}
    low = {k: k for k in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == {(k, len(s), low[k]) for k, s in sets.items()} | {(None, 1, None)}


def test_jaccard_at_the_threshold(spark, monkeypatch):
    """Chains of copies whose similarity lies about the threshold, common passages in half of all texts, all orders."""
    monkeypatch.setattr(jaccard, "COMMON", 40)
    monkeypatch.setattr(jaccard, "HELD", 500)
    rng = np.random.default_rng(8)
    line, rows = prose(77, 30), []
    for k in range(24):
        w = prose(300 + k, int(rng.integers(5, 60))).split()
        for step in range(int(rng.integers(1, 5))):
            rows.append((len(rows), " ".join(w) + (f" {line}" if k % 2 else ""), f"n{step}"))
            w = w[:]
            w[int(rng.integers(len(w)))] = f"x{step}"
            w = w[: len(w) - int(rng.integers(0, 3))]
    rows += [(500 + k, rows[3][1], "copy") for k in range(20)] + [(3, rows[3][1], "again")]
    sets = [(r[0], shingles(r[1])) for r in rows]
    low = {k: k for k, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if x and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in range(8):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == Counter((k, len(s), low[k]) for k, s in sets)
    known = jaccard.Frequencies(df.select("doc_id", "text"), 5)
    assert 0 < len(known.keys) <= 40
    a, b = (next(iter(common.shingle_sets(jaccard.pa.array([t])))) for t in (line + " end", line + " stop"))
    packed = [np.concatenate(jaccard.other_prefixes(x, 75)).tobytes() for x in (a, b)]
    assert jaccard.meet(*packed) and not jaccard.meet(packed[0], np.concatenate(jaccard.other_prefixes(a + np.uint64(1), 75)).tobytes())


def test_jaccard_large_group_of_near_copies(spark):
    base = prose(5, 100).split()
    rows = []
    for k in range(60):
        w = base[:]
        w[k] = f"new{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, prose(200 + k, 80) + " " + " ".join(base[:20])) for k in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(60)) and all(got[100 + k] == 100 + k for k in range(20))


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    odd = ["a<|endoftext|> b", "x" * 700, "ab" * 90, "I'll  don't\n\n\t1234 ½ 日本語 😀", "\x00\x01", " " * 100, "é" * 200, ""]
    vocabulary = bpe.BytePairs(tokenizer_path())
    for text, ids in zip(odd, vocabulary.encode_batch(odd), strict=True):
        expected = lib.encode(text, add_special_tokens=False).ids
        assert ids == expected and text == vocabulary.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode([-1, 10**9]) == "" and vocabulary.decode(vocabulary.first[[0xC3]]) == lib.decode(vocabulary.first[[0xC3]].tolist(), skip_special_tokens=False)
    for raw in (b"abcdefgh", b"hello world", bytes(range(60))):
        assert vocabulary.merge_rows([raw])[0] == vocabulary.merge_long(raw)
    out = bpe.encode(docs, tokenizer_path()).collect()
    want = Counter()
    for r in corpus():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    back = bpe.decode(docs.sparkSession.createDataFrame(out), tokenizer_path()).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in corpus())


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0


VALID = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": luhn, "phone": lambda x: 9 <= sum(c.isdigit() for c in x) <= 15}


def base_spans(t):
    return [f"{k}:{x.start()}:{x.end()}" for k, p in BASE.items() for x in re.finditer(p, t or "") if VALID[k](x[0])]


def test_pii_against_regular_expressions(spark):
    texts = [
        "mail a.b@c.de_x@y.org, 😀 call +1 (017) 555-7713 or 4111 1111 1111 1111 now", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "\x01@\x02 x@y.z\x01", "4111-1111-1111-1111 +49 30 123456789 4111111111111112",
        None, "", "+1 (017) 555-7713 4111 1111 1111 1111", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" iban DE89 3704 0044 0532 0130 00 end", "a@b..c d@-.- 1.1.1.1" * 50, "9 " * 3000,
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for k, t in enumerate(texts):
        spans = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t, spans, got[k].spans)
        assert [got[k][f"n_{x}"] for x in pii.BASE_KINDS] == [sum(s.startswith(x + ":") for s in spans) for x in pii.BASE_KINDS]
    assert "secret:" in got[7].spans and "iban:" in got[7].spans
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[4] is None and not any(base_spans(t) for t in clean.values() if t)


def test_pii_of_very_many_matches(spark):
    """100,000 matches in one text, at their places, and within a time that a quadratic cost could not keep."""
    import time

    many = " ".join(f"u{k}@x.org" for k in range(100_000))
    df = spark.createDataFrame([(1, many), (2, "é " * 700 + "a@b.c " * 600)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for k, t in ((1, many), (2, "é " * 700 + "a@b.c " * 600)):
        assert got[k].base_sha256 == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    assert pii.redact(df).where("doc_id = 1").first().text == " ".join(["[EMAIL]"] * 100_000)
    assert time.monotonic() - began < 60


def test_pii_clashing_columns_and_leftovers(spark):
    texts = ["4111111111111111.2.3.4.5 x", "+1 (017) 555-7713 4111 1111 1111 1111", "\ufdd2 kept", None, "", "mail a@b.c", "ip 1.2.3.4.5.6.7.8", "999.1.1.1.2.3.4"]
    rows = [(k, t, k, "s", "u", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, _pii int, spans_email string, _clean string, _spans int")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows) * 2
    got = {r.doc_id: r for r in out.collect()}
    assert not any(base_spans(r.text) for r in got.values()) and all(r._pii == k and r.spans_email == "s" and r._spans == 0 for k, r in got.items())
    assert got[2].text == "\ufffd kept" and got[3].text is None and got[4].text == "" and got[5].text == "mail [EMAIL]"
    found = pii.find_pii(df)
    assert set(found.columns) == set(df.columns) | {f"spans_{k}" for k in pii.SCORES} and found.where("doc_id = 5").first().spans_email[0].start == 5


def test_hashes_do_not_depend_on_runs(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Some words, and SOME more", "x" * 300 + " y", "", prose(1, 200)])
    data, bounds = common.text_bytes(texts)
    at = common.words(data, bounds)[:2]
    whole = common.word_hashes(data, *at)
    monkeypatch.setattr(common, "HASHED", 40)
    assert (common.word_hashes(data, *at) == whole).all() and whole[0] == whole[3] and len(set(whole.tolist())) == len({bytes(data[a:b]).lower() for a, b in zip(*at, strict=True)})


def test_rules_against_brute_force(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(docs).collect())
    want = Counter()
    for r in corpus():
        t = r[1] or ""
        w = WORD.findall(t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(win)
        covered = {i + j for i, x in enumerate(win) if seen[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == want


def js(p, q):
    half = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / h) for a, h in zip(x, half) if a > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_rules_verdict_by_hand(spark):
    """Lists, references, distances and verdicts in plain Python; a rare language, none, and texts of junk."""
    rng = np.random.default_rng(6)
    stop = {"aa": ["ba", "du", "ki", "lo"], "bb": ["ne", "po", "ra", "su"]}

    def text(lang, n, k):
        out = []
        for w in prose(k, n).split():
            out += [w, str(rng.choice(stop[lang]))] if lang in stop else [w]
        return " ".join(out)

    rows = [(k, text("aa" if k % 2 else "bb", 60, k), "aa" if k % 2 else "bb", 1, "z") for k in range(40)]
    rows += [(100, text("aa", 60, 100), None, 1, "z"), (101, text("bb", 60, 101), "cc", 1, "z"), (102, prose(102, 90), None, 1, "z"), (103, "#$% " * 80, "aa", 1, "z"), (104, "ABC1 X9Y7 " + prose(104, 60).upper(), "aa", 1, "z"), (105, None, "aa", 1, "z"), (106, text("aa", 10, 106), "bb", 1, "z"), (None, text("bb", 60, 107), "bb", 1, "z")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, n_words int, _used string")
    lists = rules.common_words(df)
    assert all(set(stop[x]) <= set(lists[x]) for x in stop) and all(len(w) <= 4 for v in lists.values() for w in v)

    def shape(t):
        n = [len(re.findall(p, t)) for p in (r"[A-Z]", r"[0-9]", r"\s", r"[.,;:!?'\"()-]", r"[#*$%&|<>]")]
        return [*n, len(t) - sum(n)]

    facts, pooled = {}, {}
    for i, t, lang, *_ in rows:
        w = WORD.findall(t or "")
        uses = {k: sum(x in v for x in w) for k, v in lists.items()}
        best = max(uses, key=lambda k: (uses[k], k))
        lang = lang if lang in lists else best if uses[best] >= 0.1 * len(w) and w else None
        listed = lists.get(lang, [])
        facts[i] = lang, w, shape(t or ""), [*(w.count(x) for x in listed), *[0] * (12 - len(listed)), sum(x not in listed for x in w)]
    base = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, (lang, w, chars, common) in facts.items():
        if len(w) >= 50 and not base[i].base_failed:
            for key in {lang, None}:
                a, b = pooled.setdefault(key, ([0] * 6, [0] * 13))
                pooled[key] = [x + 2 * y for x, y in zip(a, chars)], [x + 2 * y for x, y in zip(b, common)]
    smooth = lambda x: [(v + 1) / (sum(x) + len(x)) for v in x]
    for i, (lang, w, chars, common) in facts.items():
        got = base[i]
        assert got.word_reference == (lang if lang in pooled else None), i
        if not w:
            assert got.base_failed and not got.kept
            continue
        far = js([v / sum(chars) for v in chars], smooth(pooled[lang if lang in pooled else None][0]))
        off = js([v / sum(common) for v in common], smooth(pooled[lang][1])) if lang in pooled and lang else 0.0
        assert got.char_distance == pytest.approx(far) and got.word_distance == pytest.approx(off), i
        assert got.kept == (not got.base_failed and (len(w) < 50 or (far <= rules.MAX_CHAR_DISTANCE and off <= rules.MAX_WORD_DISTANCE)))
    assert base[0].kept and not base[104].kept


def ppm_price(counts, history, symbol):
    """log10 of a symbol's probability by the trie of plain dictionaries: escape method C with exclusion."""
    gone, out = set(), 0.0
    for order in range(4, -1, -1):
        seen = {s: n for s, n in counts.get(history[len(history) - order :], {}).items() if s not in gone}
        if not seen:
            continue
        total, kinds = sum(seen.values()), 0 if len(gone) + len(seen) == 257 else len(seen)
        if symbol in seen:
            return out + math.log10(seen[symbol] / (total + kinds))
        out += math.log10(kinds / (total + kinds))
        gone |= set(seen)
    return out - math.log10(257 - len(gone))


def ppm_symbols(text):
    return tuple(re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode())) + (256,)


def test_partial_matching_against_brute_force(docs, monkeypatch):
    train = ~held_out("doc_id", 10, 0)
    crc = lambda i: zlib.crc32(("null" if i is None else str(i)).encode())
    texts = [(r[0], [*words(r[1]), None], r[1]) for r in corpus()]
    counts = Counter(w for i, t, _ in texts if crc(i) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    trie = {}
    for i, _, text in texts:
        if crc(i) % 10:
            x = (256,) * 4 + ppm_symbols(text)
            for k in range(4, len(x)):
                for order in range(5):
                    seen = trie.setdefault(x[k - order : k], {})
                    seen[x[k]] = seen.get(x[k], 0) + 1
    price = {}
    for block, cut, held in ((64 << 20, 1 << 20, 4_000_000), (3000, 997, 50)):
        monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
        monkeypatch.setattr(ppm, "SLICE", cut)
        monkeypatch.setattr(common, "HELD", held)
        rows = ppm.score(docs.withColumn("n", F.lit(1)).withColumn("block", F.lit("z")), train).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in texts)
        got = {r.doc_id: r for r in rows}
        for i, t, text in texts:
            assert got[i].n_tokens == len(t) and got[i].n_known == sum(counts[w] > 0 for w in t) and got[i].train_tokens == n
            assert got[i].held_out == (crc(i) % 10 == 0)
            assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            x = (256,) * 4 + ppm_symbols(text)
            for k in range(4, len(x)):
                if x[k - 4 : k + 1] not in price:
                    price[x[k - 4 : k + 1]] = ppm_price(trie, x[k - 4 : k], x[k])
            assert got[i].score == pytest.approx(sum(price[x[k - 4 : k + 1]] for k in range(4, len(x))), rel=1e-5), i


def test_partial_matching_without_training(docs):
    rows = ppm.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == pytest.approx(0) and r.held_out for r in rows)
    want = Counter(len(ppm_symbols(r[1])) for r in corpus())
    assert Counter(round(-r.score / math.log10(257)) for r in rows) == want


def test_trie_sums_to_one():
    rng = np.random.default_rng(2)
    pairs = np.zeros((257, 257), np.int64)
    keys = np.unique(rng.integers(0, 257, 3) * 257 * 257 + rng.integers(0, 3, 3) * 257 + rng.integers(0, 257, (400, 3)))
    times = rng.integers(1, 9, len(keys))
    np.add.at(pairs, (5, keys % 257), times)
    pairs[7, 3:50] = 2
    shard = ppm.Shard(9 * 257 + 5, keys.astype(np.uint32), times, pairs)
    for context in [*set((keys // 257).tolist()), 0, 256, 257 * 257 - 1]:
        assert (10 ** shard.prices((context * 257 + np.arange(257)).astype(np.uint32))).sum() == pytest.approx(1)
    table = ppm.Lookup(keys.astype(np.int64), times)
    assert list(table[keys.astype(np.int64)]) == list(times)
    with pytest.raises(RuntimeError):
        table[np.array([10**12])]


def test_language(spark, monkeypatch):
    rows = [(k, prose(k, 80, "abcdefg" if k % 2 else "nopqrst"), "aa" if k % 2 else "bb", "z") for k in range(40)] + [(100, None, "aa", "z"), (101, "123 !", "aa", "z"), (102, "é", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df, ~held_out("doc_id", 4, 2)).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "bb") for k in range(40))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred in ("aa", "bb")
    with pytest.raises(ValueError):
        monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
        langid.learn(df)
    monkeypatch.undo()
    monkeypatch.setattr(langid, "HELD", 50)
    assert {r.doc_id: r for r in langid.identify(df, ~held_out("doc_id", 4, 2)).collect()} == got
    for k in (0, 1, 7):  # rank by rank, in plain Python
        mine, profiles = langid.profile(rows[k][1]), dict(langid.learn(df.where(~held_out("doc_id", 4, 2))))
        apart = {x: sum(abs(p.index(g) - j) if g in p else 300 for j, g in enumerate(mine.tolist())) for x, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        assert (got[k].lang_pred, got[k].score) == (best, pytest.approx(1 - apart[best] / (300 * len(mine))))
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_quality(spark):
    rows = [(k, prose(k, 100) if k % 3 else "WORD!! " * 90) for k in range(300)] + [(900, None), (901, ""), (902, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    got = quality.classify(df, lab, ~held_out("doc_id", 5, 0)).toPandas().set_index("doc_id")
    held = got[got.held_out & (got.index < 300)]
    assert len(held) > 30 and all(held.predicted == [int(k % 3 > 0) for k in held.index]) and got.score.between(0, 1).all()
    assert len(quality.screen(df, lab, ~held_out("doc_id", 5, 0)).collect()) == got.predicted.sum()


def test_quality_scores_by_hand():
    """The forward pass passage by passage in plain Python, long texts included."""
    import pyarrow as pa

    texts = [prose(1, 30), prose(2, 64 * 3 + 5), prose(3, 20_000), "a", "x " * 500]
    model = quality.GatedAttention(seed=3)
    x, owner = quality.passages(pa.array(texts))
    assert list(np.bincount(owner)) == [-(-len(t.split()) // 64) for t in texts]
    got = model.forward(x, np.searchsorted(owner, np.arange(len(texts))))[0]
    tanh, sig, w = math.tanh, lambda v: 1 / (1 + math.exp(-v)), model.w
    for k in range(len(texts)):
        weights, hidden = [], []
        for row in x[owner == k]:
            h = [tanh(float(row @ w["E"][:, j]) + w["e"][j]) for j in range(quality.HIDDEN)]
            raw = sum(w["a"][g] * tanh(sum(h[j] * w["V"][j, g] for j in range(len(h)))) * sig(sum(h[j] * w["U"][j, g] for j in range(len(h)))) for g in range(quality.GATE))
            weights.append(math.exp(raw))
            hidden.append(h)
        z = [sum(a * h[j] for a, h in zip(weights, hidden)) / sum(weights) for j in range(quality.HIDDEN)]
        assert got[k] == pytest.approx(sig(sum(z[j] * w["o"][j] for j in range(len(z))) + w["b"][0]))


def test_quality_sample_and_clashes(spark, monkeypatch):
    """Whole texts are sampled, within both bounds, and repeated ids give no more rows than others."""
    seen = []
    monkeypatch.setattr(quality.GatedAttention, "fit", lambda self, bags, labels, seed=0: seen.append([len(b) for b in bags]))
    rows = [(k, prose(k, 64 * (1 + k % 5)), 1.0, "q") for k in range(40)] + [(1, prose(1, 128), 0.0, "z")] * 30 + [(50, prose(5, 64 * 300), 0.5, "r"), (None, "x", 0.1, "s"), (51, None, 0.1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, y string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(52)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE", 60)
    quality.learn(df, lab)
    assert len(seen[0]) <= 60 and max(seen[0]) in (5, 300)
    monkeypatch.setattr(quality, "PASSAGES", 30)
    quality.learn(df, lab)
    assert sum(seen[1]) <= 30 or len(seen[1]) == 1
    out = quality.classify(df, lab, ~held_out("doc_id", 5, 0))
    assert out.count() == len(rows) and {r.score for r in out.where("doc_id is null or doc_id = 51").collect()} <= {r.score for r in out.collect()}
    kept = quality.screen(df, lab, F.lit(True))
    assert kept.columns == df.columns


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model, x, head, y = quality.GatedAttention(), rng.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5]), np.array([1.0, 0, 1])

    def loss():
        p, _ = model.forward(x, head)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    p, held = model.forward(x, head)
    g = model.gradient(p, y, held, head)
    for k, w in model.w.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_multi_index(spark):
    """Recall with cells left out, exact scores, ties, equal vectors, those that take no part, clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=32)]) for k in range(3000)]
    rows += [(10_000 + k, rows[0][1]) for k in range(30)] + [(5, rows[5][1])]
    bad = [(20_000, None), (20_001, [0.0] * 32), (20_002, [float("nan")] * 32), (20_003, [None] + [1.0] * 31), (None, [1.0] * 32), (20_100, [1.0, 2.0]), (20_200, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, score double, h int, cell int")
    got = multiindex.search(df, F.col("vec_id") % 100 == 0).toPandas()
    x = {k: np.array(v) for k, v in rows}
    queries = [k for k in x if k % 100 == 0]
    assert set(got.query_id) == set(queries) and list(got.columns) == ["query_id", "rank", "vec_id", "score"]
    hit = 0
    for q in queries:
        near = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), k) for k, v in x.items() if k != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and q not in set(mine.vec_id)
        assert list(mine.score) == [float(np.sqrt(((x[q] - x[k]) ** 2).sum())) for k in mine.vec_id]
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        hit += len({k for _, k in near} & set(mine.vec_id))
        if q in (0, 10_000):
            assert list(mine.vec_id) == [k for _, k in near]
    assert 0.9 <= hit / (10 * len(queries)) < 1
    few = multiindex.search(df.where("vec_id < 4"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 3


def scheduled(sizes, block):
    """Words that each source gives, slot by slot: the golden-ratio points in plain Python."""
    goal, total = mixing.targets(sizes, [1 + k % 3 for k in range(len(sizes))]), sum(sizes)
    given, left = [0] * len(sizes), total
    for t in range(-(-total // block)):
        point, at, upto = t * 0.6180339887498949 % 1, 0, goal[0] / total
        while point >= upto and at < len(sizes) - 1:
            at += 1
            upto = sum(goal[: at + 1]) / total
        given[at] += min(block, left)
        left -= block
    return [min(g, 3 * s) for g, s in zip(given, sizes, strict=True)]


def test_mix_against_the_schedule(docs):
    rows = [(k, len(WORD.findall(r[1] or "")), r[3], hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()) for k, r in enumerate(corpus())]
    sources = ["x", "y", None]
    sizes = [sum(n for _, n, s, _ in rows if s == x) for x in sources]
    for block in (64, 7):
        want = []
        for x, size, words in zip(sources, sizes, scheduled(sizes, block), strict=True):
            line = sorted((d, k, n) for k, n, s, d in rows if s == x)
            taken, at = Counter(), 0
            for _, k, n in line * 3:
                taken[k] += max(0, min(n, words - at))
                at += n
            want += [(k, n, size, taken[k]) for _, k, n in line]
            assert abs(words - mixing.targets(sizes, [1, 2, 3])[sources.index(x)]) <= 3 * block
        got = mixing.mix(docs, block=block).select("doc_id", "size", "source_size", "taken").collect()
        ids = [r[0] for r in corpus()]
        # rows of one id and size may swap places
        assert Counter(map(tuple, got)) == Counter((ids[k], n, size, t) for k, n, size, t in want)


def test_mix_targets():
    assert mixing.targets([10, 10, 1000], [1, 2, 3]) == [30.0, 30.0, 960.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 2]) == [0.0, 5.0]
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 9))]
        weights, capped = [1 + k % 3 for k in range(len(sizes))], set()
        while True:  # share and share again, as it is put in words
            left, weight = sum(sizes) - sum(3 * sizes[k] for k in capped), sum(w for k, w in enumerate(weights) if k not in capped)
            out = [3.0 * sizes[k] if k in capped else left * weights[k] / weight for k in range(len(sizes))]
            above = {k for k in range(len(sizes)) if out[k] > 3 * sizes[k]}
            if not above:
                break
            capped |= above
        assert mixing.targets(sizes, weights) == pytest.approx(out)


def test_html(spark):
    page = "<html><body><div>Subscribe to our daily newsletter right now today friends</div><p>%s</p></body></html>"
    rows = [
        (1, "http://a.x/1", page % "one unique text that is here"), (2, "http://a.x/2", page % "two other words &lt;b&gt; are there"), (3, None, None),
        (4, "http://b.x", '<article><p>A<br>b <span class="share">no</span> c<div class="comments"><p>bad</div><p class=ad>ad<p>good&nbsp;x<!-- open <p>z'),
        (5, "http://c.x", '<nav>menu</nav><article><h1>T &amp; x</h1><p><b>One<br><p>two<script>var a="</p>";</script></article><footer>f</footer>'), (6, "", ""),
    ]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("q"))).collect()}
    assert [got[k].text for k in range(1, 7)] == ["one unique text that is here", "two other words <b> are there", "", "A b c good x", "T & x One two", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty_tables(spark, labels):
    d = spark.createDataFrame([], DOCS)
    none = [
        quality.classify(d, labels, ~held_out("doc_id", 5, 0)), multiindex.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0), pii.report(d),
        langid.identify(d, ~held_out("doc_id", 4, 2)), bpe.encode(d, tokenizer_path()), mixing.mix(d), html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        jaccard.jaccard_components(d), rules.judge(d), ppm.score(d, ~held_out("doc_id", 10, 0)),
    ]
    assert [x.count() for x in none] == [0] * 10


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, slot string, score double, _pii int, node int"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert len(corpus_pipeline.STAGES) == 5
    extra = (7, "s", 0.5, 1, 2)
    rows = [(k, prose(k % 30, 100 + k % 30) + f" mail me{k}@x.org" if k % 3 else "WORD!! " * 90, "en", f"s{k % 4}", 0, *extra) for k in range(120)]
    rows += [(1, prose(900, 80), "en", "s1", 0, *extra), (1, prose(901, 80), "en", "s1", 0, *extra), (None, prose(902, 80), None, None, 0, *extra), (None, prose(901, 80), "en", "s1", 0, *extra), (500, None, "en", "s0", None, *extra), (501, "", "en", "s0", 0, *extra)]
    spark.createDataFrame(rows, STAGE_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if not (r[1] or "").startswith("WORD")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    kept = []
    for r in sorted(good, key=key):
        if not any(shingles(x[1]) and 100 * len(shingles(x[1]) & shingles(r[1])) >= 75 * len(shingles(x[1]) | shingles(r[1])) for x in kept):
            kept.append(r)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, df = df, stage(spark, df, str(tmp_path)).cache()
        if n < 4:
            assert df.columns == before.columns and all(tuple(r)[5:] == extra for r in df.collect())
        if n == 0:
            assert Counter((r.doc_id, r.text) for r in df.collect()) == Counter(r[:2] for r in good)
        if n == 1:
            assert Counter((r.doc_id, r.text) for r in df.collect()) == Counter(r[:2] for r in kept)
        if n == 2:
            assert not any(base_spans(r.text) for r in df.collect()) and Counter(r.doc_id for r in df.collect()) == Counter(r[0] for r in kept)
            words_in = {s: sum(len((r.text or "").split()) for r in df.collect() if r.source == s) for s in ("s0", "s1", "s2", "s3", None)}
        if n == 3:
            given = scheduled(list(words_in.values()), 256)
            assert [sum(len(r.text.split()) for r in df.collect() if r.source == s) for s in words_in] == given
            assert all(r.n_chars == len(r.text) for r in df.collect())
        if n == 4:
            lib = Tokenizer.from_file(tokenizer_path())
            want = Counter((r.doc_id, tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
            assert Counter((r.doc_id, tuple(r.ids)) for r in df.collect()) == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], STAGE_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_html_repeats_inside_articles(spark):
    note, own = "Please read our terms before you copy any of this", [prose(700 + k, 40) for k in range(6)]
    rows = [(k, f"http://a.x/{k}", f"<article><p>{own[k]}</p><p>{note}</p></article>") for k in range(4)]
    rows += [(4, "http://b.x/4", f'<h1 class="main">Title</h1><div>{own[4]}</div>'), (5, "http://b.x/5", f"<article>teaser</article><div>{own[5]}</div>")]
    rows += [(6, "http://a.x/mirror", rows[0][2]), (7, "http://c.x/7", rows[1][2]), (8, "http://c.x/8", rows[1][2])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == own[:4] and got[6] == own[0]
    assert got[4] == "Title " + own[4] and got[5] == "teaser " + own[5]
    assert got[7] == got[8] == f"{own[1]} {note}"


def test_html_neighbours_across_batches():
    rows = [(1, 5), (2, 5), (2, 5), (2, 6), (2, 6), (2, 7), (3, 1), (3, 1), (4, 1), (4, 2), (5, 1)]
    want = [x for x in dict.fromkeys(rows) if len({k for s, k in rows if s == x[0]}) > 1]
    for size in range(1, 12):
        table = html.pa.table({"suffix": [s for s, _ in rows], "key": [k for _, k in rows]})
        got = [tuple(r.values()) for b in html._repeated(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert got == want, size


def naive_texts(rows):
    """Every pair of bodies of a host and every pair of their windows compared, without hashes, sorting or samples."""
    out, hosts = {}, {}
    for page_id, url, page in rows:
        parts = html.blocks(page)
        body, aside = ([w for role, t in parts if role == wanted for w in t.split()] for wanted in ("open", "aside"))
        hosts.setdefault(re.sub(r"^https?://(www\\.)?", "", url).split("/")[0], []).append((page_id, body, aside))
    windows = lambda x: {tuple(w.lower() for w in x[i : i + 8]) for i in range(len(x) - 7)}
    for pages in hosts.values():
        bodies = {tuple(b): (windows(b), set()) for _, b, _ in pages}
        for _, b, aside in pages:
            bodies[tuple(b)][1].update(windows(aside))
        names = list(bodies)
        held = Counter(w for mine, _ in bodies.values() for w in mine)
        frame = {w for w, n in held.items() if n > 2 and 2 * n > len(bodies)}
        group = {b: {b} for b in names}
        for a in names:
            for b in names:
                x, y = bodies[a][0] - frame, bodies[b][0] - frame
                if a != b and x & y and 2 * len(x & y) >= min(len(x), len(y)):
                    both = group[a] | group[b]
                    group.update({m: both for m in both})
        for page_id, b, _ in pages:
            gone = set()
            for i in range(len(b) - 7):
                w = tuple(t.lower() for t in b[i : i + 8])
                if any(w in mine or w in side for o in names if o not in group[tuple(b)] for mine, side in [bodies[o]]):
                    gone |= set(range(i, i + 8))
            out[page_id] = " ".join(w for i, w in enumerate(b) if i not in gone)
    return out


def test_html_against_naive_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for host in ("http://one.x", "https://www.two.x", "http://three.x"):
        lines = [prose(int(rng.integers(10**6)), int(rng.integers(6, 30))) for _ in range(6)]
        stories = [prose(int(rng.integers(10**6)), int(rng.integers(0, 120))) for _ in range(9)]
        stories[7] = stories[6] + " and one more word"
        stories[8] = stories[5]
        for k, story in enumerate(stories):
            cut = len(story) // 2
            some = [lines[i] for i in rng.permutation(6)[: rng.integers(0, 4)]]
            parts = [f"<p>{x.title() if rng.random() < 0.3 else x}</p>" for x in [*some[:1], story[:cut], *some[1:2], story[cut:], *some[2:]]]
            rows.append((len(rows), f"{host}/{k}", f"<nav>{lines[0]}</nav><div class='ad'>{lines[int(rng.integers(6))]}</div><article>{''.join(parts)}</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    want = naive_texts(rows)
    plain = {k: " ".join(t for role, t in html.blocks(page) if role == "open") for k, _, page in rows}
    assert got == want and sum(want[k] != plain[k] for k in want) > 8


def test_html_repeats_across_copy_groups(spark):
    frame, own = prose(800, 100), [prose(801 + k, 20) for k in range(6)]
    note, story = "Please read our terms before you copy any of this", prose(900, 70)
    page = "<div>%s</div><p>%s</p>"
    rows = [(k, f"http://short.x/{k}", page % (frame, own[k])) for k in range(6)] + [(6, "http://short.x/copy", page % (frame, own[0]))]
    edits = [f"{story} {prose(910 + k, 30)}" for k in range(2)]
    rows += [(10 + k, f"http://edit.x/{k}", page % (note, edits[k])) for k in range(2)] + [(12 + k, f"http://edit.x/o{k}", page % (note, prose(920 + k, 60))) for k in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(7)] == [*own, own[0]]
    assert [got[10], got[11]] == edits and [got[12 + k] for k in range(3)] == [prose(920 + k, 60) for k in range(3)]


def test_mix_in_slot_order(spark):
    rows = [(k, prose(k, 150 + 37 * (k % 9)), "abc"[0 if k < 20 else 1 if k < 70 else 2], k, k) for k in range(200)]
    df = spark.createDataFrame(rows + [(900, None, "a", 0, 0), (901, " ", "a", 0, 0)], "doc_id long, text string, source string, slot int, row long")
    got = mixing.mixed(df, block=256).toDF("at", "epoch", "first", "last", "doc_id", "text", "source", "slot", "row").collect()
    slots = [r["at"] for r in got]
    assert slots == sorted(slots) and len(set(slots)) > 100
    sizes = [sum(len(t.split()) for _, t, s, *_ in rows if s == x) for x in "abc"]
    given = dict(zip("abc", scheduled(sizes, 256), strict=True))
    goal = dict(zip("abc", mixing.targets(sizes, [1, 2, 3]), strict=True))
    words_of, streams, by_slot = {r[0]: r[1].split() for r in rows}, {x: [] for x in "abc"}, {}
    for r in got:
        assert r.text.split() == words_of[r.doc_id][r.first : r.last] and r.slot == r.row == r.doc_id
        streams[r.source] += r.text.split()
        by_slot.setdefault(r["at"], []).append(r)
    for x in "abc":
        line = [w for k in sorted((r[0] for r in rows if r[2] == x), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()) for w in words_of[k]]
        assert streams[x] == (line * 3)[: given[x]]
    full = [sum(r.last - r.first for r in by_slot[s]) for s in sorted(by_slot)][:-1]
    assert full.count(256) >= len(full) - 2 and max(full) == 256  # a line may end within a slot
    order = [by_slot[s][0].source for s in sorted(by_slot)]
    assert all(len({r.source for r in x}) == 1 for x in by_slot.values())
    for n in (20, 50):
        for a in range(len(order) - n):
            for x in "abc":
                assert abs(order[a : a + n].count(x) - n * goal[x] / sum(goal.values())) <= 3
    assert [r.text for r in mixing.take(df, block=256).collect()] == [r.text for r in got]
