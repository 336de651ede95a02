"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cladeframe.llm import bpe, html, jaccard, langid, mixing, multiindex, pii, ppm, quality, rules, simhash, vectorcodes, whitening
from cladeframe.llm.common import held_out, read


def tokenizer_path() -> str:
    """CLADEFRAME_TOKENIZER, or the byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return os.environ.get("CLADEFRAME_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), ~held_out("doc_id", 5, 0))


def multi_index(spark, sf_dir):
    return multiindex.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def personal_data(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def language_profiles(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), ~held_out("doc_id", 4, 2))


def byte_pairs(spark, sf_dir):
    return bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), with_ids=False)


def source_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def main_text(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def quality_rules(spark, sf_dir):
    return rules.judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def matching_score(spark, sf_dir):
    return ppm.score(read(spark, sf_dir, "documents", "doc_id", "text"), ~held_out("doc_id", 10, 0))


def simhash_join(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def whitened(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def vector_codes(spark, sf_dir):
    return vectorcodes.compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports from here

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_attention_quality": quality_classifier,
    "op2_inverted_multi_index": multi_index,
    "op3_checked_pii": personal_data,
    "op4_rank_order_language": language_profiles,
    "op5_segment_tree_bpe": byte_pairs,
    "op6_low_discrepancy_mix": source_mix,
    "op7_host_suffix_html": main_text,
    "op8_multi_order_jaccard": jaccard_join,
    "op9_divergence_rules": quality_rules,
    "op10_partial_matching": matching_score,
    "op11_golay_simhash": simhash_join,
    "op12_subspace_whitening": whitened,
    "op13_annular_codes": vector_codes,
    "pipeline": pipeline,
}

def _crc32(text: str) -> str:
    """crc32 of a text of ASCII as SQL: the table by its rule, then a byte at a time."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    each = f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {each}), lambda c, b: xor(CAST({table} AS BIGINT[])[(xor(c, b) & 255) + 1], c >> 8)))"


#: Profiles and out-of-place distances over character n-grams as tables.
_LANGUAGE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_crc32("coalesce(CAST(doc_id AS VARCHAR), 'null')")} % 4 = 2 AS held_out, ' ' || trim(regexp_replace(lower(text), '\P{{L}}+', ' ', 'g')) || ' ' AS t,
         text IS NOT NULL AND regexp_matches(text, '\p{{L}}') AS lettered
  FROM documents),
places AS (SELECT row, CASE WHEN NOT held_out THEN lang END AS lang, unnest(string_split(t, '')) AS s, unnest(range(1, length(t) + 1)) AS i, length(t) AS n FROM d WHERE lettered),
codes AS (SELECT row, lang, i, n - i AS rest, CAST(unicode(s) AS BIGINT) AS x FROM places),
c AS (SELECT row, lang, rest, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM codes WINDOW w AS (PARTITION BY row ORDER BY i)),
grams AS (SELECT row, lang, x AS g FROM c WHERE x <> 32 UNION ALL SELECT row, lang, x * 2097152 + y FROM c WHERE rest >= 1 UNION ALL SELECT row, lang, (x * 2097152 + y) * 2097152 + z FROM c WHERE rest >= 2),
counts AS (SELECT row, any_value(lang) AS lang, g, count(*) AS n FROM grams GROUP BY row, g),
mine AS (SELECT row, g, row_number() OVER (PARTITION BY row ORDER BY n DESC, g) - 1 AS rank FROM counts QUALIFY rank < 300),
theirs AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS rank FROM counts WHERE lang IS NOT NULL GROUP BY lang, g QUALIFY rank < 300),
far AS (SELECT m.row, l.lang, CAST(sum(coalesce(abs(t.rank - m.rank), 300)) AS BIGINT) AS apart, count(*) AS n
        FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM theirs) l LEFT JOIN theirs t ON t.lang = l.lang AND t.g = m.g GROUP BY m.row, l.lang),
best AS (SELECT row, lang, 1e0 - CAST(apart AS DOUBLE) / CAST(300 * n AS DOUBLE) AS score FROM far QUALIFY row_number() OVER (PARTITION BY row ORDER BY apart, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0e0) AS score FROM d LEFT JOIN best ON best.row = d.row
"""

_MIX_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sized AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, CASE WHEN k = 'n' THEN 1 ELSE 0 END AS last FROM docs GROUP BY k),
weighed AS (SELECT k, s, 1 + (row_number() OVER (ORDER BY last, encode(k)) - 1) % 3 AS w FROM sized),
ratio AS (SELECT *, row_number() OVER (ORDER BY 3.0e0 * s / w, k) AS nth FROM weighed),
capped AS (
  SELECT r.nth, (SELECT coalesce(sum(3 * x.s), 0) FROM ratio x WHERE x.nth < r.nth) AS before,
         (SELECT sum(x.w) FROM ratio x WHERE x.nth >= r.nth) AS rest, r.s, r.w, (SELECT sum(s) FROM ratio) AS total
  FROM ratio r),
first_free AS (SELECT min(nth) AS nth FROM capped WHERE (total - before) * w <= 3 * s * rest),
goal AS (
  SELECT r.k, r.s AS source_size, row_number() OVER (ORDER BY r.k = 'n', encode(r.k)) AS pos, c.total,
         CASE WHEN r.nth < f.nth THEN CAST(3 * r.s AS DOUBLE) ELSE CAST((c.total - c.before) * r.w AS DOUBLE) / CAST(c.rest AS DOUBLE) END AS target
  FROM ratio r, first_free f JOIN capped c ON c.nth = f.nth),
ends AS (SELECT *, lead(0e0, 1, NULL) OVER (ORDER BY pos) AS more, sum(target) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) / total AS upto FROM goal),
spans AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY pos), 0e0) AS low, CASE WHEN more IS NULL THEN 2e0 ELSE upto END AS high, (total + 63) // 64 AS n FROM ends),
points AS (SELECT t, (t % 67108864) * 0.6180339887498949e0 AS x, (t // 67108864) * (67108864 * 0.6180339887498949e0 - floor(67108864 * 0.6180339887498949e0)) AS y
           FROM range((SELECT CAST(max(n) AS BIGINT) FROM spans)) slots(t)),
slots AS (SELECT t, (x - floor(x)) + (y - floor(y)) AS z FROM points),
held AS (SELECT k, count(*) * 64 - CASE WHEN max(t) = any_value(n) - 1 THEN any_value(n * 64 - total) ELSE 0 END AS held
         FROM slots JOIN spans ON z - floor(z) >= low AND z - floor(z) < high GROUP BY k),
laid AS (
  SELECT d.*, g.source_size, g.target, CAST(least(coalesce(h.held, 0), 3 * g.source_size) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY d.k ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM docs d JOIN goal g ON d.k = g.k LEFT JOIN held h ON h.k = g.k)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
FROM laid
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS g FROM sets),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON r.other = t.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""

def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Codebooks by rounds over tables of parts and entries; every distance by the sum of squares, all entries compared."""
    piece = f"list_slice(x, p * len(x) // {parts} + 1, (p + 1) * len(x) // {parts})"
    apart = "list_sum(list_transform(range(1, len(v.y) + 1), lambda i: (v.y[i] - b.y[i]) * (v.y[i] - b.y[i])))"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
             FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        k AS (SELECT * FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY len(x) ORDER BY count(*) DESC, len(x) LIMIT 1)),
        cut AS MATERIALIZED (SELECT row, p, {piece} AS y FROM k, range({parts}) q(p)),
        b0 AS MATERIALIZED (SELECT p, e, {piece} AS y FROM (SELECT x, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM k ORDER BY e LIMIT {entries}), range({parts}) q(p))"""
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT v.row, v.p, min(CAST({apart} AS BIGINT) * 256 + b.e) AS near FROM cut v JOIN b{k} b ON b.p = v.p GROUP BY v.row, v.p)")
        if k < rounds:
            mean = f"SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS y FROM (SELECT v.p, near % 256 AS e, i, CAST(sum(v.y[i]) AS BIGINT) AS s, count(*) AS n FROM cut v JOIN a{k} a ON a.row = v.row AND a.p = v.p, range(1, len(v.y) + 1) r(i) GROUP BY v.p, near % 256, i) GROUP BY p, e"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN ({mean}) m ON m.p = b.p AND m.e = b.e)")
    codes = f"SELECT row, string_agg(printf('%02x', near % 256), '' ORDER BY p) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY row"
    digest = f"SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{rounds}"
    return f"WITH {', '.join(steps)} SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({digest}) AS codebooks_sha256 FROM k JOIN ({codes}) c ON c.row = k.row"


def _xxh64_sql(seed: int = 42) -> str:
    """XXH64 of n bytes as SQL, from the columns n, lanes (numbers of eight bytes), four (the number of four bytes that may
    follow) and ones (the bytes after those), in arithmetic modulo 2^64 on wider numbers."""
    # fixed values: the primes of the hash, and its shifts
    primes = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    one, two, three, four, five = (f"{p}::UHUGEINT" for p in primes)
    top = f"{1 << 64}::UHUGEINT"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"  # noqa: E731
    turn = lambda v, k: f"(({v} * {1 << k}::UHUGEINT) % {top} + {v} // {1 << 64 - k}::UHUGEINT)"  # noqa: E731
    times = lambda a, b: f"(({a}) * {b}) % {top}"  # noqa: E731
    either = lambda a, b: f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))::UHUGEINT"  # noqa: E731
    own = lambda v: let(times(v, two), "y", times(turn("y", 31), one))  # noqa: E731
    fold = lambda start, items, body: f"list_reduce(list_prepend({start}, {items}), lambda acc, x: {body})"  # noqa: E731

    def lane(k: int, start: int) -> str:
        return fold(f"{start % (1 << 64)}::UHUGEINT", f"list_transform(range(0, n // 32), lambda s: lanes[4 * s + {k + 1}])", let(f"(acc + (x * {two}) % {top}) % {top}", "v", times(turn("v", 31), one)))

    lanes = [lane(k, start) for k, start in enumerate((seed + primes[0] + primes[1], seed + primes[1], seed, seed - primes[0]))]
    met = "(" + " + ".join(turn(f"v[{k + 1}]", r) for k, r in enumerate((1, 7, 12, 18))) + f") % {top}"
    long = let(f"[{', '.join(lanes)}]", "v", let(met, "h", fold("h", "v", f"(({either('acc', own('x'))}) * {one} + {four}) % {top}")))
    out = f"((CASE WHEN n >= 32 THEN {long} ELSE {(seed + primes[4]) % (1 << 64)}::UHUGEINT END) + n::UHUGEINT) % {top}"
    out = fold(out, "list_slice(lanes, 4 * (n // 32) + 1, len(lanes))", let(either("acc", own("x")), "z", f"({turn('z', 27)} * {one} + {four}) % {top}"))
    out = fold(out, "four", let(either("acc", times("x", one)), "z", f"({turn('z', 23)} * {two} + {three}) % {top}"))
    out = fold(out, "ones", let(either("acc", times("x", five)), "z", times(turn("z", 11), one)))
    for k, (shift, prime) in enumerate(((33, two), (29, three), (32, None))):
        mixed = f"({either(f'a{k}', f'a{k} // {1 << shift}::UHUGEINT')})"
        out = let(out, f"a{k}", f"{mixed} * {prime} % {top}" if prime else mixed)
    return f"CAST({out} AS UBIGINT)"


def _bytes_sql(at: str, size: str) -> str:
    """The number of `size` bytes, lowest first, from byte `at` of the hexadecimal text x."""
    digit = lambda k: f"strpos('0123456789ABCDEF', substr(x, 2 * ({at} + i) + {k}, 1)) - 1"  # noqa: E731
    return f"CAST(list_sum(list_transform(range(0, {size}), lambda i: CAST(({digit(1)}) * 16 + {digit(2)} AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(8 * i AS HUGEINT)))) AS UHUGEINT)"


_SIMHASH_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT row, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
u AS (SELECT g, hex(g) AS x, length(hex(g)) // 2 AS n FROM (SELECT DISTINCT g FROM g)),
cut AS (SELECT g, n, list_transform(range(0, n // 8), lambda j: {_bytes_sql("8 * j", "8")}) AS lanes, CASE WHEN n % 8 >= 4 THEN [{_bytes_sql("8 * (n // 8)", "4")}] ELSE CAST([] AS UHUGEINT[]) END AS four,
        list_transform(range(n - n % 4, n), lambda j: {_bytes_sql("j", "1")}) AS ones FROM u),
h AS MATERIALIZED (SELECT g, {_xxh64_sql()} AS h FROM cut),
ones AS (SELECT row, count(*) AS n, {", ".join(f"sum(CAST((h >> {b}) & 1 AS INTEGER)) AS b{b}" for b in range(64))} FROM g JOIN h USING (g) GROUP BY row),
p AS MATERIALIZED (SELECT d.doc_id, CAST(coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))}, 0::UHUGEINT) AS UBIGINT) AS f FROM d LEFT JOIN ones ON ones.row = d.row),
n AS MATERIALIZED (SELECT f, min(doc_id) AS rep FROM p WHERE doc_id IS NOT NULL GROUP BY f),
l AS MATERIALIZED (SELECT x.f AS a, y.f AS b FROM n x JOIN n y ON x.f <> y.f AND bit_count(CAST(xor(x.f, y.f) AS UHUGEINT)::HUGEINT) <= 4),
r AS (SELECT f, rep AS other, f AS at FROM n UNION SELECT r.f, n.rep, n.f FROM r JOIN l ON r.at = l.a JOIN n ON n.f = l.b)
SELECT doc_id, lpad(lower(to_hex(p.f)), 16, '0') AS fingerprint, CASE WHEN doc_id IS NOT NULL THEN c.component_id END AS component_id
FROM p LEFT JOIN (SELECT f, min(other) AS component_id FROM r GROUP BY f) c ON c.f = p.f
"""

ORACLES = {"op4_rank_order_language": _LANGUAGE_SQL, "op6_low_discrepancy_mix": _MIX_SQL, "op8_multi_order_jaccard": _JACCARD_SQL, "op11_golay_simhash": _SIMHASH_SQL, "op13_annular_codes": _codes_sql()}
