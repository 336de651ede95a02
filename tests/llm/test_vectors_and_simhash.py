"""SimHash, whitening and vector codes against brute force and by hand, on small tables with every edge case."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeframe.llm import simhash, vectorcodes, whitening
from cladeframe.llm.vectors import halves, whole

WHITE = {chr(c) for c in (0x20, 9, 10, 11, 12, 13)}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if c in WHITE else c for c in low).split(" ")


def brute_print(text):
    w = [x for x in words(text) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(ids, linked):
    low = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            if linked(a, b) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


# -- SimHash --------------------------------------------------------------------------------------------------------


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 1 << 23, 500)
    index = simhash.decode(word)
    flips = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 4), replace=False)) for _ in word])
    code = word ^ simhash._ERROR[simhash._syndromes(word)]
    assert (simhash._syndromes(code) == 0).all() and (code >> 11 == index).all()
    assert (simhash.decode(code ^ flips) == index).all()
    assert max(bin(int(x)).count("1") for x in simhash._ERROR) == 3 and len(set(simhash._ERROR.tolist())) == 2048


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    flips = [rng.choice(64, k % 5, replace=False) for k in range(len(one))]
    two = one ^ np.array([sum(1 << int(b) for b in f) for f in flips], np.uint64)
    keys = [set() for _ in range(2 * len(one))]
    found, place = simhash.golay_keys(np.concatenate([one, two]))
    for k, at in zip(found.tolist(), place.tolist(), strict=True):
        keys[at].add(k)
    assert all(keys[k] & keys[k + len(one)] for k in range(len(one)))
    assert len(found) < 35 * 2 * len(one)


def test_simhash_against_brute_force(spark):
    base = [prose(k, 50 + 9 * k) for k in range(6)]
    near = [base[0].split() for _ in range(12)]
    for k, x in enumerate(near):
        x[4 * k] = f"changed{k}"
    texts = [*base, base[1], base[2].upper(), *(" ".join(x) for x in near), None, "", " \n\t ", "one two", "One\vtwo", "ÄB c ÄÉ", prose(9, 30_000)]
    rows = [(k, t, 0.5, "s", 1) for k, t in enumerate(texts)]
    rows += [rows[3], (None, base[0], 0.5, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node double, key string, n int")
    got = simhash.simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    low = reached(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = sorted([(k, f"{prints[k]:016x}", low[k]) for k in prints] + [(3, f"{prints[3]:016x}", low[3])])
    found = [tuple(r) for r in got.collect()]
    assert sorted(r for r in found if r[0] is not None) == want
    assert [r for r in found if r[0] is None] == [(None, f"{prints[0]:016x}", None)]
    assert len(set(low.values())) < len(low) - 5  # it has something to link


def fixed_prints(monkeypatch, prints):
    """Operators whose fingerprints are the texts, as numbers."""
    monkeypatch.setattr(simhash, "_fingerprints", lambda width: _numbers)


def _numbers(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x.as_py()) for x in batch.column(1)], pa.int64())], names=["id", "node"])


@pytest.mark.parametrize(("block", "small"), [(4096, 32), (3, 2)])
def test_links_in_crowded_blocks(spark, monkeypatch, block, small):
    """Clouds of fingerprints around a few centres: chains, several components in one block, chunks of three members."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 3)
    prints = set()
    for c in centres.tolist():
        for _ in range(50):
            prints.add(int(np.int64(c) ^ np.bitwise_or.reduce([np.int64(1) << np.int64(b) for b in rng.choice(30, 6, replace=False)])))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    fixed_prints(monkeypatch, prints)
    docs = spark.createDataFrame([(k, str(p)) for k, p in enumerate(prints)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    mask = (1 << 64) - 1
    assert got == reached(list(range(len(prints))), lambda a, b: ((prints[a] ^ prints[b]) & mask).bit_count() <= 4)


def test_close_rows_across_batches():
    """The kernel's links do not depend on where batches are cut."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = []
    for key in range(6):
        label = rng.integers(0, 9, 40) + 100 * key
        node = rng.integers(0, 1 << 8, 40)
        out = label != label[0]
        rows += [(key, c, bool(c == k % 2), int(node[k]), int(label[k]), bool(out[k])) for k in range(40) for c in range(2) if out[k] or c == k % 2]
    rows.sort(key=lambda r: (r[0], r[1], not r[2]))
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list("kcmnlo"))
    want = {tuple(sorted((x[4], y[4]))) for x, y in itertools.combinations(rows, 2) if x[:2] == y[:2] and x[4] != y[4] and (x[5] or y[5]) and (x[2] or y[2]) and (x[3] ^ y[3]).bit_count() <= 2}
    for size in (1, 7, 33, len(rows)):
        parts = [batch.slice(a, size) for a in range(0, len(rows), size)]
        assert {(a, b) for out in simhash._near(2)(iter(parts)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)} == want


# -- whitening ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int"


def vector_table(spark, d=12, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * np.linspace(3, 0.5, d)).astype(np.float32).tolist()
    rows = [(k, v, (k % 3, None)[k % 5 == 0], "s", 1) for k, v in enumerate(x)]
    rows += [(n, x[0], 1, "s", 1), (n + 1, x[0], None, "s", 1), rows[7], (None, x[3], 2, "s", 1)]
    rows += [(n + 2, None, 1, "s", 1), (n + 3, [None] * d, 1, "s", 1), (n + 4, [float("nan")] + [0.0] * (d - 1), 1, "s", 1), (n + 5, [float("inf")] * d, 1, "s", 1), (n + 6, [1.0], 1, "s", 1), (n + 7, [], 1, "s", 1), (n + 8, [0.0] * d, 1, "s", 1)]
    kept = [r for r in rows if r[1] and len(r[1]) == d and all(c is not None and np.isfinite(c) for c in r[1])]
    return spark.createDataFrame(rows, VECTORS), kept


def test_whitening_against_eigenvectors(spark):
    table, kept = vector_table(spark)
    got = [tuple(r) for r in whitening.whiten(table).collect()]
    x = np.floor(256 * np.array([r[1] for r in kept], np.float32).astype(float))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(0), strict=True)) for row in x]
    white = (x - mean) @ v[:, :4] / np.sqrt(e[:4])
    assert len(got) == 4 * len(kept) and {r[2] for r in got} == {n}
    assert sorted((r[0] is None, r[0], r[1], r[3]) for r in got if r[0] is not None) == sorted((False, r[0], k, f) for r, f in zip(kept, far, strict=True) for k in (1, 2, 3, 4) if r[0] is not None)
    for k in range(4):
        mine = {r[0]: r[4] for r in got if r[1] == k + 1}
        theirs = {r[0]: w for r, w in zip(kept, white[:, k], strict=True)}
        sign = np.sign(mine[1] * theirs[1])
        assert all(abs(mine[i] - sign * theirs[i]) < 1e-9 for i in mine)
        assert all(abs(r[5] - e[k] / e.sum()) < 1e-12 for r in got if r[1] == k + 1)
    assert max(r[6] for r in got) < 1e-10 and len({r[6] for r in got}) == 1


def test_whitening_needs_few_passes_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(6)
    d = 64
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    falling = (rng.standard_normal((600, d)) * 0.7 ** np.arange(d) * 50) @ turn
    flat = rng.standard_normal((600, d))
    for x, block in ((falling, 16), (flat, 64)):
        frame = spark.createDataFrame([(np.floor(256 * r).astype(int).tolist(),) for r in x], "x array<long>")
        fit = whitening.Fit(frame, d, 4)
        v = np.cov(np.floor(256 * x).T, bias=True)
        assert np.abs(v @ fit.components - fit.components * fit.values).max() < 1e-10 * fit.values[0]
        assert np.allclose(fit.values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)
        assert fit.passes < 20, block


def test_whitening_of_little_variance(spark):
    flat = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(flat).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0, 1.0, 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r.component for r in rows} == {1} and abs(sum(r.whitened**2 for r in rows) / 5 - 1) < 1e-12
    assert all(abs(r.explained - 1) < 1e-12 for r in rows)


def test_exact_beyond_longs(spark):
    big = spark.createDataFrame([(k, [float(k * 2**40), -1.5]) for k in range(3)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(big).collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {0} and {r.deviation for r in rows if r.vec_id == 0} == {None}
    x = np.array([-(1 << 62), (1 << 62) + 5, -7])
    assert whole(halves(np.tile(x, (9, 1))).sum(1)).tolist() == [9 * int(v) for v in x]


# -- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(kept, parts=4, entries=256, rounds=4):
    d = len(kept[0][1])
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k]))[:entries]
    cut = [(k * d // parts, (k + 1) * d // parts) for k in range(parts)]
    books = [[x[k][a:b] for k in order] for a, b in cut]

    def near(p, v):
        a, b = cut[p]
        return min((sum((s - t) ** 2 for s, t in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            held = {}
            for v in x:
                held.setdefault(near(p, v)[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    out = []
    for v in x:
        found = [near(p, v) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("d", "n", "entries"), [(12, 400, 256), (10, 60, 256), (8, 300, 7)])
def test_codes_against_brute_force(spark, d, n, entries):
    table, kept = vector_table(spark, d, n)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.compress(table, entries=entries).collect())
    want, digest = brute_codes(kept, entries=entries)
    by = {}
    for r, (_, error) in zip(kept, want, strict=True):
        by[r[2]] = by.get(r[2], 0) + error
    assert got == sorted((r[0] is None, r[0] or 0, code, error, by[r[2]], digest) for r, (code, error) in zip(kept, want, strict=True))


def test_annulus_finds_the_nearest():
    rng = np.random.default_rng(7)
    for scale in (3, 1 << 10, 1 << 40):  # ties, plain, beyond longs
        entries = rng.integers(-scale, scale + 1, (100, 5))
        entries[40:60] = entries[:20]
        x = np.vstack([rng.integers(-scale, scale + 1, (300, 5)), entries, np.zeros((1, 5), np.int64)])
        index, far = vectorcodes.Codebook(entries).nearest(x)
        for v, k, f in zip(x.tolist(), index.tolist(), far.tolist(), strict=True):
            assert (f, k) == min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(entries.tolist()))


def test_empty_vector_and_text_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).count() == 0 and vectorcodes.compress(none).count() == 0
    assert vectorcodes.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    only = spark.createDataFrame([(1, None, 2, "s", 1)], VECTORS)
    assert whitening.whiten(only).count() == 0 and vectorcodes.compress(only).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    one = vectorcodes.compress(spark.createDataFrame([(1, [0.5], 2, "s", 1)], VECTORS)).first()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    assert simhash.simhash_components(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).where(F.col("component_id").isNull()).count() == 1
