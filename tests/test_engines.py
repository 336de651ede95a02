"""Gap patterns, periodic models, parsimony on five leaves and columns in stretches, against plain Python."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import models as m
from cladeframe.operators import alignment as al
from cladeframe.operators import distance, likelihood, parsimony
from cladeframe.operators import tree as tr
from cladeframe.operators.tree import Node, Tree
from cladeframe.sources import formats

TRACKS = "block long, track int, seq string, phase int"
TREE = Tree(Node("t0", [(Node("A1", [(Node("t1"), 0.2), (Node("t2"), 0.3)]), 0.1)]))
LADDER = Tree(Node("r", [(Node("A1", [(Node("A2", [(Node("A3", [(Node("A4", [(Node("l1"), 1.0), (Node("l2"), 1.0)]), 1.0), (Node("l3"), 1.0)]), 1.0), (Node("l4"), 1.0)]), 1.0), (Node("l5"), 1.0)]), 1.0)]))
LEAVES = ["l1", "l2", "l3", "l4", "l5"]
GAPS = m.ContextModel(2, {(0, ""): m.Model("GAP", (0.3, 0.2)), (0, "N"): m.Model("GAP", (0.2, 0.1)), (0, "-"): m.Model("GAP", (0.8, 0.1)), (0, "N-"): m.Model("GAP", (0.9, 0.4)), (0, "."): m.Model("GAP", (0.1, 1.5))})


def enumerated(states, symbols, p_of, missing=()):
    """ln of the sum over the inner node's states; p_of(child) is P of its branch."""
    total = 0.0
    for x in states:
        value = p_of("A1")[states.index(symbols["t0"]), states.index(x)]
        for leaf in ("t1", "t2"):
            if symbols[leaf] not in missing:
                value *= p_of(leaf)[states.index(x), states.index(symbols[leaf])]
        total += value
    return math.log(total) if total else float("-inf")


LENGTH = {"A1": 0.1, "t1": 0.2, "t2": 0.3}


def test_gap_patterns_by_enumeration(spark):
    rows = [(0, 0, "AC-GTAC", 0), (0, 1, "A-.GN", 0), (0, 2, "-CC..AC", 0)]
    got = {r.col: r.ll for r in likelihood.evaluate(spark.createDataFrame(rows, TRACKS), TREE, GAPS, "LCO", ["t0", "t1", "t2"]).collect()}
    state = {f"t{k}": "".join("N" if x in "ACGTN" else "-" if x == "-" else "." for x in seq.ljust(7, "~")) for _, k, seq, _ in rows}
    assert sorted(got) == [0, 1, 3, 4, 5, 6]
    for col in got:
        model = {t: GAPS.lookup(state[t][max(0, col - 2) : col]) for t in state}
        p_of = lambda child: model["t0" if child == "A1" else child].at(LENGTH[child])  # noqa: E731, B023
        want = enumerated("N-.", {t: s[col] for t, s in state.items()}, p_of)
        assert got[col] == pytest.approx(want), col
    plain = m.ContextModel.build(1, lambda f, c: m.Model("JC", (0.25,)))
    both = likelihood.gap_rewriting(spark.createDataFrame(rows, TRACKS), TREE, plain, GAPS, ["t0", "t1", "t2"])
    one = {r.col: r.ll for r in likelihood.evaluate(spark.createDataFrame(rows, TRACKS), TREE, plain, "RCO", ["t0", "t1", "t2"]).collect()}
    assert {r.col: r.ll for r in both.collect()} == {c: pytest.approx(one[c] + got[c]) for c in got}
    with pytest.raises(ValueError):
        likelihood.evaluate(spark.createDataFrame(rows, TRACKS), TREE, GAPS, "RCO", ["t0", "t1", "t2"])


def test_gap_matrix_in_closed_form():
    p = m.Model("GAP", (0.3, 0.2)).at(0.7)
    gone = (1 - math.exp(-0.5 * 0.7)) / 0.5
    assert p.tolist() == [pytest.approx([math.exp(-0.35), 0.3 * gone, 0.2 * gone]), pytest.approx([0, 1, 0]), pytest.approx([0, 0, 1])]


def test_periodic_models_by_enumeration(spark):
    kinds = [lambda c: m.Model("JC", (0.1 + 0.1 * "ACGT".find(c),)) if c else m.Model("JC", (0.25,)), lambda c: m.Model("FEL", (0.3 + 0.1 * len(c),), (0.3, 0.2, 0.2, 0.3)), lambda c: m.Model("KIM", (0.4, 0.1 + 0.1 * len(c)))]
    model = m.ContextModel.build(1, lambda f, c: kinds[f](c), periodic=True)
    rows = [(0, 0, "ACGTA", 1), (0, 1, "AC-TT", 1), (0, 2, "GCGA", 1), (3, 0, "CAT", 2), (3, 1, "CCT", 2), (3, 2, "CA-", 2)]
    text = {(b, f"t{k}"): s.ljust(5, "-") for b, k, s, _ in rows}
    tracks = spark.createDataFrame(rows, TRACKS)
    running = likelihood.running_phase(tracks, 3)
    assert {(r.block, r.phase) for r in running.collect()} == {(0, 0), (3, 2)}
    for df, first in ((tracks, {0: 1, 3: 2}), (running, {0: 0, 3: 2})):
        for kind in ("RCO", "TRCO", "LCO"):
            got = {(r.block, r.col): r.ll for r in likelihood.evaluate(df, TREE, model, kind, ["t0", "t1", "t2"]).collect()}
            assert len(got) == 8
            for (block, col), ll in got.items():
                phase = (first[block] + col) % 3
                before = {t: (text[block, t][col - 1] if col and text[block, t][col - 1] in "ACGT" else "") for t in ("t0", "t1", "t2")}
                used = {"A1": before["t0"]} | {t: {"RCO": "", "TRCO": before["t0"], "LCO": before[t]}[kind] for t in ("t1", "t2")}
                p_of = lambda child: model.lookup(used[child], phase).at(LENGTH[child])  # noqa: E731, B023
                assert ll == pytest.approx(enumerated("ACGT", {t: text[block, t][col] for t in before}, p_of, "-")), (kind, block, col)
    with pytest.raises(ValueError):
        likelihood.evaluate(tracks, TREE, model, "ACO", ["t0", "t1", "t2"])


def by_rule(rule, symbols):
    """The final states of A1..A4: sets up, then from the top, a tie resolved before the next node."""
    bit = lambda x: {x} & set("ACGT")
    sets = {leaf: bit(symbols[leaf]) for leaf in LEAVES}
    kids = {"A4": ("l1", "l2"), "A3": ("A4", "l3"), "A2": ("A3", "l4"), "A1": ("A2", "l5")}
    for x, (a, b) in kids.items():
        sets[x] = (sets[a] & sets[b] or sets[a] | sets[b]) if rule == "fitch" else sets[a] | sets[b]
    final = {symbols["r"]} if rule == "fitch" else set()
    out = {}
    for x in ("A1", "A2", "A3", "A4"):
        s, (a, b) = sets[x], (sets[k] for k in kids[x])
        if rule == "fitch":
            f = s & final
            if f != final:
                f = ((a | b) & final) | s if a & b else s | final
        else:
            f = (a & b) | (final & s)
        final = set(sorted(f, key="ACGTN-.".index)[:1])
        out[x] = next(iter(final), ".")
    return tuple(out.values())


def test_ties_are_resolved_before_descent(spark):
    rows = [("A", *x) for x in product("ACGT", repeat=5)] + [(r, *x) for r in "C-" for x in product("AC-", repeat=5)]
    df = spark.createDataFrame(rows, "r string, l1 string, l2 string, l3 string, l4 string, l5 string")
    for rule, run in (("fitch", parsimony.fitch), ("gain", parsimony.single_gain)):
        for r in run(df, LADDER, F.col).collect():
            assert (r.A1, r.A2, r.A3, r.A4) == by_rule(rule, dict(zip(["r", *LEAVES], r[:6], strict=True))), r
    assert by_rule("fitch", dict(zip(["r", *LEAVES], "ACCGGC", strict=True))) == ("A", "G", "G", "C")


def test_stretches_do_not_show(spark, monkeypatch):
    rows = [(0, 0, "ACGTAC-GT--ACGTTGCA", 1), (0, 1, "AC-TACGG", 1), (0, 2, "A--TACGGACGTACG-T", 1), (4, 0, "GG", 0), (4, 2, "", 0), (5, 1, "", 0)]
    model = m.ContextModel.build(2, lambda f, c: m.Model("JC", (0.1 + 0.05 * sum(map("ACGT".index, c)),)))

    def everything():
        tracks = spark.createDataFrame(rows, TRACKS)
        sites = al.wide_sites(tracks, 3)
        scored = likelihood.evaluate(tracks, TREE, model, "RCO", ["t0", "t1", "t2"])
        one = tracks.select("block", "track", "seq")
        results = [
            sites, al.left_sites(tracks, 3, 3, [0, 1, 2]), al.to_tracks(al.keep_columns(al.blocks(tracks, 3), al.by_count(3, 2)), 3), al.nmers(tracks, 4), al.combined(tracks, 3),
            parsimony.indel_runs(sites, "t0", "t2"), parsimony.indel_runs(sites, "t1", "t0"), al.track_accuracy(one.where("seq <> ''"), one.where("seq <> ''").withColumn("seq", F.translate("seq", "C", "A"))),
            scored.select("block", "col", F.round("ll", 9)), likelihood.prefix_sums(scored).select("block", "col", F.round("cum", 9)), likelihood.cumulative(scored).select("block", "col", F.round("cum", 9)),
        ]
        return [sorted(map(str, r.collect())) for r in results]

    want = everything()
    assert len(want[0]) == 21 and "AC-TACGG" in {r.seq for r in al.to_tracks(al.blocks(spark.createDataFrame(rows, TRACKS), 3), 3).select(F.rtrim(F.translate("seq", "-", " ")).alias("x"), F.substring("seq", 1, 8).alias("seq")).collect()}
    for size in (1, 3, 7):
        monkeypatch.setattr(al, "STRETCH", size)
        for k, (x, y) in enumerate(zip(everything(), want, strict=True)):
            assert x == y, (size, k)


def test_runs_over_the_ends_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(al, "STRETCH", 4)
    rows = [(0, 0, "AAAAAAAAA--AA-----------A", 0), (0, 1, "AAAAAA-AAAA--AA----------", 0)]
    got = sorted(tuple(r)[1:] for r in parsimony.indel_runs(al.wide_sites(spark.createDataFrame(rows, TRACKS), 2), "t0", "t1").collect())
    assert got == [(0, "S", 6), (6, "D", 1), (7, "S", 2), (9, "I", 2), (11, "D", 2), (13, "I", 2), (24, "D", 1)]


def test_patterns_counted_by_stretch(spark, monkeypatch):
    rows = [(0, 0, "ACGT-ACGTN", 1), (0, 1, "AC-TTACG", 1), (3, 1, "ACC", 0)]
    tracks = spark.createDataFrame(rows, TRACKS)
    sites = al.wide_sites(tracks, 2).withColumn("frame", (F.col("col") % 3).cast("int"))
    for size in (8192, 4):
        monkeypatch.setattr(al, "STRETCH", size)
        for by in (None, "block", "frame"):
            keys = [*([by] if by else []), "t0", "t1"]
            want = sorted(tuple(r) for r in al.patterns(sites, keys).collect())
            assert sorted(tuple(r) for r in al.site_patterns(tracks, 2, by).collect()) == want, (size, by)


def test_pairs_of_tracks(spark, monkeypatch):
    rows = [(0, 0, "ACGT-ACGTN", 0), (0, 1, "AC-TTACG", 0), (0, 2, "..GTTAC-TNAC", 0), (5, 1, "AAR", 0), (5, 3, "AC", 0), (9, 2, "A", 0)]
    tracks, names = spark.createDataFrame(rows, TRACKS), ["b", "a", "c", "d"]
    sites = al.patterns(al.wide_sites(tracks, 4).toDF("block", "phase", "col", *names), names)
    for size in (8192, 3):
        monkeypatch.setattr(al, "STRETCH", size)
        for rule in ("nj", "upgma"):
            want = sorted(tuple(r) for r in distance.pair_counts(sites, names, rule).collect())
            assert sorted(tuple(r) for r in distance.track_pairs(tracks, names, rule).collect()) == want, (size, rule)


def test_pairs_of_two_hundred_tracks(spark):
    rng = np.random.default_rng(3)
    grid = rng.choice(list("ACGT-N"), (200, 300))
    rows = [(b, k, "".join(grid[k, 150 * b : 150 * b + 150]), 0) for b in range(2) for k in range(200)]
    names = [f"x{k:03}" for k in range(200)]
    got = {(r.t1, r.t2): (r.matches, r.mismatches) for r in distance.track_pairs(spark.createDataFrame(rows, TRACKS), names).collect()}
    assert len(got) == 19_900
    for i, j in rng.integers(0, 200, (50, 2)):
        if i < j:
            both = (grid[i] != "-") & (grid[j] != "-")
            same = int((both & (grid[i] == grid[j])).sum())
            assert got[names[i], names[j]] == (same, int(both.sum()) - same)


def test_identity_over_intervals(spark, monkeypatch):
    x, y = "ACGT-ACGTNACGTAC", "ACCT-A-GTNTC"
    tracks = spark.createDataFrame([(0, 0, x, 0), (0, 1, y, 0), (7, 1, "AC", 0)], TRACKS)
    asked = [(b, i, j) for b in (0, 7, 8) for i in (-3, -1, 0, 4, 9, 30) for j in (0, 5, 11, 15, 99) if i <= j]
    intervals = spark.createDataFrame([*asked, asked[0]], "block long, begin long, end long")
    want = {}
    for b, i, j in asked:
        if b != 8:
            n = [k for k in range(max(0, i + 1), min(j, 15 if b == 0 else 1) + 1) if b == 0 and k < len(y) and x[k] != "-" and y[k] != "-"]
            m = sum(x[k] == y[k] for k in n)
            want[b, i, j] = (m, len(n), pytest.approx(m / len(n)) if n else None)
    for size in (8192, 5):
        monkeypatch.setattr(al, "STRETCH", size)
        got = {tuple(r[:3]): tuple(r[3:]) for r in al.interval_identity(tracks, 0, 1, intervals).collect()}
        assert got == want, size


def test_maf_as_others_write_it(spark, tmp_path):
    text = "##maf version=1 scoring=x\r\n# made by hand\r\n\r\na score=2.0 phase=2\r\ns hg.chr1\t10 4 + 99\tAC-gt\r\ns\tmm.chr2 7 3 - 50 A-.gn\r\nq hg.chr1 99\r\n\r\n\r\na score=1\r\ns hg.chr1 14 2 + 99 AC\r\n\r\ns rn.chr3 x 2 + 99 GG\r\n\r\na score=0\r\n"
    (tmp_path / "one.maf").write_bytes(text.encode())
    got = formats.read_maf(spark, str(tmp_path / "one.maf")).orderBy("block", "track").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, "hg.chr1", "AC-GT", 2, 10, 4, "+", 99), (1, "mm.chr2", "A-.GN", 2, 7, 3, "-", 50), (0, "hg.chr1", "AC", 0, 14, 2, "+", 99), (0, "rn.chr3", "GG", 0, None, 2, "+", 99),
    ]
    assert [r.block for r in got] == sorted(r.block for r in got) and len({r.block for r in got}) == 3
    formats.write_maf(spark.createDataFrame(got), str(tmp_path / "again"))
    again = formats.read_maf(spark, str(tmp_path / "again")).orderBy("block", "track").collect()
    assert [tuple(r)[1:] for r in again[:3]] == [tuple(r)[1:] for r in got[:3]] and tuple(again[3])[2:4] == ("rn.chr3", "GG") and again[3].begin == 0
    (tmp_path / "plain.maf").write_text("a\ns x 0 1 + 1 A\n\na phase=1\ns x 1 1 + 1 C")
    assert [(r.seq, r.phase) for r in formats.read_maf(spark, str(tmp_path / "plain.maf")).orderBy("block").collect()] == [("A", 0), ("C", 1)]


def test_distance_file_and_branch_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.25), ("b", "c", 0.5)], "t1 string, t2 string, d double")
    formats.write_matrix(df, ["a", "b", "c"], str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("part-*")
    assert part.read_text().splitlines() == ["\ta\tb\tc", "a\t0.0\t0.25\tnan", "b\t0.25\t0.0\t0.5", "c\tnan\t0.5\t0.0"]
    assert tr.branch_ids(LADDER)[:4] == [(0, "r", "A1"), (1, "A1", "A2"), (2, "A2", "A3"), (3, "A3", "A4")] and len(tr.branch_ids(LADDER)) == 9


def test_clades_of_many_nodes(spark):
    node = Node("l0")
    for k in range(1, 40):
        node = Node(f"n{k}", [(node, 1.0), (Node(f"l{k}"), 1.0)])
    tree = Tree(node)
    got = {r.name: r.members for r in tr.clades(tree.table(spark)).collect()}
    assert len(got) == 79 and sorted(got["n39"]) == got["n39"] == list(range(79)) and len(got["n5"]) == 11 and len(got["l3"]) == 1


def raised(gaps, history):
    """Gaps of a child walked into the parent's coordinates, one residue of the child at a time."""
    out, child, parent, part = [], 0, 0, 0

    def close():
        nonlocal part
        if part:
            out.append((parent, part))
        part = 0

    for op, n in history:
        for _ in range(n):
            here = [g for g in gaps if g[0] == child] if op != "d" else []
            if here:
                close()
                out.extend((parent, size) for _, size in here)
            if op == "i":
                part, child = part + 1, child + 1
            else:
                close()
                parent, child = parent + 1, child + (op == "s")
        close()
    return out + [(parent, size) for at, size in gaps if at >= child]


def test_gaps_carried_up_a_tree(spark):
    rng = np.random.default_rng(8)
    names = [x.name for x in LADDER.nodes]
    rows = [(b, c, *rng.choice(list("AC-"), len(names), p=[0.4, 0.25, 0.35]).tolist()) for b in range(25) for c in range(14)]
    rows += [(99, c, *("A" if n == "r" else "-" for n in names)) for c in range(3)]
    sites = spark.createDataFrame(rows, ["block", "col", *names])
    got = {r.block: [tuple(g) for g in r.gaps] for r in parsimony.carried_gaps(parsimony.histories(sites, LADDER), LADDER).collect()}

    def history(block, a, b):
        ops = []
        for r in rows:
            if r[0] == block:
                x, y = (r[2 + names.index(n)] != "-" for n in (a, b))
                op = "s" if x and y else "i" if y else "d" if x else ""
                if op and ops and ops[-1][0] == op:
                    ops[-1] = (op, ops[-1][1] + 1)
                elif op:
                    ops.append((op, 1))
        return ops

    def below(block, x):
        found = []
        for c, _ in x.children:
            found = sorted([*found, *raised(below(block, c), history(block, x.name, c.name))], key=lambda g: g[0])
        return found

    assert got == {b: below(b, LADDER.root) for b in {r[0] for r in rows}} and sum(map(len, got.values())) > 100


def test_tables_of_nmers_symbol_by_symbol():
    rng = np.random.default_rng(9)
    for dual in (False, True):
        model = m.ContextModel.random(2, "HKY", 0.05, rng, dual=dual)
        table = m.context_nmers(model, 3, 0.4)
        names = m.contexts(3)
        for i, j in rng.integers(0, 64, (40, 2)):
            a, b, want = names[i], names[j], 1.0
            for k in range(3):
                found = model.lookup_dual(a[:k], b[:k]) if dual else model.lookup(a[:k])
                want *= found.at(0.4)["ACGT".index(a[k]), "ACGT".index(b[k])]
            assert table[i, j] == pytest.approx(want)
        assert table.sum(1) == pytest.approx(np.ones(64))
    with pytest.raises(ValueError):
        m.context_nmers(model, 7, 0.1)


def test_prefix_index(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(b, c, float(rng.normal())) for b, n in ((0, 23), (3, 1), (7, 40)) for c in range(n) if (rng.random() < 0.8 and not 8 <= c < 20) or n == 1]
    asked = [(b, i, j) for b in (0, 3, 7, 9) for i in (-4, 0, 1, 8, 25) for j in (0, 1, 9, 24, 60) if i <= j]
    columns = spark.createDataFrame(rows, "block long, col int, ll double")
    ranges = spark.createDataFrame([*asked, asked[3]], "block long, begin long, end long")
    for size in (8192, 4):
        monkeypatch.setattr(al, "STRETCH", size)
        index = likelihood.prefix_index(columns)
        index.orderBy("block", "stretch").write.parquet(str(tmp_path / str(size)))
        got = {tuple(r[:3]): r.total for r in likelihood.indexed_sums(spark.read.parquet(str(tmp_path / str(size))), ranges).collect()}
        assert got == {(b, i, j): pytest.approx(sum(v for x, c, v in rows if x == b and i <= c < j), abs=1e-9) for b, i, j in asked if b != 9}, size
