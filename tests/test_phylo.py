"""Fixtures with known values, properties of models and trees, and brute force on small trees."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import models as m
from cladeframe.operators import alignment as al
from cladeframe.operators import distance, likelihood, parsimony, training
from cladeframe.operators import tree as tr
from cladeframe.operators.tree import Node, Tree
from cladeframe.sources import formats

EQ = (0.3, 0.2, 0.2, 0.3)
LL_TREE = Tree(Node("t0", [(Node("A1", [(Node("t1"), 0.2), (Node("t2"), 0.3)]), 0.1)]))
ROWS = [(0, 0, "ACGTAC", 0), (0, 1, "ACGTTC", 0), (0, 2, "ACG-AC", 0)]
HKY = m.Model("HKY", (0.4, 0.2), EQ)
JC = m.Model("JC", (0.25,))


@pytest.fixture(scope="module")
def sites(spark):
    return al.wide_sites(spark.createDataFrame(ROWS, "block long, track int, seq string, phase int"), 3)


@pytest.mark.parametrize(
    "model, row",
    [
        (JC, [0.805613666, 0.064795445, 0.064795445, 0.064795445]),
        (m.Model("FEL", (0.5,), EQ), [0.902495583, 0.027858405, 0.027858405, 0.041787607]),
        (m.Model("KIM", (0.4, 0.2)), [0.754217699, 0.064739875, 0.116302550, 0.064739875]),
        (HKY, [0.935823074, 0.014437386, 0.028083461, 0.021656079]),
        (m.Model("REV", (0.4, 0.1, 0.15, 0.12, 0.5, 0.2), EQ), [0.960517390, 0.005957213, 0.022879757, 0.010645641]),
        (m.Model("HB", (), EQ, m.Model("KIM", (0.4, 0.2))), [0.786464052, 0.052348491, 0.094047901, 0.067139555]),
    ],
)
def test_first_row_of_p(model, row):
    assert np.allclose(model.at(0.3)[0], row, atol=2e-9)


def test_model_properties():
    rng = np.random.default_rng(5)
    for kind in ("JC", "FEL", "KIM", "HKY", "REV"):
        model = m.random_model(kind, rng)
        q = model.rates()
        assert np.allclose(q.sum(1), 0)
        assert np.allclose(model.at(0.4) @ model.at(0.3), model.at(0.7))
        assert np.allclose(np.diag(model.eq) @ q, (np.diag(model.eq) @ q).T)
        assert np.abs(np.linalg.eigvals(q).imag).max() < 1e-9
        assert np.allclose(m.equilibrium(model.at(1.0)), model.eq)
        assert np.allclose(m.mixture(q, q, 0.6), model.at(0.6), atol=1e-6)
        assert np.allclose(m.Decomposed.of(q).at(0.5), model.at(0.5))
        assert np.allclose(m.from_text(m.to_text(model)).at(0.3), model.at(0.3))
    gap = m.Model("GAP", (0.2, 0.1))
    assert np.allclose(gap.at(1.0)[0, 0], math.exp(-0.3))
    assert m.from_text(m.to_text(gap)) == gap


def test_repeated_eigenvalues():
    for x in np.random.default_rng(1).uniform(0.001, 0.999, 2000):
        p = m.Model("JC", (x,)).at(0.7)
        off = 0.25 - 0.25 * math.exp(-4 * x * 0.7)
        assert np.allclose(p, np.where(np.eye(4) == 1, 1 - 3 * off, off))
        assert np.allclose(m.Decomposed.of(m.Model("JC", (x,)).rates()).at(0.7), p)


def test_nmer_models():
    eq = m.nmer_frequencies(2, EQ)
    q = m.nmer_rates(2, eq, lambda a, b: 0.5)
    p = m.exponential(q, 0.4)
    assert np.allclose(p.sum(1), 1) and np.allclose(m.nmer_lower(p, eq).sum(1), 1)
    assert m.degenerate("A-") == [0, 1, 2, 3] and m.degenerate("CG") == [6]


def test_context_models():
    made = m.ContextModel.build(1, lambda f, c: m.Model("JC", (0.1 + 0.05 * len(c),)))
    assert made.lookup("GA").params == made.models[0, "A"].params
    assert made.raised().lookup("GA").params == made.models[0, "A"].params
    assert made.averaged().models[0, ""].params[0] == pytest.approx(0.15)
    assert m.context_from_text(m.context_to_text(made)).models == made.models
    assert set(made.lower().models) == {(0, "")}
    periodic = m.ContextModel.build(0, lambda f, c: m.Model("JC", (0.1 * (f + 1),)), periodic=True)
    assert periodic.lookup("", 5).params[0] == pytest.approx(0.3)


def test_likelihood_values(sites):
    for model, each, total in ((JC, [-0.436000678] * 3 + [-0.216150975, -3.34177115, -0.436000678], -5.301924839), (HKY, [-0.133132203, -0.163317917, -0.163317917, -0.066328844, -4.302196044, -0.163317917], -4.991610841)):
        got = [r.ll for r in likelihood.pattern_likelihood(sites, LL_TREE, model, F.col).orderBy("col").collect()]
        assert np.allclose(got, each, atol=2e-8) and sum(got) == pytest.approx(total, abs=1e-7)
    df = likelihood.pattern_likelihood(sites, LL_TREE, JC, F.col)
    assert likelihood.best_frame(df).first().frame == 0
    sums = likelihood.prefix_sums(df)
    ranges = sites.sparkSession.createDataFrame([(0, 2, 5)], "block long, begin int, end int")
    assert likelihood.range_sum(sums, ranges).first().total == pytest.approx(-3.993922803, abs=1e-7)


def test_likelihood_against_enumeration(spark):
    tree = Tree(Node("t0", [(Node("A1", [(Node("A2", [(Node("t1"), 0.2), (Node("t2"), 0.1)]), 0.15), (Node("t3"), 0.3)]), 0.1)]))
    rows = [(a, b, c, d) for a, b, c, d in product("AC", "AG-", "CT", "T-")]
    df = spark.createDataFrame(rows, "t0 string, t1 string, t2 string, t3 string")
    for r in likelihood.pattern_likelihood(df, tree, HKY, F.col).collect():
        total = 0.0
        for x, y in product("ACGT", repeat=2):
            state = {"A1": x, "A2": y, **r.asDict()}
            value = 1.0
            for up, child, d in tree.branches():
                p = HKY.at(d)
                if state[child.name] in "ACGT":
                    value *= p["ACGT".index(state[up.name]), "ACGT".index(state[child.name])]
            total += value
        assert r.ll == pytest.approx(math.log(total), abs=1e-9)


TRACKS = "block long, track int, seq string, phase int"


def test_contexts_of_one_model_are_no_contexts(spark, sites):
    """Every engine gives plain pruning where all contexts have one model, HOG and ACO included."""
    plain = {(r.block, r.col): r.ll for r in likelihood.pattern_likelihood(sites, LL_TREE, HKY, F.col).collect()}
    rows = spark.createDataFrame(ROWS, TRACKS)
    same = m.ContextModel.build(1, lambda f, c: HKY)
    for kind, model in (("RCO", same), ("TRCO", same), ("LCO", same), ("ACO", same), ("HOG", m.ContextModel.build(1, lambda f, c: HKY, dual=True)), ("ACO", m.ContextModel.build(1, lambda f, c: HKY, dual=True))):
        got = {(r.block, r.col): r.ll for r in likelihood.evaluate(rows, LL_TREE, model, kind, ["t0", "t1", "t2"]).collect()}
        assert got == {k: pytest.approx(v) for k, v in plain.items()}, kind
    states = parsimony.fitch(sites, LL_TREE, F.col)
    flat = {(r.block, r.col): r.ll for r in likelihood.fitch_likelihood(states, LL_TREE, HKY, F.col).collect()}
    assert {(r.block, r.col): r.ll for r in likelihood.evaluate(rows, LL_TREE, same, "MP", ["t0", "t1", "t2"]).collect()} == {k: pytest.approx(v) for k, v in flat.items()}


def test_context_engines_by_enumeration(spark):
    """ACO and HOG of order 2 over all states of all inner nodes in a slice; gaps in the target shorten slices."""
    rng = np.random.default_rng(4)
    tree = Tree(Node("t0", [(Node("A1", [(Node("t1"), 0.2), (Node("t2"), 0.3)]), 0.1)]))
    rows = [(0, 0, "ACG-TA", 0), (0, 1, "ATGA-A", 0), (0, 2, "A-GC", 0)]
    grid = [x.ljust(6, "-") for _, _, x, _ in rows]
    dual = m.ContextModel.random(2, "HKY", 0.05, rng, dual=True)
    for kind in ("HOG", "ACO"):
        held = dual if kind == "HOG" else dual.ancestral()
        p_of = lambda d, x, y: (held.lookup_dual(x, y) if kind == "HOG" else held.lookup(x)).at(d)  # noqa: B023, E731

        def joint(begin, end):
            total = 0.0
            free = [product(*(c if c in "ACGT" else "ACGT" for c in g[begin:end])) for g in grid[1:]]
            for one, two in product(*(list(f) for f in free)):
                for inner in product("ACGT", repeat=end - begin):
                    value = 1.0
                    for up, down, d in ((grid[0][begin:end], inner, 0.1), (inner, one, 0.2), (inner, two, 0.3)):
                        for k in range(end - begin):
                            value *= p_of(d, "".join(up[:k]), "".join(down[:k]))["ACGT".index(up[k]), "ACGT".index(down[k])]
                    total += value
            return math.log(total)

        got = {r.col: r.ll for r in likelihood.evaluate(spark.createDataFrame(rows, TRACKS), tree, dual, kind, ["t0", "t1", "t2"]).collect()}
        assert sorted(got) == [0, 1, 2, 4, 5]
        for col, begin in ((0, 0), (1, 0), (2, 0), (4, 4), (5, 4)):
            assert got[col] == pytest.approx(joint(begin, col + 1) - (joint(begin, col) if col > begin else 0.0)), (kind, col)


def test_choosing_an_engine(spark):
    rows = spark.createDataFrame(ROWS, TRACKS)
    plain, dual = m.ContextModel.build(1, lambda f, c: JC), m.ContextModel.build(1, lambda f, c: JC, dual=True)
    for model, kind in ((plain, "HOG"), (plain, "NMER"), (m.NmerModel({p: 1.0 for p in m.NmerModel.pairs(1)}), "RCO"), (dual, "CODON"), (plain, "XYZ")):
        with pytest.raises(ValueError):
            likelihood.evaluate(rows, LL_TREE, model, kind, ["t0", "t1", "t2"])
    nmer = m.NmerModel({p: 1.0 for p in m.NmerModel.pairs(2)}, m.UNIFORM)
    got = likelihood.evaluate(rows, LL_TREE, nmer, "NMER", ["t0", "t1", "t2"]).collect()
    want = {r.col: r.ll for r in likelihood.pattern_likelihood(al.wide_sites(rows, 3), LL_TREE, m.Model("JC", (1 / 16,)), F.col).collect()}
    assert {r.col: r.ll for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    total = likelihood.less_ancestral(rows, LL_TREE, plain, "TRCO", ["t0", "t1", "t2"]).first().difference
    assert total == pytest.approx(0)
    both = likelihood.gap_rewriting(rows, LL_TREE, plain, plain, ["t0", "t1", "t2"]).agg(F.sum("ll").alias("x")).first().x
    assert both == pytest.approx(2 * sum(r.ll for r in likelihood.evaluate(rows, LL_TREE, plain, "LCO", ["t0", "t1", "t2"]).collect()))


def test_dual_models():
    made = m.ContextModel.build(1, lambda f, c: m.Model("JC", (0.1 + 0.01 * len(c) + 0.1 * "ACGT".find(c[:1]),)), dual=True)
    assert {k for _, k in made.ancestral().models} == {"", *"ACGT"} and made.ancestral().models[0, "G"] == made.models[0, "G|"]
    assert made.lookup_dual("CA", "GT") == made.models[0, "A|T"] and made.lookup_dual("", "") == made.models[0, "|"]
    mean = made.averaged()
    assert {m.level(c) for _, c in mean.models} == {0, 2}
    assert mean.models[0, "|"].params[0] == pytest.approx(np.mean([made.models[0, f"{a}|{b}"].params[0] for a in "ACGT" for b in "ACGT"]))
    up = made.raised()
    assert up.models[0, "GA|TC"] == made.models[0, "A|C"] and not any(m.level(c) == 3 for _, c in up.models) and up.order == 2
    assert m.context_from_text(m.context_to_text(made)) == made and set(made.even_orders().models) == set(mean.models)
    noisy = m.ContextModel.random(2, "REV", 0.3, np.random.default_rng(1), dual=True)
    for model in noisy.models.values():
        assert all(0 < x < 1 for x in model.params)
        assert all(sum(model.params[k] for pair, k in m.REVERSIBLE.items() if b in pair) < 1.01 for b in "ACGT") or model is noisy.models[0, "|"]
    exact = m.ContextModel.random(1, "HKY", 0.0, np.random.default_rng(1))
    assert len({x.params for x in exact.models.values()}) == 1
    assert made.parameter_contexts() == [f"{a}|{b}" for a in "ACGT" for b in "ACGT"]


def test_nmer_files_and_orders():
    rng = np.random.default_rng(3)
    one = m.NmerModel({p: float(rng.uniform(0.05, 0.2)) for p in m.NmerModel.pairs(1)}, EQ)
    two = one.raised()
    assert m.nmer_from_text(m.nmer_to_text(two)) == two and two.less == one and two.chain(1) == one
    a, stay = one.rate, lambda x: 1 - sum(r for p, r in one.rate.items() if x in p)
    assert two.rate["CA", "CG"] == pytest.approx(a["A", "G"] * stay("C")) and two.rate["AC", "GC"] == pytest.approx(stay("C") * a["A", "G"])
    assert two.averaged().less.rate["A", "G"] == pytest.approx(sum(f * two.rate["A" + x, "G" + x] for f, x in zip(EQ, "ACGT")))
    eq, rates = m.raw_nmer_from_text(m.raw_nmer_to_text(two.eq, two.rates()))
    assert np.array_equal(eq, two.eq) and np.array_equal(rates, two.rates())
    mod = f"ORDER: 1\nBACKGROUND: {' '.join(map(str, eq))}\nRATE_MAT:\n" + "\n".join(" ".join(map(str, r)) for r in rates)
    n, eq2, rates2 = m.raw_nmer_from_mod(mod)
    assert n == 2 and np.allclose(eq2, eq) and np.allclose(rates2, rates)
    assert m.from_mod("RATE_MAT:\n -1 0.1 0.2 0.3\n 0 0 0.4 0.5\n 0 0 0 0.6\n 0 0 0 0").params == (0.2, 0.1, 0.4, 0.3, 0.5, 0.6)
    for bad in ("NMER_RAW\n1\n4 1 1 1 1\n", "COND\n"):
        with pytest.raises(ValueError):
            m.raw_nmer_from_text(bad)


def test_small_files_and_parts():
    text = "  T A C G\nA 4 1 2 3\nT 16 13 14 15\nC 8 5 6 7\nG 12 9 10 11\n"
    assert m.labelled_matrix(text).tolist() == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14, 15, 16]]
    config = "\n".join(f"{k} = {v}  # c" for k, v in zip(m.SETTINGS, ("HKY", 9, "BFGS", "gradient", 1e-3, 1, 1e-4, 0.1, 2, "DNA", "TRCO", "false", 10, 3, "true")))
    assert m.configuration(config)["context-type"] == "TRCO"
    for bad in (config.replace("TRCO", "ROC"), config.replace("order", "ordre")):
        with pytest.raises(ValueError):
            m.configuration(bad)
    assert m.named(" ACO\n", m.CONTEXT_TYPES) == "ACO"
    hky = m.random_model("HKY", np.random.default_rng(2))
    assert hky.rescaled(2.0) == hky and JC.rescaled(2.0).params == (0.5,) and hky.with_param(1, 0.5).params[1] == 0.5
    step, at = 1e-5, 0
    for kind in ("JC", "FEL", "KIM", "HKY", "REV"):
        model = m.random_model(kind, np.random.default_rng(7))
        up, down = (model.with_param(at, model.params[at] + s).rates() for s in (step, -step))
        assert np.allclose(model.derivative(at), (up - down) / (2 * step), atol=1e-5)
    draws = [m.substitute(np.array([[0.2, 0.3, 0.5, 0.0]]), 0, rng) for rng in [np.random.default_rng(1)] for _ in range(4000)]
    assert np.allclose(np.bincount(draws, minlength=4) / 4000, [0.2, 0.3, 0.5, 0], atol=0.03)


def test_majority_with_the_root(spark):
    tree = Tree(Node("r", [(Node("A1", [(Node("A2", [(Node("a"), 1.0), (Node("b"), 1.0)]), 1.0), (Node("c"), 1.0)]), 1.0)]))
    df = spark.createDataFrame([("G", "A", "A", "C"), ("C", "A", "G", "T"), ("A", "A", "G", "T"), ("T", "-", "-", "C")], "r string, a string, b string, c string")
    got = [(x.A1, x.A2) for x in parsimony.majority(df, tree, F.col).orderBy("r").collect()]
    # resolved nodes pass on one residue, so A A below counts once beside C and the root's G
    assert got == [("A", "A"), ("C", "C"), ("G", "A"), ("T", "-")]


def test_gap_patterns(spark):
    kind = "array<struct<pos:int,len:int>>"
    df = spark.createDataFrame([([(5, 1), (2, 3)], [(2, 7), (9, 1)], [("s", 4), ("i", 3), ("d", 2), ("s", 2)])], f"a {kind}, b {kind}, h array<struct<op:string,len:int>>")
    one = df.select(parsimony.merged_gaps(parsimony.sorted_gaps(F.col("a")), F.col("b")).alias("x")).first().x
    assert [tuple(g) for g in one] == [(2, 3), (2, 7), (5, 1), (9, 1)]
    # child 0-3 are parent 0-3, child 4-6 are inserted at parent 4, child 7-8 are parent 6-7
    up = df.select(parsimony.raised_gaps(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(n).alias("len")) for p, n in ((1, 2), (5, 4), (8, 1)))), F.col("h")).alias("x")).first().x
    assert [tuple(g) for g in up] == [(1, 2), (4, 1), (4, 4), (4, 2), (7, 1)]
    none = df.select(parsimony.raised_gaps(F.expr(f"cast(array() as {kind})"), F.col("h")).alias("x")).first().x
    assert [tuple(g) for g in none] == [(4, 3)]


def test_attach_number_and_combine(spark):
    nodes = LL_TREE.table(spark)
    rows = spark.createDataFrame([(0, "t0", "ACG", 0), (0, "zz", "A", 1), (1, "t2", "AC", 0), (1, "t0", "A", 1)], "block long, name string, seq string, ix int")
    got = {(r.block, r.name): (r.kind, r.seq) for r in al.attach(nodes, rows).collect()}
    assert got == {(0, "t0"): ("ROOT", "ACG"), (0, "t1"): ("LEAF", "---"), (0, "t2"): ("LEAF", "---"), (0, "A1"): ("INTERNAL", None), (0, "zz"): (None, "A"),
                   (1, "t0"): ("ROOT", "A"), (1, "t1"): ("LEAF", "--"), (1, "t2"): ("LEAF", "AC"), (1, "A1"): ("INTERNAL", None)}
    assert {(r.name, r.track) for r in al.track_numbers(rows).collect()} == {("t0", 0), ("zz", 1), ("t2", 2)}
    flat = al.combined(spark.createDataFrame([*ROWS, (7, 1, "GG", 0)], TRACKS), 3)
    text = {k: "".join(r.sym for r in flat.where(F.col("track") == k).orderBy("col").collect()) for k in range(3)}
    assert text == {0: "ACGTAC--", 1: "ACGTTCGG", 2: "ACG-AC--"}
    df = likelihood.pattern_likelihood(al.wide_sites(spark.createDataFrame([*ROWS, (5000, 0, "AC", 0)], TRACKS), 3), LL_TREE, JC, F.col)
    cum = likelihood.cumulative(df).orderBy("block", "col").collect()
    each = [r.ll for r in df.orderBy("block", "col").collect()]
    assert [r.cum for r in cum] == pytest.approx(list(np.cumsum(each)))


def test_left_neighbours(spark):
    df = al.left_sites(spark.createDataFrame([(0, 0, "ACG-T", 0), (0, 1, "TT", 0)], TRACKS), 2, 2, [0, 1])
    got = {r.col: r.ctx for r in al.with_context(df, "t0", 2).collect()}
    assert got == {0: "", 1: "A", 2: "AC", 3: "CG", 4: ""}
    assert {r.col: (r.t1_l1, r.t1_l2) for r in df.collect()} == {0: ("", ""), 1: ("T", ""), 2: ("T", "T"), 3: ("~", "T"), 4: ("~", "~")}


def test_patterns_of_many_taxa(spark, sites, monkeypatch):
    engine = lambda df: likelihood.pattern_likelihood(df, LL_TREE, HKY, F.col)
    want = {(r.block, r.col): r.ll for r in engine(sites).collect()}
    for most in (1 << 16, 0):
        monkeypatch.setattr(likelihood, "TABULATED", most)
        assert {(r.block, r.col): r.ll for r in likelihood.with_likelihood(sites, ["t0", "t1", "t2"], engine).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_one_column_nmers_are_pruning(spark, sites):
    q, eq = HKY.rates(), np.array(EQ)
    df = sites.select("t0", "t1", "t2").distinct()
    a = {tuple(r[:3]): r.ll for r in likelihood.nmer_likelihood(df, LL_TREE, 1, q, eq).collect()}
    b = {tuple(r[:3]): r.ll for r in likelihood.pattern_likelihood(df, LL_TREE, HKY, F.col).collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_distances(sites):
    pats = al.patterns(sites, ["t0", "t1", "t2"])
    got = {(r.t1, r.t2): (r.mismatches, r.matches) for r in distance.pair_counts(pats, ["t0", "t1", "t2"]).collect()}
    assert got == {("t0", "t1"): (1, 5), ("t0", "t2"): (0, 5), ("t1", "t2"): (1, 4)}
    got = {(r.t1, r.t2): (r.mismatches, r.matches) for r in distance.pair_counts(pats, ["t0", "t1", "t2"], "upgma").collect()}
    assert got == {("t0", "t1"): (1, 5), ("t0", "t2"): (1, 5), ("t1", "t2"): (2, 4)}


def _square(names, text):
    d = [[0.0] * len(names) for _ in names]
    for item in text.split():
        i, j = names.index(item[0]), names.index(item[1])
        d[i][j] = d[j][i] = float(item[2:])
    return d


def test_tree_builders():
    names = list("abcde")
    nj = distance.neighbour_joining(names, _square(names, "ab5 ac9 ad9 ae8 bc10 bd10 be9 cd8 ce7 de3"))
    assert nj.to_newick() == "((((a:2,b:3)A1:3,c:4)A2:2,e:1)A3:1,d:1)root;"
    up = distance.upgma(names, _square(names, "ab17 ac21 ad31 ae23 bc30 bd34 be21 cd28 ce39 de43"))
    lengths = {(p.name, c.name): d for p, c, d in up.branches()}
    assert lengths == {("A1", "a"): 8.5, ("A1", "b"): 8.5, ("A2", "A1"): 6.75, ("A2", "e"): 6.75, ("A3", "d"): 14, ("A3", "c"): 14, ("A4", "A2"): 1.875, ("A4", "A3"): 1.875}


def test_tree_surgery_and_formats(spark):
    names = list("abcde")
    tree = distance.neighbour_joining(names, _square(names, "ab5 ac9 ad9 ae8 bc10 bd10 be9 cd8 ce7 de3"))
    assert (tree.distance("a", "b"), tree.distance("a", "c"), tree.distance("a", "d"), tree.spanned("a", "b", "c")) == (5, 9, 9, 12)
    again = tree.rerooted("d")
    assert again.root.kind == "ROOT" and again.root.children[0][0].name == "A3" and again.root.children[0][1] == 2
    assert all(again.distance(x, y) == pytest.approx(d) for (x, y), d in tree.leaf_distances().items())
    cut = tree.pruned({"a", "c", "d"})
    assert sorted(cut.leaves()) == ["a", "c", "d"]
    assert all(d == pytest.approx(tree.distance(x, y)) for (x, y), d in cut.leaf_distances().items())
    for t in (tree, again):
        assert Tree.from_phy(t.to_phy()).to_newick() == t.to_newick()
    assert Tree.from_newick(tree.to_nexus()).leaf_distances() == tree.leaf_distances()
    with pytest.raises(ValueError):
        again.rerooted("a")
    table = {(r.a, r.b): r.d for r in tr.leaf_distances(tree.table(spark)).collect()}
    assert table == {tuple(sorted(k)): pytest.approx(v) for k, v in tree.leaf_distances().items()}
    assert tree.path("a", "e") == ["a", "A1", "A2", "A3", "e"]


def test_parsimony(spark):
    tree = Tree(Node("R", [(Node("A1", [(Node("a"), 1.0), (Node("b"), 1.0)]), 1.0), (Node("A2", [(Node("c"), 1.0), (Node("d"), 1.0)]), 1.0)]))
    df = spark.createDataFrame([("A", "C", "C", "C"), ("A", "A", "C", "C"), ("-", "G", "T", "T")], "a string, b string, c string, d string")
    got = [(r.R, r.A1, r.A2) for r in parsimony.fitch(df, tree, F.col).orderBy("a", "b").collect()]
    assert got == [("G", "G", "T"), ("A", "A", "C"), ("C", "C", "C")]
    got = [(r.R, r.A1, r.A2) for r in parsimony.single_gain(df, tree, F.col).orderBy("a", "b").collect()]
    assert got == [(".", ".", "T"), (".", "A", "C"), ("C", "C", "C")]


def test_indel_history():
    ops = parsimony.append_history([("s", 2)], [("s", 3), ("i", 1), ("d", 2), ("i", 1)])
    assert ops == [("s", 5), ("i", 1), ("d", 2), ("i", 1)]
    assert parsimony.history_length(ops, "parent") == parsimony.history_length(ops, "child") == 7
    assert parsimony.top_off(ops, 10)[-1] == ("s", 3)


def test_codon_trim(spark):
    df = spark.createDataFrame([(k, 0, "ABCDEFG", k) for k in range(3)], "block long, track int, seq string, phase int")
    assert [r.seq for r in al.codon_trim(df).orderBy("block").collect()] == ["ABCDEF", "CDE", "BCDEFG"]


def test_maf_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "block long, track int, seq string, phase int").withColumn("name", F.concat(F.lit("sp"), "track"))
    formats.write_maf(df, str(tmp_path / "maf"))
    back = formats.read_maf(spark, str(tmp_path / "maf"))
    assert sorted((r.track, r.name, r.seq, r.phase) for r in back.collect()) == [(k, f"sp{k}", s, 0) for _, k, s, _ in ROWS]
    assert formats.to_fasta(df).first().value == ">0\nACGTAC"


def test_training_climbs(sites):
    pats = al.patterns(sites, ["t0", "t1", "t2"])
    before = training.Objective(pats, LL_TREE, HKY, F.col)
    start = before.many([before.start()])[0]
    _, model, best = training.train(pats, LL_TREE, HKY, F.col, rounds=2)
    assert best < start and model.kind == "HKY"


def test_objective_by_hand(spark, sites):
    """Values, penalty, fixed branch and gradients of all kinds, of plain and of context models; a job for all points."""
    pats = al.patterns(sites, ["t0", "t1", "t2"])
    one = training.Objective(pats, LL_TREE, HKY, F.col, sigma=2.0, fixed_branch=1)
    x = one.start()
    plain = -sum(r.ll for r in likelihood.pattern_likelihood(sites, one.parts(x)[0], one.parts(x)[1], F.col).collect())
    assert one.many([x])[0] == pytest.approx(plain + float(x @ x) / 8) and one.jobs == 1
    two, four, side = (one.gradient(x, points=k) for k in (2, 4, 1))
    assert np.allclose(two, four, atol=1e-4) and np.allclose(two, side, atol=0.05) and two[1] == 0 and one.jobs <= 4
    made = m.ContextModel.build(1, lambda f, c: m.Model("JC", (0.2 + 0.03 * "ACGT".find(c),)))
    rows = al.with_context(al.left_sites(spark.createDataFrame(ROWS, TRACKS), 3, 1, [0]), "t0", 1)
    pats = al.patterns(rows, ["t0", "t1", "t2"], ["ctx"])
    ctx = training.Objective(pats, LL_TREE, made, F.col)
    x = ctx.start()
    want = -sum(r.ll for r in likelihood.context_likelihood(rows, ctx.parts(x)[0], ctx.parts(x)[1], F.col, "TRCO").collect())
    assert ctx.many([x])[0] == pytest.approx(want)
    got = ctx.gradient(x)
    by_hand = [(ctx.many([x + d])[0] - ctx.many([x - d])[0]) / 2e-4 for d in 1e-4 * np.eye(len(x))]
    assert np.allclose(got, by_hand, atol=1e-5) and len(x) == 3 + 4
    mean = training.Objective(pats, LL_TREE, made, F.col, averaged=True)
    assert mean.parts(x)[1].models[0, ""].params[0] == pytest.approx(np.mean([mean.parts(x)[1].models[0, c].params[0] for c in "ACGT"]))
    by_hand = [(mean.many([x + d])[0] - mean.many([x - d])[0]) / 2e-4 for d in 1e-4 * np.eye(len(x))]
    assert np.allclose(mean.gradient(x), by_hand, atol=1e-5)


def test_training_in_passes(spark):
    rng = np.random.default_rng(1)
    seq = lambda: "".join(rng.choice(list("ACGT"), 300))
    target = seq()
    near = lambda share: "".join(x if rng.random() > share else str(rng.choice(list("ACGT"))) for x in target)
    tracks = spark.createDataFrame([(0, 0, target, 0), (0, 1, near(0.2), 0), (0, 2, near(0.4), 0)], TRACKS)
    rows = al.with_context(al.left_sites(tracks, 3, 1, [0]), "t0", 1)
    pats = al.patterns(rows, ["t0", "t1", "t2"], ["ctx"])
    plain = al.patterns(rows, ["t0", "t1", "t2"])
    _, _, scaled = training.train(plain, LL_TREE, JC, F.col, tree_scale_only=True, rounds=4)
    tree, model, free = training.train_known_tree(plain, LL_TREE, JC, F.col, rounds=4)
    assert free <= scaled and tree.find("A1") and model.kind == "JC"
    _, last, best, values = training.train_progressively(pats, LL_TREE, "JC", 1, F.col, restarts=2, rounds=3)
    assert len(values) == 2 and values[1] <= values[0] + 1e-6 and best == values[-1] and last.order == 1
    wobble = training.wobble_tracks(tracks, 3, 1)
    assert wobble.count() == 100 and {r.col % 3 for r in wobble.collect()} == {2}


def test_drained_stream(spark, tmp_path):
    from cladeframe.streaming import blocks

    rows = spark.createDataFrame(ROWS, "block long, track int, seq string, phase int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = blocks.drained(blocks.running_composition(stream), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 6, 2, 2, 1, 1), (1, 1, 6, 1, 2, 1, 2), (2, 1, 6, 2, 2, 1, 0)]


def test_queries_have_oracles():
    from cladeframe.oracles import ORACLES
    from cladeframe.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= len(QUERIES) - 4
