"""Tree likelihoods by pruning, as DataFrame expressions over distinct site patterns.

A column's likelihood is that of the other taxa given the root taxon's residue (no prior on the root). The tree's shape
becomes one array column per inner node; P(t) enters as literals, or, where a context chooses it, as columns that a
broadcast join on the context brings: one pass over the patterns whatever the order. Patterns are grouped before anything
is computed, so the cost follows the number of distinct columns, not of columns; of few taxa all possible patterns are
tabulated at once and broadcast. Engines over slices of n columns work on n-mers in numpy, whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.models import BASES, CONTEXT_TYPES, GAPS, ContextModel, Model, NmerModel, context_nmers, degenerate, exponential, named, nmer_frequencies, nmer_lower
from cladeframe.operators import alignment
from cladeframe.operators.alignment import Coding, carried, concatenated, left_sites, raw_bytes, stretch_of, with_context
from cladeframe.operators.parsimony import fitch
from cladeframe.operators.tree import Node, Tree


def _lit(x: float) -> Column:
    return F.lit(float(x))


def _vector(values) -> Column:
    return F.array(*map(_lit, values))


def _through_leaf(symbol: Column, p, states: str = BASES) -> Column:
    """P(parent state -> observed leaf) for all parent states; all ones where the leaf is none of the states. p: an array, or a
    column of such arrays turned over, as _p_table has them for leaves."""
    missing = _vector([1] * len(states))
    if not isinstance(p, np.ndarray):
        return F.coalesce(F.get(p, F.position(symbol, F.lit(states)) - 1), missing)
    return reduce(lambda a, b: a.when(symbol == b, _vector(p[:, states.index(b)])), states, F).otherwise(missing)


def _through_node(states: Column, p) -> Column:
    rows = F.array(*(_vector(row) for row in p)) if isinstance(p, np.ndarray) else p
    dot = lambda row: F.aggregate(F.zip_with(row, states, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(rows, dot)


def _times(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x * y), parts)


def conditional(df: DataFrame, tree: Tree, p_of: Callable[[Node, float], np.ndarray], symbol_of: Callable[[str], Column], states: str = BASES) -> DataFrame:
    """Adds _L<node>, the likelihood of what lies below each inner node by the node's state."""
    for node in tree.nodes:
        if node.kind != "INTERNAL":
            continue
        parts = [_through_leaf(symbol_of(c.name), p_of(c, d), states) if not c.children else _through_node(F.col(f"_L{tree.ids[id(c)]}"), p_of(c, d)) for c, d in node.children]
        df = df.withColumn(f"_L{tree.ids[id(node)]}", _times(parts))
    return df


def pattern_likelihood(patterns: DataFrame, tree: Tree, model: Model, symbol_of: Callable[[str], Column], out: str = "ll", missing_root: str = "zero") -> DataFrame:
    """Adds ln P(others | root residue). A missing root residue gives 0, or ('sum') the log of the sum over residues."""
    return column_likelihood(patterns, tree, lambda node, d: model.at(d), symbol_of, out, missing_root)


def column_likelihood(df: DataFrame, tree: Tree, p_of, symbol_of, out: str, missing_root: str, states: str = BASES) -> DataFrame:
    """Adds the log-likelihood with P of every branch as p_of gives it: an array, or a column of arrays, over the states."""
    if tree.root.kind != "ROOT":
        raise ValueError("the likelihood engines need a tree whose root is a taxon with one child")
    before = df.columns
    df = conditional(df, tree, p_of, symbol_of, states)
    (child, d), root = tree.root.children[0], symbol_of(tree.root.name)
    p = p_of(child, d)
    by_state = _through_leaf(symbol_of(child.name), p, states) if not child.children else _through_node(F.col(f"_L{tree.ids[id(child)]}"), p)
    df = df.withColumn("_root", by_state)
    chosen = reduce(lambda a, b: a.when(root == b, F.get("_root", F.lit(states.index(b)))), states, F)
    absent = _lit(1.0) if missing_root == "zero" else F.aggregate("_root", F.lit(0.0), lambda s, x: s + x)
    value = chosen.otherwise(absent)
    return df.withColumn(out, F.when(value > 0, F.ln(value)).otherwise(F.lit(float("-inf")))).select(*before, out)


#: Possible patterns, times contexts, up to which they are tabulated and broadcast; rows of a table of contexts up to which it is.
TABULATED = 1 << 16


def states_of(model: ContextModel) -> str:
    """The alphabet of a model's matrices."""
    return GAPS if all(m.kind == "GAP" for m in model.models.values()) else BASES


def gap_state(symbol: Column) -> Column:
    """A column's symbol as a state of the gap process: N for a residue, - for a gap, . for what is unaligned or past the
    track's end; '' stays, for places before a block's start."""
    return F.when(symbol.isin(*BASES, "N"), "N").when(symbol.isin("-", ""), symbol).otherwise(".")


def normal(symbol: Column) -> Column:
    """The base, or - for anything that counts as missing."""
    return F.when(symbol.isin(*BASES), symbol).otherwise("-")


def all_patterns(spark: SparkSession, names: list[str]) -> DataFrame | None:
    """Every combination of A C G T - over the names, if TABULATED allows."""
    if 5 ** len(names) > TABULATED:
        return None
    digit = lambda k: F.substring(F.lit(BASES + "-"), (F.floor(F.col("id") / 5**k) % 5 + 1).cast("int"), F.lit(1))
    return spark.range(5 ** len(names)).select(*(digit(k).alias(n) for k, n in enumerate(names)))


def with_likelihood(sites: DataFrame, names: list[str], engine: Callable[[DataFrame], DataFrame], by: DataFrame | None = None, out: str = "ll") -> DataFrame:
    """The sites with what an engine adds to patterns of the names (and of the columns of the small table `by`).

    All possible patterns are tabulated and broadcast where they are few, a bound that the data cannot move; otherwise the
    patterns that occur are, and joined.
    """
    keys = names + (by.columns if by is not None else [])
    few = 5 ** len(names) * (by.count() if by is not None else 1) <= TABULATED  # of patterns and contexts together
    table = all_patterns(sites.sparkSession, names) if few else None
    table = table.crossJoin(F.broadcast(by)) if few and by is not None else table
    if not few:
        table = sites.select(*(normal(F.col(n)).alias(n) for n in names), *(c for c in keys if c not in names)).distinct()
    table = engine(table).select(*(F.col(k).alias(f"_{k}") for k in keys), out)
    same = reduce(lambda a, b: a & b, [(normal(F.col(k)) if k in names else F.col(k)) == F.col(f"_{k}") for k in keys])
    return sites.join(F.broadcast(table) if few else table, same).drop(*(f"_{k}" for k in keys))


def trimmed(context: Column, model: ContextModel) -> Column:
    """The longest suffix of a context that the model knows."""
    known = sorted({c for _, c in model.models}, key=len, reverse=True)
    longest = len(known[0])
    if not longest:
        return F.lit("")
    suffix = lambda k: F.right(context, F.lit(k))
    return reduce(lambda a, k: a.when((F.length(context) >= k) & suffix(k).isin(*[c for c in known if len(c) == k]), suffix(k)), range(longest, 0, -1), F).otherwise("")


def branch_table(model: Model, child: Node, d: float) -> list[list[float]]:
    """P of a branch as a column holds it: rows by the parent's state, or, where the child is a leaf, by the leaf's."""
    return [[float(x) for x in row] for row in (model.at(d) if child.children else model.at(d).T)]


def _p_table(spark: SparkSession, tree: Tree, model: ContextModel, prefix: str) -> DataFrame:
    """(<prefix>, [phase,] <prefix><child id>...): P of every branch by context, and by phase in a periodic model; turned over
    on the branches of leaves, where one target state is looked up."""
    phases = [(f,) for f in range(3)] if model.periodic else [()]
    rows = [(c, *f, *(branch_table(m, child, d) for _, child, d in tree.branches())) for f in phases for (g, c), m in model.models.items() if g == (f or (0,))[0]]
    if len(rows) > TABULATED:
        raise ValueError(f"more than {TABULATED} contexts")
    fields = [(prefix, pa.string()), *([("phase", pa.int32())] if model.periodic else []), *((f"{prefix}{tree.ids[id(c)]}", pa.list_(pa.list_(pa.float64()))) for _, c, _ in tree.branches())]
    return F.broadcast(small_table(spark, rows, fields))


def small_table(spark: SparkSession, rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Rows of the driver as a table that is part of the plan: no job and no Python worker is needed to read it."""
    return spark.createDataFrame(pa.table([pa.array(x, t) for x, (_, t) in zip(zip(*rows), fields, strict=True)], names=[c for c, _ in fields]))  # noqa: B905


def known_contexts(spark: SparkSession, model: ContextModel) -> DataFrame:
    """(ctx[, phase]): what chooses a matrix of the model, made on the driver."""
    known = small_table(spark, [(c, f) for f, c in model.models], [("ctx", pa.string()), ("phase", pa.int32())])
    return known if model.periodic else known.select("ctx")


def context_likelihood(patterns: DataFrame, tree: Tree, model: ContextModel, symbol_of, engine: str = "TRCO", context_col: str = "ctx", out: str = "ll") -> DataFrame:
    """RCO: the root's left context chooses P on the root's branch; TRCO: on all branches. A missing root residue gives 0
    (RCO) or the log of the sum over residues (TRCO). Of a periodic model the matrices are those of the pattern's `phase`."""
    before, top, spark = patterns.columns, tree.root.children[0][0], patterns.sparkSession
    by = ["_ctx", "phase"] if model.periodic else ["_ctx"]
    df = patterns.withColumn("_ctx", trimmed(F.col(context_col), model)).join(_p_table(spark, tree, model, "_p").withColumnRenamed("_p", "_ctx"), by)
    if engine == "TRCO":
        p_of = lambda node, d: F.col(f"_p{tree.ids[id(node)]}")
    elif model.periodic:  # below the root's branch, order 0 of the phase
        df = df.join(_p_table(spark, tree, model, "_q").where("_q = ''").drop("_q"), "phase")
        p_of = lambda node, d: F.col(f"_{'p' if node is top else 'q'}{tree.ids[id(node)]}")
    else:
        plain = model.lookup("")
        p_of = lambda node, d: F.col(f"_p{tree.ids[id(node)]}") if node is top else plain.at(d)
    return column_likelihood(df, tree, p_of, symbol_of, out, "sum" if engine == "TRCO" else "zero").select(*before, out)


def leaf_context_likelihood(sites: DataFrame, tree: Tree, model: ContextModel, symbol_of, context_of, out: str = "ll") -> DataFrame:
    """LCO: a leaf's own left context chooses P on its branch, the root's on all other branches; of a periodic model, the
    matrices of the row's `phase`. Symbols and contexts are those of the model's own states."""
    before, df = sites.columns, sites
    taxa = [tree.root.name, *tree.root.leaves()]
    for k, name in enumerate(taxa):
        at = f"_x{k}_"
        df = df.withColumn(at, trimmed(context_of(name), model)).join(_p_table(sites.sparkSession, tree, model, at), [at, "phase"] if model.periodic else at)
    held = {id(c): F.col(f"_x{0 if c.children else taxa.index(c.name)}_{tree.ids[id(c)]}") for _, c, _ in tree.branches()}
    return column_likelihood(df, tree, lambda node, d: held[id(node)], symbol_of, out, "zero", states_of(model)).select(*before, out)


def fitch_likelihood(sites: DataFrame, tree: Tree, model: ContextModel | Model, state_of: Callable[[str], Column], context_of: Callable[[str], Column] | None = None, out: str = "ll") -> DataFrame:
    """MP: states at inner nodes are given (by parsimony), so the log-likelihood is a sum over branches, each with P chosen
    by the parent's own left context; a missing end adds 0. A plain model needs no contexts."""
    held = model if isinstance(model, ContextModel) else ContextModel(0, {(0, ""): model})
    before, df, total = sites.columns, sites, F.lit(0.0)
    for k, (parent, child, d) in enumerate(tree.branches()):
        rows = [(f"{c}>{x}{y}", float(v)) for (f, c), m in held.models.items() if f == 0 for x, row in zip(BASES, np.log(m.at(d)), strict=True) for y, v in zip(BASES, row, strict=True)]
        if len(rows) > 16 * TABULATED:
            raise ValueError(f"more than {TABULATED} contexts")
        table = F.broadcast(small_table(sites.sparkSession, rows, [(f"_key{k}", pa.string()), (f"_log{k}", pa.float64())]))
        context = trimmed(context_of(parent.name), held) if context_of else F.lit("")
        df = df.withColumn(f"_key{k}", F.concat(context, F.lit(">"), state_of(parent.name), state_of(child.name))).join(table, f"_key{k}", "left")
        total = total + F.coalesce(f"_log{k}", F.lit(0.0))
    return df.withColumn(out, total).select(*before, out)


# -- slices of n columns ------------------------------------------------------------------------------------------------


#: Numbers of one array of slices by n-mers: 32 MB.
DENSE = 1 << 22


def _codes(nmers: list[str], n: int) -> np.ndarray:
    """Row per n-mer: 1 for every n-mer of A C G T that it matches."""
    values, at = np.unique(np.asarray(nmers, dtype=str), return_inverse=True)
    table = np.zeros((len(values), 4**n))
    for k, x in enumerate(values):
        table[k, degenerate(str(x))] = 1.0
    return table[at]


def slice_joint(tree: Tree, p_of: Callable[[Node], np.ndarray], nmers: dict[str, list[str]], n: int, eq: np.ndarray) -> np.ndarray:
    """ln of the joint probability of the n-mers of all taxa given the root's, for a batch of slices.

    Missing symbols are summed over; at the root they are weighed by eq, the frequencies of n-mers."""

    def below(x: Node) -> np.ndarray:
        if not x.children:
            return _codes(nmers[x.name], n)
        return reduce(mul, (below(c) @ p_of(c).T for c, _ in x.children))

    weight = _codes(nmers[tree.root.name], n) * eq
    up = below(tree.root.children[0][0]) @ p_of(tree.root.children[0][0]).T
    with np.errstate(divide="ignore"):
        return np.log((up * weight).sum(1) / weight.sum(1))


def slice_likelihood(slices: DataFrame, tree: Tree, tables: dict[int, tuple[dict[str, np.ndarray], np.ndarray]], out: str = "ll") -> DataFrame:
    """ln P of the last column of a slice given those before it: the joint of the slice less that of the slice without it.

    slices: distinct patterns with a string column per taxon, as long as the slice (shorter at a block's start). tables:
    width -> (P of each branch by child name, frequencies of n-mers), fixed in size by the order of the model.
    """
    taxa, held = tree.taxa(), slices.sparkSession.sparkContext.broadcast(tables)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema)

    def run(batches):
        for batch in batches:
            texts = {t: batch.column(batch.schema.get_field_index(t)).to_pylist() for t in taxa}
            ll, size = np.zeros(batch.num_rows), np.array([len(x) for x in texts[tree.root.name]])
            for n in np.unique(size):
                every, most = np.flatnonzero(size == n), max(1, DENSE // 4 ** int(n))
                for rows in (every[at : at + most] for at in range(0, len(every), most)):
                    for width, sign in ((int(n), 1), (int(n) - 1, -1)):
                        if width:
                            p, eq = held.value[width]
                            ll[rows] += sign * slice_joint(tree, lambda c, p=p: p[c.name], {t: [x[k][:width] for k in rows] for t, x in texts.items()}, width, eq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ll)], names=[*batch.schema.names, out])

    return slices.mapInArrow(run, f"{fields}, {out} double")


def context_tables(tree: Tree, model: ContextModel) -> dict[int, tuple[dict[str, np.ndarray], np.ndarray]]:
    """Tables of the slices of a context model: ACO by the parent's symbols before each place, HOG (a dual model) by both's."""
    single = model.models[0, "|" if model.dual else ""].eq
    return {n: ({c.name: context_nmers(model, n, d) for _, c, d in tree.branches()}, nmer_frequencies(n, single)) for n in range(1, model.order + 2)}


def nmer_tables(tree: Tree, rates: np.ndarray, eq: np.ndarray) -> dict[int, tuple[dict[str, np.ndarray], np.ndarray]]:
    """Tables of an n-mer process: the shorter ones sum over the last target base, by frequency of the last source base."""
    n, p = round(np.log(len(eq)) / np.log(4)), {c.name: exponential(rates, d) for _, c, d in tree.branches()}
    out = {n: (p, eq)}
    for k in range(n - 1, 0, -1):
        p, eq = {name: nmer_lower(x, eq) for name, x in p.items()}, eq.reshape(-1, 4).sum(1)
        out[k] = p, eq
    return out


def nmer_likelihood(columns: DataFrame, tree: Tree, n: int, rates: np.ndarray, eq: np.ndarray, out: str = "ll") -> DataFrame:
    """NMER: ln P of the last of n columns given the n - 1 before under a process on n-mers."""
    return slice_likelihood(columns, tree, nmer_tables(tree, rates, eq), out)


# -- choosing an engine -------------------------------------------------------------------------------------------------


def evaluate(tracks: DataFrame, tree: Tree, model, context_type: str, names: list[str], out: str = "ll") -> DataFrame:
    """(block, col, ll) of every column whose target has a base, by the engine that the context type names.

    A dual model serves HOG alone; all other engines take its parent contexts. HOG needs a dual model, NMER an n-mer model.
    Contexts are trimmed after their right-most gap, and those of a block's first columns are shorter. A periodic model
    serves RCO, TRCO and LCO: the matrices of a column are those of (phase + col) % 3, with the block's phase, which
    running_phase sets so that it runs on over the ends of blocks. A model of gap patterns serves LCO alone: there every
    symbol is a state, so nothing is missing and contexts are not trimmed. names: the taxa in the order of the track
    numbers, the tree's root first.
    """
    kind, model, order = _served(model, context_type)
    of = [0] if kind in ("RCO", "TRCO") else list(range(len(names)))
    sites = left_sites(tracks, len(names), order, of).where(F.col(names[0]).isin(*BASES)).withColumn("phase", ((F.col("phase") + F.col("col")) % 3).cast("int"))
    if kind in ("RCO", "TRCO"):
        return _by_root_context(sites, tree, model, kind, names, order, out).select("block", "col", out)
    keyed, keys, engine = _keyed(sites, tree, model, kind, names, order, ["block", "col"], out)
    return keyed.join(engine(keyed.select(*keys).distinct()), keys).select("block", "col", out)


def evaluate_by_frame(tracks: DataFrame, tree: Tree, model, context_type: str, names: list[str]) -> DataFrame:
    """(frame, n, total) in parts to be summed: number and log-likelihood of the columns that evaluate gives, by col % 3.

    Columns are counted as patterns before an engine sees any, so its work is bounded by the number of possible patterns and
    not by the columns. Where all possible ones are few they are scored beside the counting, else those that occur are after
    it. MP's columns are counted branch by branch, over which it is a sum."""
    kind, model, order = _served(model, context_type)
    if kind == "MP" and 5 ** len(names) <= TABULATED and 3 * 5 ** (order + 2) * (len(tree.branches()) + 1) <= alignment.DENSE_KEYS:
        return _mp_by_frame(tracks, tree, model, names, order)
    coding = _coding(model, kind, names, order)
    if _few(coding):
        return _by_values(tracks, tree, [(kind, model, coding)], names)
    sites = _phased(alignment.left_patterns(tracks, len(names), order, coding.of, coding.gaps, coding.phase), coding)
    if kind in ("RCO", "TRCO"):
        scored = _by_root_context(sites, tree, model, kind, names, order, "_ll")
        return scored.select("frame", "n", (F.col("n") * F.col("_ll")).alias("total"))
    keyed, keys, engine = _keyed(sites, tree, model, kind, names, order, ["frame", "n"], "_ll")
    once = keyed.groupBy(*keys).agg(*(F.sum(F.when(F.col("frame") == k, F.col("n")).otherwise(0)).alias(f"_n{k}") for k in range(3)))
    scored = engine(once.repartition(*keys))
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("frame"), F.col(f"_n{k}").alias("n")) for k in range(3)))).alias("x")
    return scored.select("_ll", parts).where("x.n > 0").select("x.frame", "x.n", (F.col("x.n") * F.col("_ll")).alias("total"))


def _served(model, context_type: str):
    """The engine's name, the model as the engine takes it, and the columns that it looks back."""
    kind = named(context_type, CONTEXT_TYPES)
    if kind in ("AMINO", "CODON"):
        raise ValueError(f"no engine for {kind}")
    if (kind == "NMER") != isinstance(model, NmerModel):
        raise ValueError("NMER and n-mer models go together")
    if kind == "HOG" and not model.dual:
        raise ValueError("HOG needs a dual model")
    if kind not in ("NMER", "HOG"):
        model = model.ancestral()
    if kind != "NMER" and model.periodic and kind not in ("RCO", "TRCO", "LCO"):
        raise ValueError(f"no periodic models in {kind}")
    if kind not in ("NMER", "LCO") and states_of(model) == GAPS:
        raise ValueError("models of gap patterns are for LCO")
    return kind, model, model.n - 1 if kind == "NMER" else model.order


def _coding(model, kind: str, names: list[str], order: int) -> Coding:
    """How an engine's columns are counted."""
    plain = kind == "NMER"
    return Coding(len(names), order, [0] if kind in ("RCO", "TRCO") else list(range(len(names))), not plain and states_of(model) == GAPS, not plain and model.periodic)


def _phased(patterns: DataFrame, coding: Coding) -> DataFrame:
    """The patterns with the phase of their columns for that of their block's first."""
    return patterns.withColumn("phase", ((F.col("phase") + F.col("frame")) % 3).cast("int")) if coding.phase else patterns


def _scored_codes(coding: Coding) -> int:
    """Every how many codes there is one to be scored: the frame matters in a periodic model alone."""
    return 1 if coding.phase else 3


def _few(coding: Coding) -> bool:
    return coding.space <= TABULATED * _scored_codes(coding)


def _values_of(spark: SparkSession, tree: Tree, kind: str, model, coding: Coding, names: list[str]) -> DataFrame:
    """(code, value): the log-likelihoods of all patterns of a coding, which no data take part in."""
    step = _scored_codes(coding)
    codes = spark.range(0, coding.space, step, 1 + coding.space // step // 8192).withColumnRenamed("id", "code")  # few tasks
    sites = _phased(alignment.decoded(codes, coding.digits), coding).where(F.col(names[0]).isin(*BASES, "N"))
    if kind in ("RCO", "TRCO"):
        scored = context_likelihood(with_context(sites, names[0], coding.order, "ctx"), tree, model, F.col, kind, "ctx", "value")
    else:
        keyed, _, engine = _keyed(sites, tree, model, kind, names, coding.order, ["code"], "value")
        scored = engine(keyed.repartition("code"))  # contexts are computed once, not wherever the engine names them
    return scored.select("code", "value")


def _by_values(tracks: DataFrame, tree: Tree, engines: list[tuple], names: list[str]) -> DataFrame:
    """(frame, n, total) of the sum of engines (kind, model, coding) with few patterns each: the columns are read and counted
    once for all engines, and each count meets its pattern's value, which is broadcast."""
    spark, codings = tracks.sparkSession, [c for _, _, c in engines]
    values, at, first = [], F, 0
    for kind, model, coding in engines:
        values.append(_values_of(spark, tree, kind, model, coding, names).withColumn("code", F.col("code") + first))
        at, first = at.when(F.col("code") < first + coding.space, F.col("code") - (F.col("code") - first) % _scored_codes(coding)), first + coding.space
    table = reduce(DataFrame.union, values).withColumnRenamed("code", "_at")
    counts = alignment.coded_columns(tracks, codings).withColumn("_at", at).join(F.broadcast(table), "_at")
    n = F.when(F.col("code") < codings[0].space, F.col("n")).otherwise(0)  # every engine scores the same columns
    return counts.select((F.col("code") % 3).cast("int").alias("frame"), n.alias("n"), (F.col("n") * F.col("value")).alias("total"))


def _by_root_context(sites: DataFrame, tree: Tree, model: ContextModel, kind: str, names: list[str], order: int, out: str) -> DataFrame:
    """RCO and TRCO of columns with the target's left neighbours, and their phase in a periodic model."""
    sites = with_context(sites, names[0], order, "ctx").withColumn("ctx", trimmed(F.col("ctx"), model))
    return with_likelihood(sites, names, lambda df: context_likelihood(df, tree, model, F.col, kind, "ctx", out), known_contexts(sites.sparkSession, model), out)


def _keyed(sites: DataFrame, tree: Tree, model, kind: str, names: list[str], order: int, ids: list[str], out: str):
    """The ids of columns with the keys that an engine needs, the keys, and the engine, which takes rows with the keys."""
    periodic, gaps = kind != "NMER" and model.periodic, kind != "NMER" and states_of(model) == GAPS
    if gaps:
        whole = lambda n: F.concat(F.lit(""), *(gap_state(F.col(f"{n}_l{k}")) for k in range(order, 0, -1)))
        sites = sites.select(*ids, *["phase"] * periodic, *(gap_state(F.col(n)).alias(n) for n in names), *(trimmed(whole(n), model).alias(f"{n}_ctx") for n in names))
        keys = names + [f"{n}_ctx" for n in names] + ["phase"] * periodic
        return sites, keys, lambda df: leaf_context_likelihood(df, tree, model, F.col, lambda n: F.col(f"{n}_ctx"), out)
    if kind == "LCO":
        for n in names:
            sites = with_context(sites, n, order, f"{n}_ctx").withColumn(f"{n}_ctx", trimmed(F.col(f"{n}_ctx"), model))
        keys = names + [f"{n}_ctx" for n in names] + ["phase"] * periodic
        sites = sites.select(*ids, *(normal(F.col(k)).alias(k) if k in names else F.col(k) for k in keys))
        return sites, keys, lambda df: leaf_context_likelihood(df, tree, model, F.col, lambda n: F.col(f"{n}_ctx"), out)
    if kind == "MP":
        # states of a column depend on that column alone, so the columns to its left are resolved beside it
        inner = [x.name for x in tree.nodes if x.kind == "INTERNAL"]
        keys = [c for n in names for c in (n, *(f"{n}_l{k}" for k in range(1, order + 1)))]
        left = lambda n: F.regexp_extract(F.concat(F.lit(""), *(F.col(f"{n}_l{k}") for k in range(order, 0, -1))), "([ACGT]*)$", 1)

        def engine(df):
            before = df.columns
            for k in range(order, -1, -1):
                here = (lambda n, k=k: F.col(f"{n}_l{k}")) if k else F.col
                df = fitch(df, tree, here)
                df = df.withColumnsRenamed({n: f"{n}_l{k}" if k else n for n in inner}) if k else df
            return fitch_likelihood(df, tree, model, F.col, left, out).select(*before, out)

        return sites.select(*ids, *(normal(F.col(c)).alias(c) for c in keys)), keys, engine
    whole = lambda n: F.concat(*(F.col(f"{n}_l{k}") for k in range(order, 0, -1)), F.col(n))
    # the slice begins after the target's last gap before the column, and at the block's start
    width = F.length(F.regexp_extract(whole(names[0]), "([ACGT]*)$", 1))
    sites = sites.withColumn("_n", width).select(*ids, *(F.right(F.regexp_replace(whole(n), "[^ACGT]", "-"), F.col("_n")).alias(n) for n in names))
    tables = nmer_tables(tree, model.rates(), model.eq) if kind == "NMER" else context_tables(tree, model)
    return sites, names, lambda df: slice_likelihood(df, tree, tables, out)


def pattern_table(spark: SparkSession, names: list[str], engine: Callable[[DataFrame], DataFrame], columns: list[str]) -> np.ndarray:
    """What an engine adds to all patterns of the names as an array, a row for each number in base 5 of a pattern of A C G T
    and -, the first name's digit lowest. At most TABULATED rows come to the driver."""
    out = [None] * 5 ** len(names)
    for r in engine(all_patterns(spark, names)).select(*names, *columns).collect():
        out[sum((BASES + "-").index(r[n]) * 5**k for k, n in enumerate(names))] = [r[c] for c in columns]
    return np.array(out)


def _mp_by_frame(tracks: DataFrame, tree: Tree, model: ContextModel, names: list[str], order: int) -> DataFrame:
    """MP: every pattern's ancestors are tabulated, and what is counted of a column is, for each branch, the parent's state
    and the ones left of it, and the child's. A few thousand counts hold all columns."""
    n, branches = len(names), tree.branches()
    inner = [x.name for x in tree.nodes if x.kind == "INTERNAL"]
    found = pattern_table(tracks.sparkSession, names, lambda df: fitch(df, tree, F.col), inner)
    states = np.array([[BASES.find(x) % 5 for x in row] for row in found], np.int64)
    ends = [[("leaf", names.index(x.name)) if x.name in names else ("inner", inner.index(x.name)) for x in b[:2]] for b in branches]
    held = tracks.sparkSession.sparkContext.broadcast(states)
    width, cells_of_branch = alignment.STRETCH, 5 ** (order + 2)
    table = alignment.BASE_CODES.astype(np.uint8)

    def codes_of(batch):
        cells, frame, _ = alignment.laid_out(batch, n, order, width)
        whole = [table[x] for x in cells]
        keep = np.flatnonzero((whole[0] < 4) & (frame < 3))
        rows = held.value[sum(x * np.int64(5**k) for k, x in enumerate(whole))]
        symbol = {("leaf", k): x for k, x in enumerate(whole)} | {("inner", k): rows[:, k] for k in range(len(inner))}
        frame = frame[keep].astype(np.int64)
        yield frame
        for b, (parent, child) in enumerate(ends, 1):
            code = symbol[child][keep].astype(np.int64)
            for j in range(order + 1):
                code = code * 5 + symbol[parent][keep - j]
            yield 3 * (code + cells_of_branch * b) + frame

    df = alignment.ragged(tracks, n, order).where("s0 <> ''")
    df = df.select("phase", "stretch", *(f"s{k}" for k in range(n)), *(f"h{k}" for k in range(n if order else 0)))
    counts = alignment.code_counts(df, codes_of, 3 * cells_of_branch * (len(branches) + 1), n)
    # the farthest column before is the lowest digit, then the nearer ones, the parent, the child
    symbols = [*BASES, "-"]
    digits = [("frame", [0, 1, 2]), *((f"l{k}", symbols) for k in range(order, 0, -1)), ("parent", symbols), ("child", symbols), ("branch", list(range(len(branches) + 1)))]
    rows = alignment.decoded(counts, digits).withColumn("ctx", F.regexp_extract(F.concat(F.lit(""), *(F.col(f"l{k}") for k in range(order, 0, -1))), "([ACGT]*)$", 1))
    rows = rows.withColumn("_key", F.concat(F.col("branch").cast("string"), F.lit(":"), trimmed(F.col("ctx"), model), F.lit(">"), "parent", "child"))
    logs = [(f"{b}:{c}>{x}{y}", float(v)) for b, (_, _, d) in enumerate(branches, 1) for (f, c), m in model.models.items() if f == 0 for x, row in zip(BASES, np.log(m.at(d)), strict=True) for y, v in zip(BASES, row, strict=True)]
    if len(logs) > 16 * TABULATED:
        raise ValueError(f"more than {TABULATED} contexts")
    table = F.broadcast(small_table(tracks.sparkSession, logs, [("_key", pa.string()), ("_log", pa.float64())]))
    scored = rows.join(table, "_key", "left")
    return scored.select("frame", F.when(F.col("branch") == 0, F.col("n")).otherwise(0).alias("n"), F.when(F.col("branch") == 0, 0.0).otherwise(F.col("n") * F.coalesce("_log", F.lit(0.0))).alias("total"))


def gap_rewriting(tracks: DataFrame, tree: Tree, nucleotides: ContextModel, gaps: ContextModel, names: list[str], out: str = "ll") -> DataFrame:
    """Composite of a column: RCO under the model of bases plus LCO under the model of gap patterns, whose states are N - .
    (a second model of bases is scored over bases)."""
    one = evaluate(tracks, tree, nucleotides, "RCO", names, "_rco")
    return one.join(evaluate(tracks, tree, gaps, "LCO", names, "_lco"), ["block", "col"]).select("block", "col", (F.col("_rco") + F.col("_lco")).alias(out))


def gap_rewriting_by_frame(tracks: DataFrame, tree: Tree, nucleotides: ContextModel, gaps: ContextModel, names: list[str]) -> DataFrame:
    """The composite as (frame, n, total), in parts to be summed: both score the same columns, which count once. Where the
    patterns of both are few, one pass counts the columns for both."""
    served = [_served(nucleotides, "RCO"), _served(gaps, "LCO")]
    engines = [(kind, model, _coding(model, kind, names, order)) for kind, model, order in served]
    if all(_few(c) for _, _, c in engines):
        return _by_values(tracks, tree, engines, names)
    one = evaluate_by_frame(tracks, tree, nucleotides, "RCO", names)
    return one.union(evaluate_by_frame(tracks, tree, gaps, "LCO", names).withColumn("n", F.lit(0).cast("long")))


def running_phase(tracks: DataFrame, n: int) -> DataFrame:
    """The tracks with each block's phase as it runs on over the ends of blocks, laid end to end in the order of numbers."""
    starts = concatenated(tracks, n).select("block", (F.col("start") % 3).cast("int").alias("phase"))
    return tracks.drop("phase").join(starts, "block")


def less_ancestral(tracks: DataFrame, tree: Tree, model: ContextModel, context_type: str, names: list[str]) -> DataFrame:
    """One row: the log-likelihood of all columns by an engine less that by ACO."""
    total = lambda kind: evaluate_by_frame(tracks, tree, model, kind, names).agg(F.sum("total").alias(kind))
    return total(context_type).crossJoin(F.broadcast(total("ACO"))).select((F.col(context_type) - F.col("ACO")).alias("difference"))  # one row each


# -- over columns ---------------------------------------------------------------------------------------------------


def by_frame(columns: DataFrame, ll: str = "ll", weight: str | None = None) -> DataFrame:
    """(frame, n, total, mean) of column log-likelihoods by col % 3."""
    n = F.col(weight) if weight else F.lit(1)
    sums = columns.groupBy((F.col("col") % 3).cast("int").alias("frame")).agg(F.sum(n).cast("long").alias("n"), F.sum(F.col(ll) * n).alias("total"))
    return sums.withColumn("mean", F.col("total") / F.col("n"))


def best_frame(columns: DataFrame, ll: str = "ll", weight: str | None = None) -> DataFrame:
    """The total of the frame of highest mean; ties to the lower frame."""
    top = F.max(F.struct(F.col("mean"), (-F.col("frame")).alias("neg"), F.col("total"))).alias("m")
    return by_frame(columns, ll, weight).agg(top).select((-F.col("m.neg")).cast("int").alias("frame"), F.col("m.total").alias("total"))


def prefix_sums(columns: DataFrame, ll: str = "ll") -> DataFrame:
    """(block, col, cum): running sums within each block, for range queries by two look-ups: sums within stretches, and the
    sums of the stretches before, which a table with a row for each stretch carries."""
    cut = columns.select("block", stretch_of(F.col("col")).alias("stretch"), "col", F.col(ll).alias("_ll"))
    w = Window.partitionBy("block", "stretch").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    before = carried(cut.groupBy("block", "stretch").agg(F.sum("_ll").alias("_sum")), "_sum", "_before")
    within = cut.select("block", "stretch", "col", F.sum("_ll").over(w).alias("_cum"))
    return within.join(before, ["block", "stretch"]).select("block", "col", (F.col("_before") + F.col("_cum")).alias("cum"))


def cumulative(columns: DataFrame, ll: str = "ll") -> DataFrame:
    """(block, col, cum): running sums over all blocks in order. Sums within blocks, then over blocks by stretches of their
    numbers, so no task sees all columns."""
    within = prefix_sums(columns, ll)
    offsets = block_offsets(columns.groupBy("block").agg(F.sum(ll).alias("n"))).select("block", "offset")
    return within.join(offsets, "block").select("block", "col", (F.col("offset") + F.col("cum")).alias("cum"))


def block_offsets(totals: DataFrame) -> DataFrame:
    """(block, n, offset) of totals (block, n): what the blocks before hold together."""
    totals = totals.withColumn("stretch", F.floor(F.col("block") / 4096))
    stretches = totals.groupBy("stretch").agg(F.sum("n").alias("n"))
    before = stretches.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # a row for 4096 blocks
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return totals.withColumn("earlier", earlier).join(before, "stretch").select("block", "n", (F.col("before") + F.col("earlier")).alias("offset"))


#: Columns of the index of tracks between two of its running sums.
MARK = 32


def track_index(tracks: DataFrame, n: int, table: np.ndarray) -> DataFrame:
    """(block, stretch, codes, marks, total, used): prefix sums of the columns' log-likelihoods as the numbers of their patterns,
    two bytes each, and the running sum within the stretch before every MARK of them; the stretch's sum, and how many columns
    have a base in track 0. table: the value of each pattern's number, as pattern_table has it (32,768 at most)."""
    if len(table) > 1 << 15:
        raise ValueError("more patterns than two bytes tell apart")
    held = tracks.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            codes, marks, total, used = [], [], [], []
            for raw in zip(*(raw_bytes(batch.column(2 + k)) for k in range(n)), strict=True):
                each = [alignment.BASE_CODES[x] for x in raw]
                code = sum(x * 5**k for k, x in enumerate(each))
                sums = np.add.reduceat(held.value[code], np.arange(0, len(code), MARK))
                codes.append(code.astype(np.int16))
                marks.append(np.concatenate([[0.0], np.cumsum(sums)[:-1]]))
                total.append(float(sums.sum()))
                used.append(int((each[0] < 4).sum()))
            arrays = [pa.array(codes, pa.list_(pa.int16())), pa.array(marks, pa.list_(pa.float64())), pa.array(total, pa.float64()), pa.array(used, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["block", "stretch", "codes", "marks", "total", "used"])

    df = alignment.stretches(tracks, n).select("block", "stretch", *(f"s{k}" for k in range(n)))
    return alignment.in_batches(df, run, "block long, stretch int, codes array<short>, marks array<double>, total double, used long", n)


def track_sums(index: DataFrame, ranges: DataFrame, table: np.ndarray) -> DataFrame:
    """indexed_sums over a track_index that was written: two of its rows for a range, and MARK values at most of each."""
    rows = index.select("block", "stretch", "total")
    before = carried(rows, "total", "before")
    last = rows.groupBy("block").agg(F.max("stretch").alias("_last"))
    asked = ranges.join(last, "block").withColumn("_id", F.struct(*ranges.columns))
    ends = asked.select("block", "_id", "_last", F.explode(F.array(F.struct((F.col("begin") - 1).alias("p"), F.lit(-1.0).alias("sign")), F.struct((F.col("end") - 1).alias("p"), F.lit(1.0).alias("sign")))).alias("e"))
    ends = ends.select("block", "_id", "e.*", F.least(F.greatest(stretch_of(F.col("e.p")), F.lit(0)), F.col("_last")).alias("stretch")).distinct()
    found = ends.join(before, ["block", "stretch"]).join(index.select("block", "stretch", "codes", "marks"), ["block", "stretch"])
    place = F.greatest(F.least((F.col("p") - F.col("stretch") * alignment.STRETCH).cast("int"), F.size("codes") - 1), F.lit(0))
    values = F.array(*map(_lit, table))
    few = F.slice("codes", (F.col("_place") - F.col("_place") % MARK + 1).cast("int"), (F.col("_place") % MARK + 1).cast("int"))
    within = F.get("marks", F.floor(F.col("_place") / MARK).cast("int")) + F.aggregate(few, F.lit(0.0), lambda s, c: s + F.get(values, c.cast("int")))
    value = F.when(F.col("p") >= 0, F.col("before") + within).otherwise(0.0)
    return found.withColumn("_place", place).select("_id", (F.col("sign") * value).alias("v")).groupBy("_id").agg(F.sum("v").alias("total")).select("_id.*", "total")


def range_sum(sums: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (block, begin, end) -> total over [begin, end): difference of two prefix sums, 0 before the start."""
    at = lambda c: sums.select("block", (F.col("col") + 1).alias(c), F.col("cum").alias(f"_{c}"))
    df = ranges.join(at("end"), ["block", "end"], "left").join(at("begin"), ["block", "begin"], "left")
    return df.select("block", "begin", "end", (F.coalesce("_end", F.lit(0.0)) - F.coalesce("_begin", F.lit(0.0))).alias("total"))


def prefix_index(columns: DataFrame, ll: str = "ll") -> DataFrame:
    """(block, stretch, before, cum): the prefix sums as a file holds them, a row for each stretch: the running sums of its
    columns as an array, 0 where a column is not there, and the sum of the stretches before it. Written as Parquet in the
    order of (block, stretch), a range is read from the row groups that hold its two ends."""
    cells = columns.select("block", stretch_of(F.col("col")).alias("stretch"), F.struct(F.col("col"), F.col(ll).alias("ll")).alias("cell"))
    rows = cells.groupBy("block", "stretch").agg(F.collect_list("cell").alias("cells"))  # a stretch's columns at most
    size = alignment.STRETCH

    def run(batches):
        for batch in batches:
            sums = []
            for stretch, cells in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = cells.values
                at = flat.field("col").to_numpy() - stretch * size
                each = np.zeros(int(at.max()) + 1)
                each[at] = flat.field("ll").to_numpy()
                sums.append(np.cumsum(each))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.list_(pa.float64()))], names=["block", "stretch", "cum"])

    found = rows.mapInArrow(run, "block long, stretch int, cum array<double>")
    every = found.groupBy("block").agg(F.max("stretch").alias("n")).select("block", F.explode(F.sequence(F.lit(0), "n")).alias("stretch"))  # one without columns too
    index = every.join(found, ["block", "stretch"], "left").withColumn("cum", F.coalesce("cum", F.expr("cast(array() as array<double>)")))
    sums = index.select("block", "stretch", F.coalesce(F.get("cum", F.size("cum") - 1), F.lit(0.0)).alias("_sum"))
    return index.join(carried(sums, "_sum", "before"), ["block", "stretch"]).select("block", "stretch", "before", "cum")


def indexed_sums(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges (block, begin, end, ...) with the total over the columns [begin, end), from two rows of the index each.
    Columns that the index lacks count as 0; ranges of blocks that it lacks are left out; repeated ranges come once."""
    last = index.groupBy("block").agg(F.max("stretch").alias("_last"))
    rows = ranges.join(last, "block").withColumn("_id", F.struct(*ranges.columns))
    ends = rows.select("block", "_id", "_last", F.explode(F.array(F.struct((F.col("begin") - 1).alias("p"), F.lit(-1.0).alias("sign")), F.struct((F.col("end") - 1).alias("p"), F.lit(1.0).alias("sign")))).alias("e"))
    ends = ends.select("block", "_id", "e.*", F.least(F.greatest(stretch_of(F.col("e.p")), F.lit(0)), F.col("_last")).alias("stretch"))
    place = F.least((F.col("p") - F.col("stretch") * alignment.STRETCH).cast("int"), F.size("cum") - 1)
    value = F.when(F.col("p") >= 0, F.col("before") + F.coalesce(F.get("cum", place), F.lit(0.0))).otherwise(0.0)
    found = ends.distinct().join(index, ["block", "stretch"]).select("_id", (F.col("sign") * value).alias("v"))
    return found.groupBy("_id").agg(F.sum("v").alias("total")).select("_id.*", "total")


def predict_phase(by_phase: DataFrame) -> DataFrame:
    """(model, frame, total) -> the phase whose shifted assignment of the three models has the highest total."""
    rows = by_phase.withColumn("phase", ((F.col("model") + 3 - F.col("frame")) % 3).cast("int"))
    return rows.groupBy("phase").agg(F.sum("total").alias("total")).agg(F.max(F.struct(F.col("total"), (-F.col("phase")).alias("neg"))).alias("m")).select((-F.col("m.neg")).cast("int").alias("phase"), F.col("m.total").alias("total"))
