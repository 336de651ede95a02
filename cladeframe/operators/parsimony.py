"""Ancestral states by parsimony: sets of states are bit masks (A 1, C 2, G 4, T 8) in columns, one per node."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import alignment
from cladeframe.operators.alignment import BASE_CODES, in_batches, raw_bytes, stretch_of
from cladeframe.operators.tree import Node, Tree

BASES = "ACGT"


def mask(sym: Column) -> Column:
    """One bit for a base, none for anything else."""
    return reduce(lambda a, k: a.when(sym == BASES[k], F.lit(1 << k)), range(4), F).otherwise(F.lit(0))


def lowest(states: Column) -> Column:
    """The first base of a set; `.` for the empty one."""
    return reduce(lambda a, k: a.when(states.bitwiseAND(F.lit(1 << k)) != 0, F.lit(BASES[k])), range(4), F).otherwise(F.lit("."))


#: Bit of a root taxon that holds no base: it is kept, after all bases.
NO_BASE = 16


def _up(tree: Tree, symbol_of, join) -> tuple[Column, dict[int, int]]:
    """An array with the set of every node, leaves first, and where each node stands in it. One fold over the tree's nodes,
    so the expression does not grow with the depth of the tree."""
    leaves = [x for x in tree.nodes if not x.children]
    inner = [x for x in tree.nodes if x.kind == "INTERNAL"]  # children first
    at = {id(x): k for k, x in enumerate([*leaves, *inner])}
    sets = F.array(*(mask(symbol_of(x.name)) for x in leaves))
    steps = F.array(*(F.struct(*(F.lit(at[id(c)]).alias(n) for n, (c, _) in zip("lr", x.children, strict=True))) for x in inner))
    return F.aggregate(steps, sets, lambda acc, n: F.concat(acc, F.array(join(F.get(acc, n["l"]), F.get(acc, n["r"]))))), at


def _down(sites: DataFrame, tree: Tree, symbol_of, join, rule, top: Column) -> tuple[DataFrame, dict[int, Column]]:
    """The sites with _F, the final set of every inner node from the top, each of one state at most, and where to find them.
    rule(S, L, R, Fa): a node's set before its tie is resolved; top: what the root taxon lends the node below it."""
    sets, at = _up(tree, symbol_of, join)
    order: list[Node] = []
    tree.visit(order.append, "pre")
    order = [x for x in order if x.kind == "INTERNAL"]
    place = {id(x): k for k, x in enumerate(order, 1)}
    above = lambda x: place.get(id(tree.parent[id(x)][0]), 0) if id(x) in tree.parent else -1
    numbers = lambda x: {"s": at[id(x)], "l": at[id(x.children[0][0])], "r": at[id(x.children[1][0])], "up": above(x)}
    steps = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in numbers(x).items())) for x in order))

    def final(acc, n):
        s, left, right = (F.get(F.col("_S"), n[k]) for k in "slr")
        found = F.when(n["up"] < 0, rule(s, left, right, None)).otherwise(rule(s, left, right, F.get(acc, n["up"])))
        return F.concat(acc, F.array(found.bitwiseAND(-found)))  # the lowest state alone

    df = sites.withColumn("_S", sets).withColumn("_F", F.aggregate(steps, F.array(top), final))
    return df, {id(x): F.get("_F", F.lit(k)) for k, x in enumerate(order, 1)}


def fitch(sites: DataFrame, tree: Tree, symbol_of) -> DataFrame:
    """Adds a column per inner node: its most parsimonious base (lowest on ties, `.` where nothing below has one).

    Up: intersection of the children's sets, else union. Down, from the top: with the parent's final set Fa, F = S & Fa;
    where that is not all of Fa, F = ((Sq | Sr) & Fa) | S if the children meet, else S | Fa. A tie is resolved at each node
    before its children are looked at, so Fa is always one state. A root taxon without a base lends its symbol to what
    would otherwise be empty.
    """

    def rule(s, a, b, fa):
        if fa is None:
            return s
        both = s.bitwiseAND(fa)
        return F.when(both == fa, both).when(a.bitwiseAND(b) != 0, a.bitwiseOR(b).bitwiseAND(fa).bitwiseOR(s)).otherwise(s.bitwiseOR(fa))

    join = lambda a, b: F.when(a.bitwiseAND(b) != 0, a.bitwiseAND(b)).otherwise(a.bitwiseOR(b))
    root = symbol_of(tree.root.name) if tree.root.kind == "ROOT" else F.lit(".")
    df, final = _down(sites, tree, symbol_of, join, rule, F.when(root.isin(*BASES), mask(root)).otherwise(F.lit(NO_BASE)))
    state = lambda f: F.when(f == NO_BASE, F.when(root.isin("-", "N"), root).otherwise(".")).otherwise(lowest(f))
    return df.select(*sites.columns, *(state(final[id(x)]).alias(x.name) for x in tree.nodes if x.kind == "INTERNAL"))


def single_gain(sites: DataFrame, tree: Tree, symbol_of) -> DataFrame:
    """Each state is gained once: up, unions; down, X = (L & R) | (parent & X), resolved at each node (lowest on ties)
    before its children are looked at. The node at the top, and the one under a root taxon, whose own residue takes no
    part in this rule, keep L & R; L and R are the sets of the way up."""
    rule = lambda s, a, b, fa: a.bitwiseAND(b) if fa is None else a.bitwiseAND(b).bitwiseOR(fa.bitwiseAND(s))
    df, final = _down(sites, tree, symbol_of, lambda a, b: a.bitwiseOR(b), rule, F.lit(0))
    return df.select(*sites.columns, *(lowest(final[id(x)]).alias(x.name) for x in tree.nodes if x.kind == "INTERNAL"))


def majority(sites: DataFrame, tree: Tree, symbol_of) -> DataFrame:
    """Residue counts bottom-up, gaps among the residues. A node whose counts have a unique highest is resolved and passes
    on that residue alone; another passes its counts on, and takes the residue of the nearest resolved node above. The node
    under a root that is a taxon counts the root's residue too and is always resolved, by the root's residue on a tie."""
    states = [*BASES, "-"]
    before, inner = sites.columns, [x for x in tree.nodes if x.kind == "INTERNAL"]
    df = sites
    for x in tree.nodes:
        c = f"_C{tree.ids[id(x)]}"
        if not x.children:
            df = df.withColumn(c, F.array(*((symbol_of(x.name) == b).cast("int") for b in states)))
        elif x.kind == "INTERNAL":
            a, b = (F.col(f"_C{tree.ids[id(k)]}") for k, _ in x.children)
            up = tree.parent.get(id(x))
            under = up is not None and up[0].kind == "ROOT"
            total = F.zip_with(a, b, lambda p, q: p + q)
            if under:
                total = F.zip_with(total, F.array(*((symbol_of(up[0].name) == b).cast("int") for b in states)), lambda p, q: p + q)
            df = df.withColumn("_sum", total).withColumn("_top", F.array_max("_sum"))
            one = (F.size(F.filter("_sum", lambda v: v == F.col("_top"))) == 1) & (F.col("_top") > 0)
            best = F.substring(F.lit("".join(states)), F.array_position(F.col("_sum"), F.col("_top")).cast("int"), F.lit(1))
            df = df.withColumn(f"_R{c}", F.when(one, best).otherwise(symbol_of(up[0].name) if under else F.lit(None).cast("string")))
            mine = F.array(*((F.col(f"_R{c}") == b).cast("int") for b in states))
            df = df.withColumn(c, F.when(F.col(f"_R{c}").isNotNull(), mine).otherwise(F.col("_sum")))
    order: list[Node] = []
    tree.visit(order.append, "pre")
    for x in order:
        if x.kind == "INTERNAL":
            up = tree.parent.get(id(x))
            above = F.lit(".") if up is None or up[0].kind == "ROOT" else F.col(f"_M{tree.ids[id(up[0])]}")
            df = df.withColumn(f"_M{tree.ids[id(x)]}", F.coalesce(f"_R_C{tree.ids[id(x)]}", above))
    return df.select(*before, *(F.col(f"_M{tree.ids[id(x)]}").alias(x.name) for x in inner))


def indel_runs(sites: DataFrame, parent: str, child: str) -> DataFrame:
    """(block, start, op, len): runs of I (only the child has a residue), D (only the parent), S (both), by columns.

    Runs are found within stretches. Only the first and the last run of a stretch can go on in another one, so those alone
    are put in order over a whole block, and joined where they meet with the same op."""
    have = lambda c: F.col(c).isin(*BASES)
    op = F.when(have(parent) & have(child), "S").when(have(child), "I").when(have(parent), "D")
    df = sites.select("block", stretch_of(F.col("col")).alias("stretch"), "col", op.alias("op")).where("op is not null")
    w = Window.partitionBy("block", "stretch").orderBy("col")
    df = df.withColumn("new", F.coalesce((F.lag("op").over(w) != F.col("op")).cast("int"), F.lit(1)))
    df = df.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy("block", "stretch", "run", "op").agg(F.min("col").alias("start"), F.count("*").alias("len"))
    runs = runs.withColumn("outer", (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("block", "stretch"))))
    return _joined(runs)


def _joined(runs: DataFrame) -> DataFrame:
    """Runs (block, stretch, op, start, len, outer) within stretches, joined over their ends."""
    over = Window.partitionBy("block").orderBy("start")
    meets = (F.lag("op").over(over) == F.col("op")) & (F.lag("stretch").over(over) != F.col("stretch"))
    ends = runs.where("outer").withColumn("new", F.coalesce((~meets).cast("int"), F.lit(1)))
    ends = ends.withColumn("run", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.groupBy("block", "run", "op").agg(F.min("start").alias("start"), F.sum("len").alias("len"))
    out = ("block", F.col("start").cast("int").alias("start"), "op", F.col("len").cast("long").alias("len"))
    return runs.where("not outer").select(*out).union(ends.select(*out))


def runs_in(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a stretch from who has a residue: op (0 S, 1 I, 2 D), start, len; columns where neither has one do not count."""
    at = np.flatnonzero(parent | child)
    op = np.where(parent[at] & child[at], 0, np.where(child[at], 1, 2))
    first = np.flatnonzero(np.diff(op, prepend=-1))
    return op[first].astype(np.int8), at[first].astype(np.int32), np.diff(first, append=len(op)).astype(np.int32)


def track_runs(tracks: DataFrame, parent: int, child: int) -> DataFrame:
    """indel_runs of two tracks: runs are found in numpy, a stretch at a time, so there is a row for a run and none for a column."""
    size = alignment.STRETCH

    def run(batches):
        for batch in batches:
            found = [runs_in(*(BASE_CODES[x] < 4 for x in pair)) for pair in zip(raw_bytes(batch.column(2)), raw_bytes(batch.column(3)), strict=True)]
            lists = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int8(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["block", "stretch", "op", "at", "len"])

    df = alignment.stretches(tracks, max(parent, child) + 1).select("block", "stretch", f"s{parent}", f"s{child}")
    df = in_batches(df, run, "block long, stretch int, op array<byte>, at array<int>, len array<int>")
    runs = df.select("block", "stretch", F.size("op").alias("_n"), F.posexplode(F.arrays_zip("op", "at", "len")).alias("_k", "r"))
    op = F.when(F.col("r.op") == 0, "S").when(F.col("r.op") == 1, "I").otherwise("D")
    return _joined(runs.select("block", "stretch", op.alias("op"), (F.col("stretch") * size + F.col("r.at")).alias("start"), F.col("r.len").alias("len"), ((F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1)).alias("outer")))


def append_history(ops: list[tuple[str, int]], more: list[tuple[str, int]]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for op, n in [*ops, *more]:
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        else:
            out.append((op, n))
    return out


def history_length(ops: list[tuple[str, int]], of: str) -> int:
    """Length of the parent (insertions left out) or of the child (deletions left out)."""
    return sum(n for op, n in ops if op != ("i" if of == "parent" else "d"))


def top_off(ops: list[tuple[str, int]], parent_length: int) -> list[tuple[str, int]]:
    short = parent_length - history_length(ops, "parent")
    return append_history(ops, [("s", short)]) if short > 0 else ops


# -- gap patterns -------------------------------------------------------------------------------------------------------


def sorted_gaps(gaps: Column) -> Column:
    """An array of (pos, len) by rising position; equal positions keep their order."""
    numbered = F.transform(gaps, lambda g, i: F.struct(g["pos"].alias("pos"), i.alias("i"), g["len"].alias("len")))
    return F.transform(F.array_sort(numbered), lambda g: F.struct(g["pos"].alias("pos"), g["len"].alias("len")))


def merged_gaps(one: Column, two: Column) -> Column:
    """Two sorted arrays of gaps as one; of equal positions those of `one` come first."""
    return sorted_gaps(F.concat(one, two))


def raised_gaps(gaps: Column, history: Column) -> Column:
    """Gaps of a child in the parent's coordinates, with the child's insertions as gaps of the parent.

    history: array of (op, len), op i, d or s. A gap inside a substituted stretch moves with it; one inside an insertion
    splits the insertion in two, before and after it, all at the insertion's place in the parent. One at the child's end
    stands at the parent's end. At one place the parts keep the child's order.
    """
    number = "array<struct<op:string,len:int,parent:int,child:int>>"
    start = F.struct(F.lit(0).alias("parent"), F.lit(0).alias("child"), F.expr(f"cast(array() as {number})").alias("out"))

    def placed(acc, h):
        here = F.struct(h["op"].alias("op"), h["len"].cast("int").alias("len"), acc["parent"].alias("parent"), acc["child"].alias("child"))
        step = lambda but: F.when(h["op"] == but, 0).otherwise(h["len"].cast("int"))
        return F.struct((acc["parent"] + step("i")).alias("parent"), (acc["child"] + step("d")).alias("child"), F.concat(acc["out"], F.array(here)).alias("out"))

    stretches = F.filter(F.aggregate(history, start, placed, lambda a: a["out"]), lambda h: h["op"] != "d")
    gaps = F.transform(gaps, lambda g, i: F.struct(g["pos"].alias("pos"), g["len"].alias("len"), i.alias("i")))
    # by the child's position, then parts of insertions before the gap that stands there, gaps at one place in their order
    entry = lambda pos, rank, i, parent, size: F.struct(pos.alias("at"), F.lit(rank).alias("rank"), i.alias("i"), parent.alias("pos"), size.alias("len"))
    inside = lambda h, g: (g["pos"] >= h["child"]) & (g["pos"] < h["child"] + h["len"])
    moved = F.flatten(F.transform(stretches, lambda h: F.transform(F.filter(gaps, lambda g: inside(h, g)), lambda g: entry(g["pos"], 1, g["i"], F.when(h["op"] == "i", h["parent"]).otherwise(h["parent"] + g["pos"] - h["child"]), g["len"]))))
    size = lambda but: F.aggregate(history, F.lit(0), lambda a, h: a + F.when(h["op"] == but, 0).otherwise(h["len"].cast("int")))
    child, parent = size("d"), size("i")
    moved = F.concat(moved, F.transform(F.filter(gaps, lambda g: g["pos"] >= child), lambda g: entry(g["pos"], 1, g["i"], parent, g["len"])))
    ends = lambda h: F.array_sort(F.array_distinct(F.concat(F.array(h["child"], h["child"] + h["len"]), F.transform(F.filter(gaps, lambda g: inside(h, g)), lambda g: g["pos"]))))

    def parts(h):
        cuts = ends(h)
        return F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda x, i: entry(x, 0, F.lit(0), h["parent"], F.get(cuts, i + 1) - x))

    made = F.flatten(F.transform(F.filter(stretches, lambda h: h["op"] == "i"), parts))
    # a part that begins where a gap stands follows that gap
    every = F.transform(F.concat(moved, made), lambda e: F.struct(e["at"].alias("at"), F.when((e["rank"] == 0) & F.exists(moved, lambda g: g["at"] == e["at"]), 2).otherwise(e["rank"]).alias("rank"), e["i"].alias("i"), e["pos"].alias("pos"), e["len"].alias("len")))
    return F.transform(F.filter(F.array_sort(every), lambda e: e["len"] > 0), lambda e: F.struct(e["pos"].alias("pos"), e["len"].alias("len")))


def histories(sites: DataFrame, tree: Tree) -> DataFrame:
    """(block, h_<child>...): along every branch of a tree whose nodes are columns of the sites, the history of the block as
    an array of (op, len): s both have a residue, i the child alone, d the parent alone; null where neither has one."""
    out = sites.select("block").distinct()
    for parent, child, _ in tree.branches():
        runs = indel_runs(sites, parent.name, child.name).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", F.lower("op").alias("op"), F.col("len").cast("int").alias("len")))).alias("r"))
        ops = F.transform("r", lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len")))
        out = out.join(runs.select("block", ops.alias(f"h_{child.name}")), "block", "left")
    return out


def carried_gaps(branches: DataFrame, tree: Tree) -> DataFrame:
    """(block, gaps): the insertions along all branches as gaps (pos, len) of the root, in its coordinates.

    Leaves have no gaps of their own. From the leaves up, a node has the gaps of its children raised along their branches,
    those of the first child before those of the second where they meet. branches: as histories gives them."""
    none = F.expr("cast(array() as array<struct<pos:int,len:int>>)")
    df = branches
    order: list[Node] = []
    tree.visit(order.append, "post")
    for x in order:
        raised = []
        for child, _ in x.children:
            gaps = F.col(f"_g{tree.ids[id(child)]}") if child.children else none
            raised.append(F.when(F.col(f"h_{child.name}").isNull(), none).otherwise(raised_gaps(gaps, F.col(f"h_{child.name}"))))
        if raised:
            df = df.withColumn(f"_g{tree.ids[id(x)]}", raised[0] if len(raised) == 1 else merged_gaps(*raised))
    return df.select("block", F.col(f"_g{tree.ids[id(tree.root)]}").alias("gaps"))


def raise_gaps(gaps: np.ndarray, op: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raised_gaps over arrays: rows (pos, len) of gaps by rising position and a history of op (0 s, 1 i, 2 d) and len. Two
    sorted searches and one sort, so the time follows the number of gaps and runs."""
    child, parent = np.cumsum(np.where(op == 2, 0, size)), np.cumsum(np.where(op == 1, 0, size))
    ends = (int(child[-1]), int(parent[-1])) if len(op) else (0, 0)
    begin, stand, here = child - size, parent - np.where(op == 1, 0, size), op != 2
    op, begin, stand, end = op[here], begin[here], stand[here], child[here]
    inside = gaps[gaps[:, 0] < ends[0]]
    late = gaps[len(inside) :]
    at = np.searchsorted(begin, inside[:, 0], "right") - 1
    moved = stand[at] + np.where(op[at] == 0, inside[:, 0] - begin[at], 0)
    added = op == 1
    cuts = np.unique(np.concatenate([begin[added], inside[op[at] == 1, 0]]))  # where a part of an insertion begins
    of = np.searchsorted(begin, cuts, "right") - 1
    until = np.minimum(np.append(cuts[1:], np.iinfo(np.int64).max), end[of])
    place = np.concatenate([inside[:, 0], cuts])
    rank = np.concatenate([np.zeros(len(inside), np.int64), np.ones(len(cuts), np.int64)])  # a part follows the gap where it begins
    rows = np.concatenate([np.stack([moved, inside[:, 1]], 1), np.stack([stand[of], until - cuts], 1)])
    rows = np.concatenate([rows[np.lexsort((rank, place))], np.stack([np.full(len(late), ends[1]), late[:, 1]], 1)])
    return rows[rows[:, 1] > 0]


def gaps_of_tracks(tracks: DataFrame, tree: Tree, names: list[str], present: np.ndarray) -> DataFrame:
    """(block, gaps): carried_gaps of the histories of tracks along all branches, in two passes: runs a stretch at a time, then
    a block's runs, which are fewer than its columns. present: whether each inner node, in the order of tree.nodes, has a base,
    a row for each pattern of A C G T and - as a number in base 5, the first name's digit lowest."""
    n, branches = len(names), tree.branches()
    inner = [x.name for x in tree.nodes if x.kind == "INTERNAL"]
    held = tracks.sparkSession.sparkContext.broadcast(present)
    pairs = [(parent.name, child.name) for parent, child, _ in branches]
    fields = [f"{c}{k}" for k in range(len(branches)) for c in "ol"]

    def found(batches):
        for batch in batches:
            out = [[] for _ in fields]
            for raw in zip(*(raw_bytes(batch.column(2 + k)) for k in range(n)), strict=True):
                codes = [BASE_CODES[x] for x in raw]
                rows = held.value[sum(x * 5**k for k, x in enumerate(codes))]
                have = {name: codes[k] < 4 for k, name in enumerate(names)} | {name: rows[:, k] for k, name in enumerate(inner)}
                for b, (parent, child) in enumerate(pairs):
                    op, _, size = runs_in(have[parent], have[child])
                    out[2 * b].append(op.tobytes())
                    out[2 * b + 1].append(size.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in out)], names=["block", "stretch", *fields])

    order: list[Node] = []
    tree.visit(order.append, "post")
    number = {id(c): k for k, (_, c, _) in enumerate(branches)}
    at = {id(x): k for k, x in enumerate(order)}
    steps = [[(at[id(c)], number[id(c)]) for c, _ in x.children] for x in order]  # numbers: ids do not outlive the driver
    none = np.zeros((0, 2), np.int64)

    def of_block(parts) -> np.ndarray:
        gaps = []
        for children in steps:
            raised = []
            for child, b in children:
                op = np.concatenate([np.frombuffer(p[f"o{b}"], np.int8) for p in parts])
                size = np.concatenate([np.frombuffer(p[f"l{b}"], np.int32) for p in parts]).astype(np.int64)
                first = np.flatnonzero(np.diff(op, prepend=-1))  # runs that go on over the ends of stretches
                raised.append(raise_gaps(gaps[child], op[first], np.add.reduceat(size, first)) if len(op) else none)
            every = np.concatenate([none, *raised])
            gaps.append(every[np.argsort(every[:, 0], kind="stable")])
        return gaps[-1]

    def carried(batches):
        for batch in batches:
            each = [of_block(sorted(row.as_py(), key=lambda p: p["stretch"])) for row in batch.column(1)]
            flat = np.concatenate(each).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(2)], ["pos", "len"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in each])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, cells)], names=["block", "gaps"])

    df = alignment.stretches(tracks, n).select("block", "stretch", *(f"s{k}" for k in range(n)))
    runs = in_batches(df, found, "block long, stretch int, " + ", ".join(f"{c} binary" for c in fields), n)
    whole = runs.groupBy("block").agg(F.collect_list(F.struct("stretch", *fields)).alias("parts"))
    return in_batches(whole, carried, "block long, gaps array<struct<pos:int,len:int>>", n)
