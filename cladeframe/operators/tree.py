"""Phylogenies: an immutable tree on the driver (trees have few nodes) and its table form for set-based queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "node_id int, name string, kind string, parent_id int, child_ix int, branch_len double, n_leaves int"


@dataclass(frozen=True)
class Node:
    name: str
    children: list[tuple[Node, float]] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return ("LEAF", "ROOT", "INTERNAL")[min(len(self.children), 2)]

    def walk(self) -> Iterator[Node]:
        """Children first, left to right."""
        for child, _ in self.children:
            yield from child.walk()
        yield self

    def leaves(self) -> list[str]:
        return [x.name for x in self.walk() if not x.children]


class Tree:
    """A rooted tree; a root with one child is a taxon of its own (the target)."""

    def __init__(self, root: Node):
        self.root = root
        self.nodes = list(root.walk())
        self.ids = {id(x): k for k, x in enumerate(self.nodes)}
        self.parent = {id(c): (p, d, ix) for p in self.nodes for ix, (c, d) in enumerate(p.children)}

    def find(self, name: str) -> Node:
        found = [x for x in self.nodes if x.name == name]
        if not found:
            raise KeyError(name)
        return found[-1]

    def visit(self, visitor: Callable[[Node], None], order: str = "post") -> None:
        def pre(x: Node) -> Iterator[Node]:
            yield x
            for c, _ in x.children:
                yield from pre(c)

        for x in self.nodes if order == "post" else pre(self.root):
            visitor(x)

    def leaves(self) -> list[str]:
        """Taxa at the leaves, and the root of a tree whose root is a taxon."""
        return self.root.leaves()

    def taxa(self) -> list[str]:
        return ([self.root.name] if self.root.kind == "ROOT" else []) + self.leaves()

    def clade(self, node: Node) -> set[str]:
        return {x.name for x in node.walk()}

    def branches(self) -> list[tuple[Node, Node, float]]:
        """(parent, child, length), parents first."""
        out: list[tuple[Node, Node, float]] = []
        self.visit(lambda x: out.extend((x, c, d) for c, d in x.children), "pre")
        return out

    def climb(self, name: str) -> list[tuple[str, float]]:
        """The node and its ancestors with the distance to each."""
        x, far, out = self.find(name), 0.0, []
        while True:
            out.append((x.name, far))
            if id(x) not in self.parent:
                return out
            x, d, _ = self.parent[id(x)]
            far += d

    def distance(self, a: str, b: str) -> float:
        up = dict(self.climb(a))
        return next(far + up[name] for name, far in self.climb(b) if name in up)

    def path(self, a: str, b: str) -> list[str]:
        up = [n for n, _ in self.climb(a)]
        down = [n for n, _ in self.climb(b)]
        top = next(n for n in up if n in down)
        return up[: up.index(top) + 1] + down[: down.index(top)][::-1]

    def spanned(self, a: str, b: str, c: str) -> float:
        return (self.distance(a, b) + self.distance(b, c) + self.distance(c, a)) / 2

    def leaf_distances(self) -> dict[tuple[str, str], float]:
        names = self.leaves()
        return {(a, b): self.distance(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}

    def scaled(self, factor: float) -> Tree:
        return self.with_lengths(lambda child, d: d * factor)

    def with_lengths(self, new: Callable[[str, float], float]) -> Tree:
        def copy(x: Node) -> Node:
            return Node(x.name, [(copy(c), new(c.name, d)) for c, d in x.children])

        return Tree(copy(self.root))

    def rerooted(self, leaf: str) -> Tree:
        """The leaf becomes a root with one child; the old root, left with one neighbour below, is spliced out."""
        if self.root.kind == "ROOT":
            raise ValueError("a tree whose root is a taxon cannot be rooted anew")
        found = self.find(leaf)
        if found.children:
            raise ValueError(f"{leaf} is no leaf")

        def turned(x: Node, came: Node) -> tuple[Node, float]:
            """x seen from its child `came`, and how far below came's end its own subtree hangs extra."""
            rest = [(c, d) for c, d in x.children if c is not came]
            if id(x) not in self.parent:
                (only, d) = rest[0]
                return only, d
            up, d, _ = self.parent[id(x)]
            node, extra = turned(up, x)
            return Node(x.name, [*rest, (node, d + extra)]), 0.0

        up, d, _ = self.parent[id(found)]
        node, extra = turned(up, found)
        return Tree(Node(leaf, [(node, d + extra)]))

    def pruned(self, keep: set[str]) -> Tree:
        """Without the other leaves; nodes left with one child are spliced out, lengths added up."""

        def cut(x: Node) -> tuple[Node, float] | None:
            if not x.children:
                return (x, 0.0) if x.name in keep else None
            left = [(got[0], got[1] + d) for c, d in x.children if (got := cut(c))]
            if x.kind == "ROOT":
                return (Node(x.name, left), 0.0) if left else None
            if not left:
                return None
            return left[0] if len(left) == 1 else (Node(x.name, left), 0.0)

        found = cut(self.root)
        if not found:
            raise ValueError("no leaf is kept")
        return Tree(found[0])

    # -- formats -----------------------------------------------------------------------------------------------------

    def to_phy(self) -> str:
        def lines(x: Node) -> Iterator[str]:
            yield x.kind
            yield x.name
            for c, d in x.children:
                yield repr(d)
                yield from lines(c)

        return "\n".join(lines(self.root)) + "\n"

    @classmethod
    def from_phy(cls, text: str) -> Tree:
        tokens = iter(text.split())

        def take() -> Node:
            kind, name = next(tokens), next(tokens)
            children = []
            for _ in range({"LEAF": 0, "ROOT": 1, "INTERNAL": 2}[kind]):
                d = float(next(tokens))
                children.append((take(), d))
            return Node(name, children)

        return cls(take())

    def to_newick(self) -> str:
        def one(x: Node) -> str:
            inner = ",".join(f"{one(c)}{c.name}:{d:g}" for c, d in x.children)
            return f"({inner})" if inner else ""

        return f"{one(self.root)}{self.root.name};"

    def to_nexus(self, name: str = "tree") -> str:
        return f"#NEXUS\nBegin trees;\ntree {name} = {self.to_newick()}\nEnd;\n"

    @classmethod
    def from_newick(cls, text: str) -> Tree:
        """One tree, or the first one of a NEXUS text; unnamed inner nodes become A1, A2, ..., a missing length 0."""
        if found := re.search(r"(?:tree[^=\n]*=|TREE:)\s*(?:\[[^\]]*\]\s*)?(\(.*)", text, re.I):
            text = found[1].split("\n")[0]
        tokens = re.findall(r"[(),;]|:\s*[-+.\deE]+|[^\s(),;:]+", text.strip())
        at, made = 0, 0

        def take() -> tuple[Node, float]:
            nonlocal at, made
            children: list[tuple[Node, float]] = []
            if tokens[at] == "(":
                at += 1
                while True:
                    children.append(take())
                    at += 1
                    if tokens[at - 1] == ")":
                        break
            name, d = "", 0.0
            if at < len(tokens) and tokens[at] not in "(),;" and not tokens[at].startswith(":"):
                name, at = tokens[at], at + 1
            if at < len(tokens) and tokens[at].startswith(":"):
                d, at = float(tokens[at][1:]), at + 1
            if not name and children:
                made += 1
                name = f"A{made}"
            return Node(name, children), d

        return cls(take()[0])

    def to_graph(self) -> str:
        out = []
        for x in self.nodes:
            out.append(f"{x.kind} {x.name}")
            if id(x) in self.parent:
                p, d, _ = self.parent[id(x)]
                out.append(f"{x.name} -> {p.name} : {d:g}")
        return "\n".join(out) + "\n"

    def rows(self) -> list[tuple]:
        def up(x: Node) -> tuple:
            if id(x) not in self.parent:
                return None, 0, None
            p, d, ix = self.parent[id(x)]
            return self.ids[id(p)], ix, float(d)

        return [(k, x.name, x.kind, *up(x), len(x.leaves())) for k, x in enumerate(self.nodes)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    def values_sql(self) -> str:
        """The table as a VALUES list, for SQL of any engine."""
        q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
        return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in self.rows())


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, dist, depth) of every node, itself included, by a recursive query over the node table."""
    return nodes.sparkSession.sql("""
        WITH RECURSIVE up AS (
          SELECT node_id AS node, node_id AS ancestor, cast(0 AS double) AS dist, 0 AS depth FROM {nodes}
          UNION ALL
          SELECT u.node, t.parent_id, u.dist + t.branch_len, u.depth + 1 FROM up u JOIN {nodes} t ON u.ancestor = t.node_id WHERE t.parent_id IS NOT NULL)
        SELECT * FROM up""", nodes=nodes)


def leaf_distances(nodes: DataFrame) -> DataFrame:
    """(a, b, d) of all leaf pairs a < b: through the ancestor that both share nearest."""
    from pyspark.sql import functions as F

    up = ancestors(nodes).join(nodes.where("kind = 'LEAF'").select(F.col("node_id").alias("node"), "name"), "node")
    other = up.select("ancestor", F.col("name").alias("b"), F.col("dist").alias("e"))
    return up.join(other, "ancestor").where("name < b").groupBy(F.col("name").alias("a"), "b").agg(F.round(F.min(F.col("dist") + F.col("e")), 9).alias("d"))


def clades(nodes: DataFrame) -> DataFrame:
    """(name, n_members, members): the nodes at or below each node, by rising id; trees may have any number of nodes."""
    from pyspark.sql import functions as F

    up = ancestors(nodes).groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("node")).alias("members"))
    return nodes.join(up, "node_id").select("name", "n_members", "members")


def branch_ids(tree: Tree) -> list[tuple[int, str, str]]:
    """(number, parent, child) of all branches, numbered from the root, each before those below it, left ones first."""
    order: list[Node] = []
    tree.visit(order.append, "pre")
    return [(k, tree.parent[id(x)][0].name, x.name) for k, x in enumerate(x for x in order if id(x) in tree.parent)]
