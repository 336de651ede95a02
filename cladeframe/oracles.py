"""The same queries in plain SQL over the same tables; likelihoods without site patterns, so those are tested too."""

from __future__ import annotations

from math import exp, log

from cladeframe.functions.models import Model
from cladeframe.operators.tree import Node
from cladeframe.plans.views import FOREST_SQL, TRACKS_SQL, tracks_sql
from cladeframe.queries import CONTEXTS, DUAL, GAP_CONTEXTS, HKY, JC, LADDER, LADDER_NAMES, NAMES, ORDER, PERIODIC, PHASES, TREE

BASES = "ACGT"
_WITH = f"WITH {TRACKS_SQL}"
_STARTS = "SELECT block, sum(len) OVER (ORDER BY block) - len AS start FROM (SELECT block, max(length(seq)) AS len FROM tracks GROUP BY block) WHERE len > 0"
_RESIDUE = "{0} NOT IN ('-', '.', '~', ' ')"


def _num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def _kept(condition: str) -> str:
    """Columns that hold the condition, put together again per block and track."""
    each = " UNION ALL ".join(f"SELECT block, CAST({k} AS INTEGER) AS track, coalesce(string_agg(replace(t{k}, '~', '-'), '' ORDER BY col) FILTER (WHERE {condition}), '') AS seq FROM wide GROUP BY block" for k in range(4))
    return f"{_WITH} SELECT block, track, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS seq_md5 FROM ({each})"


def _digest(seq: str, rest: str = "FROM tracks") -> str:
    return f"{_WITH} SELECT block, track, CAST(length(q) AS BIGINT) AS n, md5(q) AS seq_md5 FROM (SELECT block, track, {seq} AS q {rest})"


def _pairs(use: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{a}' AS t1, '{b}' AS t2, {a} AS x, {b} AS y FROM wide" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])
    return f"{_WITH}, p AS ({each}) SELECT t1, t2, CAST(sum(CASE WHEN x = y THEN 1 ELSE 0 END) AS BIGINT) AS matches, CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, round(CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS d FROM p WHERE {use} GROUP BY t1, t2"


_NJ = _pairs(f"{_RESIDUE.format('x')} AND {_RESIDUE.format('y')}")
_UPGMA = _pairs(f"x <> '~' AND y <> '~' AND NOT (x = y AND NOT ({_RESIDUE.format('x')}))")


def _closed(model: Model, t: float) -> list[list[float]]:
    """P(t) by closed forms, which nothing of the library takes part in: equal rates; rates by target; two rates."""
    if model.kind == "JC":
        (alpha,), pi = model.params, [0.25] * 4
        return [[pi[j] + ((i == j) - pi[j]) * exp(-4 * alpha * t) for j in range(4)] for i in range(4)]
    if model.kind == "FEL":
        (alpha,), pi = model.params, model.eq
        return [[(i == j) * exp(-alpha * t) + pi[j] * (1 - exp(-alpha * t)) for j in range(4)] for i in range(4)]
    # two rates after rescaling, ts + 2 tv = 0.999; without frequencies as four times the rate times a quarter
    ts, tv = (x * 0.999 / (model.params[0] + 2 * model.params[1]) * (4 if model.kind == "KIM" else 1) for x in model.params)
    pi = [0.25] * 4 if model.kind == "KIM" else model.eq
    kin = lambda i, j: i % 2 == j % 2
    pool = [sum(pi[j] for j in range(4) if kin(i, j)) for i in range(4)]
    slow = exp(-tv * t)
    fast = lambda j: exp(-(pool[j] * ts + (1 - pool[j]) * tv) * t)
    return [[pi[j] + pi[j] * (1 / pool[j] - 1) * slow + ((i == j) - pi[j] / pool[j]) * fast(j) if kin(i, j) else pi[j] * (1 - slow) for j in range(4)] for i in range(4)]


def _leaf(sym: str, p, a: int) -> str:
    return f"(CASE {sym} " + " ".join(f"WHEN '{b}' THEN {_num(p[a][j])}" for j, b in enumerate(BASES)) + " ELSE 1e0 END)"


def _below(node: Node, a: int, p_of) -> str:
    """Likelihood of what lies below a node in state a, as one nested expression."""
    parts = []
    for c, d in node.children:
        p = p_of(c, d)
        parts.append(_leaf(c.name, p, a) if not c.children else "(" + " + ".join(f"{_num(p[a][b])} * {_below(c, b, p_of)}" for b in range(4)) + ")")
    return "(" + " * ".join(parts) + ")"


def _ll(p_of) -> str:
    """ln P(others | root residue): the unary root's row of the branch below it."""
    return "CASE t0 " + " ".join(f"WHEN '{b}' THEN ln({_below(TREE.root, a, p_of)})" for a, b in enumerate(BASES)) + " ELSE 0e0 END"


def _plain(model: Model):
    return lambda c, d: _closed(model, d)


_USABLE = "t0 IN ('A', 'C', 'G', 'T')"
_CTX = "regexp_extract(" + " || ".join(f"coalesce(lag(t0, {k}) OVER w, '')" for k in range(ORDER, 0, -1)) + ", '([ACGT]*)$', 1)"


def _contextual(engine: str) -> str:
    top = TREE.root.children[0][0]

    def p_of(model):
        return _plain(model) if engine == "TRCO" else (lambda c, d: _closed(model if c is top else JC, d))

    cases = " ".join(f"WHEN '{c}' THEN {_ll(p_of(m))}" for (_, c), m in CONTEXTS.models.items())
    ctx = "regexp_extract(coalesce(lag(t0, 1) OVER w, ''), '([ACGT]*)$', 1)"
    return f"{_WITH}, c AS (SELECT *, {ctx} AS ctx FROM wide WINDOW w AS (PARTITION BY block ORDER BY col)) SELECT ctx, count(*) AS n_cols, round(sum(CASE ctx {cases} END), 4) AS ll FROM c WHERE {_USABLE} GROUP BY ctx"


def _gap_closed(model: Model, t: float) -> list[list[float]]:
    """P = I + Q (1 - e^(-st)) / s over the states N - . ; only N can change, at s in all."""
    dash, dot = model.params
    s = dash + dot
    gone = (1 - exp(-s * t)) / s
    return [[1 - s * gone, dash * gone, dot * gone], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def _leaf_over(states: str, sym: str, p, a: int) -> str:
    return f"(CASE {sym} " + " ".join(f"WHEN '{b}' THEN {_num(p[a][j])}" for j, b in enumerate(states)) + " ELSE 1e0 END)"


def _own_ll(by: dict[str, Model], states: str, p_of) -> str:
    """ln by pruning where a leaf's left context chooses the model of its branch and the root's that of all other branches."""

    def leaf(name: str, a: int, d: float) -> str:
        return f"(CASE {name}_ctx " + " ".join(f"WHEN '{c}' THEN {_leaf_over(states, name, p_of(m, d), a)}" for c, m in by.items()) + " END)"

    def below(node: Node, a: int, root: str) -> str:
        parts = []
        for c, d in node.children:
            p = p_of(by[root], d)
            parts.append(leaf(c.name, a, d) if not c.children else "(" + " + ".join(f"{_num(p[a][b])} * {below(c, b, root)}" for b in range(len(states)) if p[a][b]) + ")")
        return "(" + " * ".join(parts) + ")"

    return "CASE t0_ctx || t0 " + " ".join(f"WHEN '{c}{b}' THEN ln({below(TREE.root, a, c)})" for c in by for a, b in enumerate(states)) + " END"


_OWN_CTX = ", ".join(f"regexp_extract(coalesce(lag({k}, 1) OVER w, ''), '([ACGT]*)$', 1) AS {k}_ctx" for k in NAMES)


def _own_contexts(out: str = "") -> str:
    ll = _own_ll({c: m for (_, c), m in CONTEXTS.models.items()}, BASES, _closed)
    rows = f"{_WITH}, c AS (SELECT *, {_OWN_CTX} FROM wide WINDOW w AS (PARTITION BY block ORDER BY col))"
    if out:
        return f"{rows} SELECT block, col, {ll} AS ll FROM c WHERE {_USABLE}"
    return f"{rows} SELECT t1_ctx AS ctx, count(*) AS n_cols, round(sum({ll}), 4) AS ll FROM c WHERE {_USABLE} GROUP BY 1"


def _gap_contexts() -> str:
    """(block, col, ll) of the gap process: every symbol a state, the state before it the context."""
    state = lambda t: f"CASE WHEN {t} IN ('A', 'C', 'G', 'T') THEN 'N' WHEN {t} = '-' THEN '-' ELSE '.' END"
    ll = _own_ll({c: m for (_, c), m in GAP_CONTEXTS.models.items()}, "N-.", _gap_closed)
    ctx = ", ".join(f"coalesce(lag({t}, 1) OVER w, '') AS {t}_ctx" for t in NAMES)
    return f"{_WITH}, g AS (SELECT block, col, {_USABLE} AS usable, {', '.join(f'{state(t)} AS {t}' for t in NAMES)} FROM wide), c AS (SELECT *, {ctx} FROM g WINDOW w AS (PARTITION BY block ORDER BY col)) SELECT block, col, {ll} AS ll FROM c WHERE usable"


def _periodic(engine: str, phase: str) -> str:
    """(block, col, ll) under the models of three codon positions; phase: of a block's first column."""
    top = TREE.root.children[0][0]
    cases = []
    for f in range(3):
        by = {c: m for (g, c), m in PERIODIC.models.items() if g == f}
        if engine == "LCO":
            cases.append(f"WHEN {f} THEN {_own_ll(by, BASES, _closed)}")
        else:
            p_of = lambda m, by=by: lambda c, d: _closed(m if engine == "TRCO" or c is top else by[""], d)
            cases.append(f"WHEN {f} THEN CASE t0_ctx " + " ".join(f"WHEN '{c}' THEN {_ll(p_of(m))}" for c, m in by.items()) + " END")
    rows = f"{_WITH}, b AS ({_STARTS}), c AS (SELECT wide.*, start, {_OWN_CTX} FROM wide JOIN b ON b.block = wide.block WINDOW w AS (PARTITION BY wide.block ORDER BY col))"
    return f"{rows} SELECT block, col, CASE CAST(({phase} + col) % 3 AS INTEGER) {' '.join(cases)} END AS ll FROM c WHERE {_USABLE}"


def _root_contexts(engine: str) -> str:
    """(block, col, ll) of the engines that look at the root's context."""
    top = TREE.root.children[0][0]

    def p_of(model):
        return lambda c, d: _closed(model if engine == "TRCO" or c is top else JC, d)

    cases = " ".join(f"WHEN '{c}' THEN {_ll(p_of(m))}" for (_, c), m in CONTEXTS.models.items())
    ctx = "regexp_extract(coalesce(lag(t0, 1) OVER w, ''), '([ACGT]*)$', 1)"
    return f"{_WITH}, c AS (SELECT *, {ctx} AS ctx FROM wide WINDOW w AS (PARTITION BY block ORDER BY col)) SELECT block, col, CASE ctx {cases} END AS ll FROM c WHERE {_USABLE}"


def _slices(by) -> str:
    """(block, col, ll): pruning over pairs of columns as tables, less pruning of the left column alone.

    by(x, y): the model of the second place after the parent's x and the child's y; by(): that of the first place."""
    first = {d: _closed(by(), d) for _, _, d in TREE.branches()}
    rows = []
    for _, c, d in TREE.branches():
        for a1, b1, a2, b2 in ((a1, b1, a2, b2) for a1 in range(4) for b1 in range(4) for a2 in range(4) for b2 in range(4)):
            p = first[d][a1][b1] * _closed(by(BASES[a1], BASES[b1]), d)[a2][b2]
            rows.append(f"('{c.name}', '{BASES[a1]}{BASES[a2]}', '{BASES[b1]}{BASES[b2]}', {_num(p)})")
    tables = []

    def part(c: Node) -> str:
        """(pattern, a, v): what lies below c by the state of its parent."""
        if c.children:
            below(c)
            return f"SELECT l.id, p.a, sum(p.p * l.v) AS v FROM l_{c.name} l JOIN pt p ON p.child = '{c.name}' AND p.b = l.s GROUP BY l.id, p.a"
        match = " AND ".join(f"(substr(q.s_{c.name}, {k}, 1) = substr(p.b, {k}, 1) OR strpos('{BASES}', substr(q.s_{c.name}, {k}, 1)) = 0)" for k in (1, 2))
        return f"SELECT q.id, p.a, sum(p.p) AS v FROM pats q JOIN pt p ON p.child = '{c.name}' AND {match} GROUP BY q.id, p.a"

    def below(x: Node) -> None:
        (one, _), (two, _) = x.children
        tables.append(f"l_{x.name} AS (SELECT o.id, o.a AS s, o.v * w.v AS v FROM ({part(one)}) o JOIN ({part(two)}) w ON o.id = w.id AND o.a = w.a)")

    top = part(TREE.root.children[0][0])
    pairs = ", ".join(f"lag({t}, 1) OVER w AS b_{t}" for t in NAMES)
    joined = ", ".join(f"b_{t} || {t} AS s_{t}" for t in NAMES)
    small = _ll(lambda c, d: first[d])
    for t in NAMES:
        small = small.replace(f"CASE {t} ", f"CASE b_{t} ")
    return f"""{_WITH}, pt(child, a, b, p) AS (VALUES {", ".join(rows)}),
      c AS (SELECT block, col, {", ".join(NAMES)}, {pairs} FROM wide WINDOW w AS (PARTITION BY block ORDER BY col)),
      pats AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT {joined} FROM c WHERE {_USABLE} AND b_t0 IN ('A', 'C', 'G', 'T'))),
      {", ".join(tables)}, big AS (SELECT q.*, ln(x.v) AS ll FROM pats q JOIN ({top}) x ON x.id = q.id AND x.a = q.s_t0)
      SELECT c.block, c.col, CASE WHEN b_t0 IN ('A', 'C', 'G', 'T') THEN big.ll - {small} ELSE {_ll(lambda c, d: first[d])} END AS ll
      FROM c LEFT JOIN big ON {" AND ".join(f"big.s_{t} = c.b_{t} || c.{t}" for t in NAMES)} WHERE c.{_USABLE}"""


def _framed(rows: str, digits: int = 4) -> str:
    return f"SELECT CAST(col % 3 AS INTEGER) AS frame, count(*) AS n_cols, round(sum(ll), {digits}) AS ll FROM ({rows}) GROUP BY 1"


def _parent_contexts(tree=TREE, names=NAMES) -> str:
    """Fitch states of every column, then each branch by the base that its parent has in the column before."""
    by = {c: m for (_, c), m in CONTEXTS.models.items()}
    parents = dict.fromkeys(x.name for x, _, _ in tree.branches())
    ctx = ", ".join(f"""coalesce(CASE WHEN lag("{n}", 1) OVER w IN ('A', 'C', 'G', 'T') THEN lag("{n}", 1) OVER w END, '') AS "{n}_ctx\"""" for n in parents)
    total = " + ".join(f"""(CASE "{x.name}_ctx" """ + " ".join(f"WHEN '{k}' THEN {_logp(chr(34) + x.name + chr(34), chr(34) + c.name + chr(34), d, m)}" for k, m in by.items()) + " END)" for x, c, d in tree.branches())
    return f"WITH {tracks_sql(len(names))}, {_states_sql(tree, names, 'fitch')}, k AS (SELECT *, {ctx} FROM named WINDOW w AS (PARTITION BY block ORDER BY col)) SELECT block, col, {total} AS ll FROM k WHERE {_USABLE}"


def _phases() -> str:
    by_frame = ", ".join(f"sum({_ll(_plain(m))}) AS m{k}" for k, m in enumerate(PHASES))
    total = " + ".join(f"(SELECT m{k} FROM f WHERE frame = ({k} + 3 - phase) % 3)" for k in range(3))
    return f"{_WITH}, f AS (SELECT col % 3 AS frame, {by_frame} FROM wide WHERE {_USABLE} GROUP BY 1), p AS (SELECT phase, {total} AS total FROM (VALUES (0), (1), (2)) x(phase)) SELECT CAST(phase AS INTEGER) AS phase, round(total, 4) AS total FROM p ORDER BY total DESC, phase LIMIT 1"


def _majority() -> str:
    """A2 over t1 and t2; A1, under the root, over A2 or its counts, t3 and t0, else t0; A2 without a mode takes A1."""
    states = BASES + "-"
    one = lambda t: "[" + ", ".join(f"(CASE WHEN {t} = '{b}' THEN 1 ELSE 0 END)" for b in states) + "]"
    add = lambda *x: f"list_transform(range(1, {len(states) + 1}), lambda i: " + " + ".join(f"{v}[i]" for v in x) + ")"
    mode = lambda c, other: f"CASE WHEN list_max({c}) > 0 AND len(list_filter({c}, lambda v: v = list_max({c}))) = 1 THEN substr('{states}', CAST(list_position({c}, list_max({c})) AS INTEGER), 1) ELSE {other} END"
    return f"""{_WITH}, k AS (SELECT t0, {", ".join(f"{one(t)} AS k{t}" for t in NAMES)} FROM wide WHERE {_USABLE}), c AS (SELECT *, {add("kt1", "kt2")} AS c2 FROM k),
      r AS (SELECT *, {mode("c2", "NULL")} AS r2 FROM c), u AS (SELECT *, CASE WHEN r2 IS NULL THEN c2 ELSE {one("r2")} END AS p2 FROM r), d AS (SELECT *, {add("p2", "kt3", "kt0")} AS c1 FROM u),
      x AS (SELECT r2, {mode("c1", "t0")} AS "A1" FROM d) SELECT "A1", coalesce(r2, "A1") AS "A2", count(*) AS n FROM x GROUP BY ALL"""


def _mask(x: str) -> str:
    return f"(CASE {x} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END)"


def _low(x: str) -> str:
    return f"(CASE WHEN {x} & 1 <> 0 THEN 'A' WHEN {x} & 2 <> 0 THEN 'C' WHEN {x} & 4 <> 0 THEN 'G' WHEN {x} & 8 <> 0 THEN 'T' ELSE '.' END)"


def _states_sql(tree, names: list[str], rule: str) -> str:
    """CTE `named`: the wide columns with a column per inner node, by Fitch or by single gain, set by set up the tree and
    then down it, where the state of a node is chosen before its children's."""
    one = lambda x: f"(({x}) & -({x}))"
    up, down, taxa = [], [], [f"{_mask(t)} AS s_{t}" for t in names[1:]]
    inner = [x for x in tree.nodes if x.kind == "INTERNAL"]
    for x in inner:
        a, b = (f"s_{c.name}" for c, _ in x.children)
        up.append((x.name, f"CASE WHEN {a} & {b} <> 0 THEN {a} & {b} ELSE {a} | {b} END" if rule == "fitch" else f"{a} | {b}"))
    for x in reversed(inner):  # of a ladder, and of any tree whose nodes are listed children first
        a, b = (f"s_{c.name}" for c, _ in x.children)
        parent, s = tree.parent[id(x)][0], f"s_{x.name}"
        root = parent.kind == "ROOT"
        if rule == "fitch":
            fa = f"(CASE WHEN {_mask(names[0])} = 0 THEN 16 ELSE {_mask(names[0])} END)" if root else f"f_{parent.name}"
            f = f"CASE WHEN {s} & {fa} = {fa} THEN {s} & {fa} WHEN {a} & {b} <> 0 THEN (({a} | {b}) & {fa}) | {s} ELSE {s} | {fa} END"
        else:
            f = f"({a} & {b}) | ({s} & {0 if root else f'f_{parent.name}'})"
        down.append((x.name, one(f)))
    steps, last = [f"x0 AS (SELECT *, {', '.join(taxa)} FROM wide)"], "x0"
    for k, (prefix, name, value) in enumerate([("s", *u) for u in up] + [("f", *d) for d in down], 1):
        steps.append(f"x{k} AS (SELECT *, {value} AS {prefix}_{name} FROM {last})")
        last = f"x{k}"
    states = ", ".join(f"""{_low(f'f_{x.name}')} AS "{x.name}\"""" for x in inner)
    return ", ".join(steps) + f", named AS (SELECT *, {states} FROM {last})"


_FITCH = _states_sql(TREE, NAMES, "fitch")
_GAIN = _states_sql(TREE, NAMES, "gain")


def _logp(a: str, b: str, d: float, model: Model = JC) -> str:
    p = _closed(model, d)
    return f"(CASE {a} || {b} " + " ".join(f"WHEN '{x}{y}' THEN {_num(log(p[i][j]))}" for i, x in enumerate(BASES) for j, y in enumerate(BASES)) + " ELSE 0e0 END)"


_MP = " + ".join(_logp(f'"{x.name}"', f'"{c.name}"', d) for x, c, d in TREE.branches())
_FOREST = f"WITH RECURSIVE {FOREST_SQL}"


def _transitions() -> str:
    """Closed forms: JC and F81 by their decay; K80 and HKY by their two rates after rescaling."""
    freq = "(VALUES ('A', 0.3e0), ('C', 0.2e0), ('G', 0.2e0), ('T', 0.3e0))"
    # ts + 2 tv = 0.999 with ts = 2 tv
    tv, ts = "0.24975e0", "0.4995e0"
    return f"""WITH ts AS (SELECT DISTINCT round(5 * (l_discount + l_tax) + 0.1, 2) AS t FROM lineitem), f(b, pi) AS {freq},
    g AS (SELECT t, x.b AS a, y.b AS b, y.pi AS pi, CASE WHEN x.b = y.b THEN 1 ELSE 0 END AS same,
                 CASE WHEN (x.b IN ('A', 'G')) = (y.b IN ('A', 'G')) THEN 1 ELSE 0 END AS kin, CASE WHEN y.b IN ('A', 'G') THEN 0.5e0 ELSE 0.5e0 END AS pool FROM ts, f x, f y)
    SELECT 'JC' AS model, t, a, b, round(0.25e0 + (same - 0.25e0) * exp(-t), 9) AS p FROM g
    UNION ALL SELECT 'FEL', t, a, b, round(same * exp(-0.5e0 * t) + pi * (1 - exp(-0.5e0 * t)), 9) FROM g
    UNION ALL SELECT 'KIM', t, a, b, round(0.25e0 + 0.25e0 * (2 * kin - 1) * exp(-4 * {tv} * t) + CASE WHEN same = 1 THEN 0.5e0 WHEN kin = 1 THEN -0.5e0 ELSE 0 END * exp(-2 * ({ts} + {tv}) * t), 9) FROM g
    UNION ALL SELECT 'GAP', t, 'N', b, round(CASE b WHEN 'N' THEN exp(-0.3e0 * t) WHEN '-' THEN (1 - exp(-0.3e0 * t)) * 2 / 3 ELSE (1 - exp(-0.3e0 * t)) / 3 END, 9) FROM ts, (VALUES ('N'), ('-'), ('.')) v(b)
    UNION ALL SELECT 'HB', t, a, b, round(0.25e0 + 0.25e0 * (2 * kin - 1) * exp(-4 * {tv} * t) + CASE WHEN same = 1 THEN 0.5e0 WHEN kin = 1 THEN -0.5e0 ELSE 0 END * exp(-2 * ({ts} + {tv}) * t), 9) FROM g
    UNION ALL SELECT m, t, a, b, round(CASE WHEN kin = 1 THEN pi + pi * (1 / pool - 1) * exp(-{tv} * t) + (same - pi / pool) * exp(-(pool * {ts} + (1 - pool) * {tv}) * t) ELSE pi * (1 - exp(-{tv} * t)) END, 9) FROM g, (VALUES ('HKY'), ('REV')) v(m)"""


def _dual(x: str = "", y: str = "") -> Model:
    return DUAL.models[0, f"{x}|{y}"]


def _ancestral(x: str = "", y: str = "") -> Model:
    """The odd orders of the dual model: parent contexts alone."""
    return DUAL.models[0, f"{x}|"]


def _orders() -> str:
    """Shares of changed columns by the bases before them, each length counted on its own, and what follows from them."""
    ctx = "coalesce(lag(t0, 2) OVER w, '') AS l2, coalesce(lag(t0, 1) OVER w, '') AS l1"
    both = "t0 IN ('A', 'C', 'G', 'T') AND t1 IN ('A', 'C', 'G', 'T')"
    of = lambda n: f"SELECT {('right(l2 || l1, ' + str(n) + ')') if n else chr(39) * 2} AS ctx, avg(CASE WHEN t0 <> t1 THEN 1e0 ELSE 0e0 END) AS alpha FROM c WHERE {both}" + (" AND l1 IN ('A', 'C', 'G', 'T')" if n > 0 else "") + (" AND l2 IN ('A', 'C', 'G', 'T')" if n > 1 else "") + (" GROUP BY 1" if n else "")
    return f"""{_WITH}, c AS (SELECT t0, t1, {ctx} FROM wide WINDOW w AS (PARTITION BY block ORDER BY col)), k AS ({of(0)} UNION ALL {of(1)} UNION ALL {of(2)}),
      one AS (SELECT right(ctx, 1) AS ctx, avg(alpha) AS alpha FROM k WHERE length(ctx) = 2 GROUP BY 1),
      r AS (SELECT 'lower' AS kind, ctx, alpha FROM k WHERE length(ctx) < 2 UNION ALL SELECT 'raised', ctx, alpha FROM k UNION ALL SELECT 'raised', x || ctx, alpha FROM k, (VALUES ('A'), ('C'), ('G'), ('T')) v(x) WHERE length(ctx) = 2
        UNION ALL SELECT 'averaged', ctx, alpha FROM k WHERE length(ctx) = 2 UNION ALL SELECT 'averaged', ctx, alpha FROM one UNION ALL SELECT 'averaged', '', avg(alpha) FROM one)
      SELECT kind, ctx, round(alpha, 9) AS alpha FROM r"""


_RUNS = "{0} AS (SELECT block, min(col) AS pos FROM (SELECT block, col, op, row_number() OVER (PARTITION BY block ORDER BY col) - row_number() OVER (PARTITION BY block, op ORDER BY col) AS g FROM (SELECT block, col, CASE WHEN t0 IN ('A','C','G','T') AND {1} IN ('A','C','G','T') THEN 'S' WHEN {1} IN ('A','C','G','T') THEN 'I' WHEN t0 IN ('A','C','G','T') THEN 'D' END AS op FROM wide) WHERE op IS NOT NULL) WHERE op = 'D' GROUP BY block, g)"
_CLEAR = "floor(CAST({0} AS DOUBLE) / {1} * 100 + 5e0 / 9)"

ORACLES = {
    "block_likelihood": f"{_WITH} SELECT block, count(*) AS n_cols, round(sum({_ll(_plain(JC))}), 6) AS ll FROM wide WHERE {_USABLE} GROUP BY block",
    "summary": f"{_WITH}, b AS (SELECT block, max(length(seq)) AS len, count(*) AS n FROM tracks GROUP BY block) SELECT count(*) AS n_blocks, CAST(sum(len) AS BIGINT) AS total_length, CAST(sum(len * n) AS BIGINT) AS total_area, max(n) AS max_tracks FROM b",
    "track_stats": f"""{_WITH}, total AS (SELECT CAST(sum(len) AS BIGINT) AS total FROM (SELECT max(length(seq)) AS len FROM tracks GROUP BY block)),
      x AS (SELECT s.track, s.sym, w.t0 FROM sites s JOIN wide w ON s.block = w.block AND s.col = w.col),
      c AS (SELECT track, CAST(sum(CASE WHEN sym IN ('-', '.') THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN sym IN ('G', 'C') THEN 1 ELSE 0 END) AS BIGINT) AS gc,
            CAST(sum(CASE WHEN sym = t0 AND sym IN ('A','C','G','T','N') THEN 1 ELSE 0 END) AS BIGINT) AS matches,
            CAST(sum(CASE WHEN t0 IN ('A','C','G','T','N') AND sym IN ('A','C','G','T','N') THEN 1 ELSE 0 END) AS BIGINT) AS compared FROM x GROUP BY track)
      SELECT track, gaps, gc, matches, compared, CAST({_CLEAR.format('gc', 'nullif(total - gaps, 0)')} AS BIGINT) AS gc_pct, CAST({_CLEAR.format('(total - gaps)', 'nullif(total, 0)')} AS BIGINT) AS coverage_pct,
             CAST({_CLEAR.format('matches', 'nullif(compared, 0)')} AS BIGINT) AS match_pct FROM c, total""",
    "composition": f"{_WITH}, c AS (SELECT sym, count(*) AS n FROM sites WHERE sym IN ('A','C','G','T') GROUP BY sym) SELECT sym, n, round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c), 9) AS freq FROM c",
    "filter_count": _kept(" + ".join(f"(CASE WHEN {_RESIDUE.format(t)} THEN 1 ELSE 0 END)" for t in NAMES) + " >= 3"),
    "filter_species": _kept(f"{_RESIDUE.format('t0')} AND {_RESIDUE.format('t2')}"),
    "drop_target_gaps": _kept(_USABLE),
    "codon_trim": _digest("substr(seq, b + 1, greatest(0, e - b))", "FROM (SELECT *, (3 - phase) % 3 AS b, length(seq) - (phase + length(seq)) % 3 AS e FROM tracks)"),
    "column_range": _digest("substr(seq, 11, 240)"),
    "padded": _digest("rpad(seq, CAST(max(length(seq)) OVER (PARTITION BY block) AS INTEGER), '-')"),
    "phase_projection": f"{_WITH} SELECT block, count(*) AS n, CAST(sum(CASE WHEN {_USABLE} THEN 1 ELSE 0 END) AS BIGINT) AS n_target FROM wide WHERE col % 3 = phase GROUP BY block",
    "first_blocks": f"{_WITH}, c AS (SELECT DISTINCT block FROM tracks ORDER BY block LIMIT 10) SELECT block, track, CASE WHEN block IN (SELECT block FROM c) THEN 'first' ELSE 'rest' END AS part FROM tracks",
    "sample_blocks": f"{_WITH}, c AS (SELECT block FROM (SELECT DISTINCT block FROM tracks) ORDER BY md5(CAST(block AS VARCHAR) || ':0'), block LIMIT 20) SELECT block, track, CASE WHEN block IN (SELECT block FROM c) THEN 'sample' ELSE 'rest' END AS part FROM tracks",
    "concatenation": f"{_WITH}, b AS (SELECT block, CAST(max(length(seq)) AS BIGINT) AS len FROM tracks GROUP BY block) SELECT block, CAST(sum(len) OVER (ORDER BY block) - len AS BIGINT) AS start, len FROM b",
    "nj_distances": _NJ,
    "upgma_distances": _UPGMA,
    "closest_pair": f"SELECT t1, t2, d FROM ({_NJ}) ORDER BY d, t1, t2 LIMIT 1",
    "identity_windows": f"{_WITH} SELECT block, CAST(col // 100 AS BIGINT) AS win, CAST(sum(CASE WHEN {_RESIDUE.format('t0')} AND {_RESIDUE.format('t1')} THEN 1 ELSE 0 END) AS BIGINT) AS compared, CAST(sum(CASE WHEN {_RESIDUE.format('t0')} AND t0 = t1 THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM wide GROUP BY ALL",
    "nmer_counts": f"""{_WITH}, m AS (SELECT track, sym || lead(sym, 1) OVER w || lead(sym, 2) OVER w AS nmer FROM sites WINDOW w AS (PARTITION BY block, track ORDER BY col)),
      c AS (SELECT track, nmer, count(*) AS n FROM m WHERE nmer IS NOT NULL GROUP BY ALL)
      SELECT track, nmer, n, CASE WHEN nmer NOT LIKE '%-%' THEN CAST(16 * (strpos('ACGT', nmer[1]) - 1) + 4 * (strpos('ACGT', nmer[2]) - 1) + strpos('ACGT', nmer[3]) - 1 AS BIGINT) ELSE -1 END AS code,
             translate(nmer, 'ACGT', 'TGCA') AS comp, nmer LIKE '%-%' AS gapped, (nmer[1] IN ('A', '-') AND nmer[2] IN ('C', '-') AND nmer[3] IN ('G', '-')) AS like_acg,
             CAST((nmer[1] <> 'A')::INT + (nmer[2] <> 'C')::INT + (nmer[3] <> 'G')::INT AS INTEGER) AS far_acg FROM c""",
    "target_contexts": f"{_WITH} SELECT ctx, count(*) AS n FROM (SELECT {_CTX} AS ctx FROM wide WINDOW w AS (PARTITION BY block ORDER BY col)) GROUP BY ctx",
    "frame_likelihood": f"{_WITH} SELECT CAST(col % 3 AS INTEGER) AS frame, count(*) AS n_cols, round(sum({_ll(_plain(HKY))}), 4) AS ll FROM wide WHERE {_USABLE} GROUP BY 1",
    "best_frame": f"{_WITH}, f AS (SELECT CAST(col % 3 AS INTEGER) AS frame, sum({_ll(_plain(HKY))}) AS total, avg({_ll(_plain(HKY))}) AS mean FROM wide WHERE {_USABLE} GROUP BY 1) SELECT frame, round(total, 4) AS total FROM f ORDER BY mean DESC, frame LIMIT 1",
    "rco_likelihood": _contextual("RCO"),
    "trco_likelihood": _contextual("TRCO"),
    "prefix_sums": f"{_WITH}, c AS (SELECT block, col, sum({_ll(_plain(JC))}) OVER (PARTITION BY block ORDER BY col ROWS UNBOUNDED PRECEDING) AS cum FROM wide WHERE {_USABLE}) SELECT block, CAST(col // 500 AS BIGINT) AS part, round(max_by(cum, col), 6) AS cum FROM c GROUP BY ALL",
    "fitch_states": f'{_WITH}, {_FITCH} SELECT "A1", "A2", count(*) AS n FROM named WHERE {_USABLE} GROUP BY ALL',
    "fitch_ladder": f'WITH {tracks_sql(6)}, {_states_sql(LADDER, LADDER_NAMES, "fitch")} SELECT "A1", "A2", "A3", "A4", count(*) AS n FROM named WHERE {_USABLE} GROUP BY ALL',
    "single_gain_ladder": f'WITH {tracks_sql(6)}, {_states_sql(LADDER, LADDER_NAMES, "gain")} SELECT "A1", "A2", "A3", "A4", count(*) AS n FROM named WHERE {_USABLE} GROUP BY ALL',
    "mp_ladder": _framed(_parent_contexts(LADDER, LADDER_NAMES)),
    "single_gain_states": f'{_WITH}, {_GAIN} SELECT "A1", "A2", count(*) AS n FROM named WHERE {_USABLE} GROUP BY ALL',
    "fitch_likelihood": f'{_WITH}, {_FITCH} SELECT "A1", count(*) AS n, round(sum({_MP}), 4) AS ll FROM named WHERE {_USABLE} GROUP BY ALL',
    "indel_runs": f"""{_WITH}, o AS (SELECT block, col, CASE WHEN t0 IN ('A','C','G','T') AND t1 IN ('A','C','G','T') THEN 'S' WHEN t1 IN ('A','C','G','T') THEN 'I' WHEN t0 IN ('A','C','G','T') THEN 'D' END AS op FROM wide),
      k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY col) - row_number() OVER (PARTITION BY block, op ORDER BY col) AS g FROM o WHERE op IS NOT NULL),
      r AS (SELECT block, op, g, count(*) AS len FROM k GROUP BY ALL) SELECT block, op, count(*) AS runs, CAST(sum(len) AS BIGINT) AS columns, max(len) AS longest FROM r GROUP BY block, op""",
    "fasta": f"{_WITH} SELECT block, md5('>' || CAST(row_number() OVER (ORDER BY block) - 1 AS VARCHAR) || chr(10) || upper(replace(replace(seq, '-', ''), '.', ''))) AS value_md5 FROM tracks WHERE track = 0",
    "interval_identity": f"""{_WITH}, i AS (SELECT DISTINCT l_orderkey AS block, l_partkey AS b, CAST(l_partkey + 50 * l_quantity AS BIGINT) AS e FROM lineitem),
      r AS (SELECT i.*, w.block IS NOT NULL AS hit, CASE WHEN {_RESIDUE.format('t0')} AND {_RESIDUE.format('t1')} THEN 1 ELSE 0 END AS n, CASE WHEN {_RESIDUE.format('t0')} AND t0 = t1 THEN 1 ELSE 0 END AS m
        FROM i JOIN (SELECT DISTINCT block FROM wide) k ON k.block = i.block LEFT JOIN wide w ON w.block = i.block AND w.col > i.b AND w.col <= i.e)
      SELECT block, b AS "begin", e AS "end", CAST(sum(CASE WHEN hit THEN m ELSE 0 END) AS BIGINT) AS matches, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS compared,
        round(CAST(sum(CASE WHEN hit THEN m ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN hit THEN n ELSE 0 END), 0), 9) AS identity FROM r GROUP BY block, b, e""",
    "distance_matrix": f"""WITH p AS ({_NJ}), x AS (SELECT t1, t2, d FROM p UNION ALL SELECT t2, t1, d FROM p UNION ALL SELECT name, name, 0e0 FROM (VALUES {", ".join(f"('{n}')" for n in NAMES)}) v(name))
      SELECT CAST(substr(t1, 2) AS INTEGER) AS ix, t1 || chr(9) || string_agg(CAST(d AS VARCHAR), chr(9) ORDER BY t2) AS value FROM x GROUP BY t1 UNION ALL SELECT -1, concat('', chr(9), '{chr(9).join(NAMES)}')""",
    "tree_leaf_distances": f"{_FOREST} SELECT tree, a, b, d FROM far",
    "tree_clades": f"{_FOREST} SELECT tree, ancestor AS node, count(*) AS n_members, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM up GROUP BY tree, ancestor",
    "tree_graph": f"{_FOREST} SELECT n.tree, n.kind, n.name, p.name AS parent, n.branch_len FROM forest n LEFT JOIN forest p ON p.tree = n.tree AND p.node = n.parent",
    "tree_leaf_counts": f"{_FOREST} SELECT tree, ancestor AS node, count(*) AS n_leaves FROM leaf GROUP BY tree, ancestor",
    "transition_table": _transitions(),
    "maf_round_trip": f"{_WITH} SELECT 'b' || block || '.t' || track AS name, phase, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS seq_md5 FROM tracks WHERE seq <> ''",
    "track_accuracy": f"""{_WITH}, m AS (SELECT track, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN block % 2 = 1 AND sym = 'T' THEN 0 ELSE 1 END) AS DOUBLE) AS m FROM sites GROUP BY track)
      SELECT track, floor(m / n * 1000 + 5e0 / 9) / 10 AS accuracy FROM m""",
    "renamed_target": f"{_WITH} SELECT CASE WHEN track = 0 THEN 'target' ELSE 't' || track END AS name, count(*) AS n FROM tracks GROUP BY 1",
    "range_sums": f"""{_WITH}, c AS (SELECT block, col, {_ll(_plain(JC))} AS ll FROM wide), r AS (SELECT block, b AS begin, CAST(least(200, max(col) + 1) AS INTEGER) AS stop FROM c, (VALUES (0), (10)) v(b) GROUP BY block, b)
      SELECT r.block, CAST(r.begin AS INTEGER) AS begin, r.stop AS "end", round(sum(c.ll), 6) AS total FROM r JOIN c ON c.block = r.block AND c.col >= r.begin AND c.col < r.stop GROUP BY ALL""",
    "indexed_ranges": f"""{_WITH}, c AS (SELECT block, col, {_ll(_plain(JC))} AS ll FROM wide WHERE {_USABLE}), i AS (SELECT DISTINCT l_orderkey AS block, l_partkey AS b, CAST(l_partkey + 50 * l_quantity AS BIGINT) AS e FROM lineitem)
      SELECT i.block, i.b AS "begin", i.e AS "end", round(coalesce(sum(c.ll), 0e0), 6) AS total FROM i JOIN (SELECT DISTINCT block FROM c) k ON k.block = i.block LEFT JOIN c ON c.block = i.block AND c.col >= i.b AND c.col < i.e GROUP BY ALL""",
    "phase_prediction": _phases(),
    "lco_likelihood": _own_contexts(),
    "majority_states": _majority(),
    "nmer_likelihood": f"""{_WITH}, c AS (SELECT *, lag(t0, 1) OVER (PARTITION BY block ORDER BY col) AS before FROM wide)
      SELECT before || t0 AS pair, count(*) AS n_cols, round(sum({_ll(_plain(JC))}), 4) AS ll FROM c WHERE {_USABLE} AND before IN ('A', 'C', 'G', 'T') GROUP BY 1""",
    "aco_likelihood": _framed(_slices(_ancestral)),
    "hog_likelihood": _framed(_slices(_dual)),
    "mp_likelihood": _framed(_parent_contexts()),
    "gap_rewriting": _framed(f"SELECT x.col, x.ll + y.ll AS ll FROM ({_root_contexts('RCO')}) x JOIN ({_gap_contexts()}) y ON x.block = y.block AND x.col = y.col"),
    "gap_likelihood": _framed(_gap_contexts()),
    "periodic_likelihood": _framed(_periodic("TRCO", "phase")),
    "running_likelihood": _framed(_periodic("RCO", "start")),
    "periodic_leaf_likelihood": _framed(_periodic("LCO", "phase")),
    "aco_difference": f"SELECT round((SELECT sum(ll) FROM ({_root_contexts('TRCO')})) - (SELECT sum(ll) FROM ({_slices(lambda x='', y='': CONTEXTS.models[0, x])})), 3) AS difference",
    "context_orders": _orders(),
    "combined_columns": f"{_WITH}, b AS ({_STARTS}), w AS (SELECT start + col AS col, t0, t1, t2, t3 FROM wide JOIN b ON b.block = wide.block), x AS ({' UNION ALL '.join(f'SELECT {k} AS track, col, t{k} AS sym FROM w' for k in range(4))}) SELECT CAST(track AS INTEGER) AS track, CAST(col // 1000 AS BIGINT) AS part, replace(sym, '~', '-') AS sym, count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM x GROUP BY ALL",
    "attached_tracks": f"""{_WITH}, nodes(name, kind) AS (VALUES {", ".join(f"('{x.name}', '{x.kind}')" for x in TREE.nodes)}), n AS (SELECT block, CASE WHEN track = 1 THEN 'x' ELSE 't' || track END AS name, seq FROM tracks WHERE track < 3),
      size AS (SELECT block, max(length(seq)) AS len FROM n GROUP BY block), f AS (SELECT coalesce(w.block, n.block) AS block, coalesce(w.name, n.name) AS name, kind, CASE WHEN seq IS NULL AND kind <> 'INTERNAL' THEN repeat('-', len) ELSE seq END AS seq
      FROM (SELECT block, len, name, kind FROM size, nodes) w FULL JOIN n ON n.block = w.block AND n.name = w.name) SELECT block, name, kind, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS seq_md5 FROM f""",
    "numbered_tracks": f"{_WITH}, f AS (SELECT 'n' || ((track + block) % 7) AS name, min(block * 4 + 3 - track) AS first FROM tracks GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY first, name) - 1 AS INTEGER) AS track FROM f",
    "cumulative_likelihood": f"{_WITH}, t AS (SELECT block, sum({_ll(_plain(JC))}) AS s FROM wide GROUP BY block) SELECT block, round(sum(s) OVER (ORDER BY block), 4) AS cum FROM t",
    "gap_patterns": f"{_WITH}, {_RUNS.format('one', 't1')}, {_RUNS.format('two', 't2')}, g AS (SELECT * FROM one UNION ALL SELECT * FROM two) SELECT block, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS positions_md5, count(*) AS n FROM g WHERE block IN (SELECT block FROM one) AND block IN (SELECT block FROM two) GROUP BY block",
    "context_priors": f"""{_WITH}, m AS (SELECT sym || lead(sym, 1) OVER w || lead(sym, 2) OVER w AS nmer FROM sites WINDOW w AS (PARTITION BY block, track ORDER BY col)),
      c AS (SELECT regexp_extract(nmer, '([ACGT]*)$', 1) AS ctx, count(*) AS n FROM m WHERE nmer IS NOT NULL GROUP BY 1)
      SELECT ctx, n, round(pow(0.3e0, length(regexp_replace(ctx, '[CG]', '', 'g'))) * pow(0.2e0, length(regexp_replace(ctx, '[AT]', '', 'g'))), 9) AS prior FROM c""",
    "probability_maps": """WITH r AS (SELECT DISTINCT CAST(l_discount AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) AS b FROM lineitem)
      SELECT a, b, round(atan(a) / pi() + 0.5e0, 9) AS p, round(tan((b - 0.25e0) * pi()), 9) AS x, round(ln(exp(a) + exp(b)), 9) AS lse, round(CASE WHEN a > 0.05e0 THEN 0e0 ELSE exp(a + b) END, 9) AS added FROM r""",
    "gamma_density": "SELECT x, round(4 * x * exp(-2 * x), 9) AS p FROM (SELECT DISTINCT l_quantity / 10 AS x FROM lineitem)",
    "rerooted_distances": f"{_FOREST} SELECT tree, a, b, d FROM far",
    "pruned_distances": f"{_FOREST} SELECT tree, a, b, d FROM far WHERE m % 3 <> 0 AND n % 3 <> 0",
    "stream_composition": f"""{_WITH} SELECT track, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS symbols, {', '.join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS {chr(34)}{b}{chr(34)}" for b in BASES)} FROM tracks GROUP BY track""",
}
