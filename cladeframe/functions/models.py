"""Substitution models: rate matrices, transition probabilities, context hierarchies, n-mer models, file formats.

Matrices are small and live on the driver as numpy arrays; what reaches the data is the table of P(t). Bases in order
A C G T.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np

BASES = "ACGT"
#: States of the process of gap patterns: a residue, a gap, and a place where nothing was aligned.
GAPS = "N-."
UNIFORM = (0.25, 0.25, 0.25, 0.25)
#: Fixed value: transition plus two transversion rates after rescaling.
RESCALED = 0.999
#: The rate of each unordered pair of a general reversible matrix, by parameter position.
REVERSIBLE = {"AG": 0, "AC": 1, "CG": 2, "AT": 3, "CT": 4, "GT": 5}
PARAMS = {"JC": 1, "FEL": 1, "KIM": 2, "HKY": 2, "REV": 6, "GAP": 2}


def closed(q: np.ndarray) -> np.ndarray:
    """With the diagonal that makes rows sum to 0."""
    q = q.copy()
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(1))
    return q


@dataclass(frozen=True)
class Model:
    """A rate matrix of a kind with its parameters and equilibrium frequencies."""

    kind: str
    params: tuple[float, ...]
    eq: tuple[float, ...] = UNIFORM
    base: Model | None = None

    def rates(self) -> np.ndarray:
        p, eq = self.params, self.eq
        if self.kind in ("KIM", "HKY"):
            scale = RESCALED / (p[0] + 2 * p[1])
            p = tuple(x * scale for x in p)
        if self.kind == "GAP":  # symbols N - . ; gaps are for good
            return closed(np.array([[0, p[0], p[1]], [0, 0, 0], [0, 0, 0]], float))
        q = np.zeros((4, 4))
        for (i, a), (j, b) in product(enumerate(BASES), repeat=2):
            if i == j:
                continue
            swap = {a, b} in ({"A", "G"}, {"C", "T"})
            if self.kind == "JC":
                q[i, j] = p[0]
            elif self.kind == "FEL":
                q[i, j] = p[0] * eq[j]
            elif self.kind == "KIM":
                q[i, j] = p[0] if swap else p[1]
            elif self.kind == "HKY":
                q[i, j] = (p[0] if swap else p[1]) * eq[j]
            elif self.kind == "REV":
                q[i, j] = p[REVERSIBLE["".join(sorted(a + b))]] * eq[j]
            elif self.kind == "HB":
                under = self.base.rates()
                r = eq[j] * under[j, i] / (eq[i] * under[i, j])
                q[i, j] = under[i, j] if abs(r - 1) < 1e-12 else under[i, j] * np.log(r) / (1 - 1 / r)
            else:
                raise ValueError(self.kind)
        return closed(q)

    def at(self, t: float) -> np.ndarray:
        return exponential(self.rates(), t)

    def derivative(self, k: int, step: float = 1e-6) -> np.ndarray:
        """dQ/d parameter k: Q is linear in the parameters of JC, FEL and REV, and smooth in those of KIM and HKY."""
        up, down = (Model(self.kind, tuple(x + s * (i == k) for i, x in enumerate(self.params)), self.eq, self.base).rates() for s in (step, -step))
        return (up - down) / (2 * step)

    def perturbed(self, sigma: float, rng: np.random.Generator) -> Model:
        """Gaussian noise on the parameters, kept inside (0, 1); a reversible matrix also keeps the rates out of each
        base below 1 in sum, by shrinking those that exceed it."""
        if self.kind in ("HB", "NMER"):
            raise ValueError("no noise on this kind")
        moved = [0.01 if x <= 0 else 0.99 if x >= 1 else float(x) for x in (x + rng.normal(0, sigma) for x in self.params)]
        if self.kind == "REV":
            for base in BASES:
                out = [k for pair, k in REVERSIBLE.items() if base in pair]
                total = sum(moved[k] for k in out)
                if total >= 1:
                    for k in out:
                        moved[k] *= 0.99 / total
        return Model(self.kind, tuple(moved), self.eq, self.base)

    def with_param(self, k: int, value: float) -> Model:
        return Model(self.kind, tuple(value if i == k else x for i, x in enumerate(self.params)), self.eq, self.base)

    def rescaled(self, factor: float) -> Model:
        """All rates times a factor; kinds that scale their own rates are left as they are."""
        if self.kind in ("KIM", "HKY"):
            return self
        return Model(self.kind, tuple(factor * x for x in self.params), self.eq, self.base.rescaled(factor) if self.base else None)


def random_model(kind: str, rng: np.random.Generator) -> Model:
    eq = rng.uniform(0.2, 0.3, 4)
    n = PARAMS[kind]
    params = rng.uniform(0.05, 0.95, n)
    return Model(kind, tuple(params), tuple(eq / eq.sum()) if kind in ("FEL", "HKY", "REV") else UNIFORM)


def average(models: list[Model]) -> Model:
    """Element-wise means of parameters and frequencies of models of one kind."""
    if models[0].kind in ("HB", "NMER"):
        raise ValueError("no average of this kind")
    mean = lambda rows: tuple(float(x) for x in np.mean(rows, axis=0))
    return Model(models[0].kind, mean([m.params for m in models]), mean([m.eq for m in models]))


def eigen(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and real vectors; a conjugate pair, which rounding makes of a repeated value, gives its two parts."""
    values, right = np.linalg.eig(q)
    return values, np.where(values.imag < 0, -right.imag, right.real)


def exponential(q: np.ndarray, t: float) -> np.ndarray:
    """e^(Qt) by eigenvectors; by scaling and squaring where those are complex or nearly dependent."""
    values, right = eigen(q)
    if np.abs(values.imag).max() < 1e-12 and np.linalg.cond(right) < 1e8:
        out = (right * np.exp(values.real * t)) @ np.linalg.inv(right)
    else:
        a = q * t
        k = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(a).sum(1).max())))) + 4)
        a = a / 2.0**k
        out, term = np.eye(len(q)), np.eye(len(q))
        for n in range(1, 20):
            term = term @ a / n
            out = out + term
        for _ in range(k):
            out = out @ out
    return np.clip(out, 0.0, None)


@dataclass(frozen=True)
class Decomposed:
    """Eigen-decomposition kept for many t."""

    left: np.ndarray
    values: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, q: np.ndarray) -> Decomposed:
        values, right = eigen(q)
        return cls(right, values.real, np.linalg.inv(right))

    def at(self, t: float) -> np.ndarray:
        return (self.left * np.exp(self.values * t)) @ self.right


def mixture(one: np.ndarray, two: np.ndarray, t: float) -> np.ndarray:
    """P of a branch that changes from one model to the other at a uniform point of it."""
    a, b = Decomposed.of(one), Decomposed.of(two)
    m = a.right @ b.left
    gap = a.values[:, None] - b.values[None, :]
    safe = np.where(np.abs(gap * t) < 1e-4, 1.0, gap * t)
    factor = np.where(np.abs(gap * t) < 1e-4, np.exp(b.values[None, :] * t), (np.exp(a.values[:, None] * t) - np.exp(b.values[None, :] * t)) / safe)
    return a.left @ (m * factor) @ b.right


def equilibrium(p: np.ndarray) -> np.ndarray:
    """The stationary row of a transition matrix: its left eigenvector of eigenvalue 1."""
    values, vectors = np.linalg.eig(p.T)
    v = vectors[:, np.argmin(np.abs(values - 1))].real
    return v / v.sum()


def log_matrix(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def substitute(p: np.ndarray, row: int, rng: np.random.Generator) -> int:
    return int(np.searchsorted(np.cumsum(p[row]), rng.random() * p[row].sum()))


# -- names ------------------------------------------------------------------------------------------------------------

#: Names in files and options.
CONTEXT_TYPES = ("HOG", "ACO", "RCO", "LCO", "TRCO", "MP", "NMER", "AMINO", "CODON")
MATRIX_TYPES = ("JC", "FEL", "KIM", "HKY", "REV", "NMER", "AMINO", "CODON", "GAP", "HB", "GAINLOSS")
ORDER_TYPES = ("COND", "NMER", "NMER_RAW")


def named(text: str, names: tuple[str, ...]) -> str:
    """The name itself, white space around it dropped; an unknown one is an error."""
    if text.strip() not in names:
        raise ValueError(f"{text.strip()!r} is none of {', '.join(names)}")
    return text.strip()


# -- context hierarchies ----------------------------------------------------------------------------------------------


def contexts(n: int) -> list[str]:
    return ["".join(c) for c in product(BASES, repeat=n)]


def level(context: str) -> int:
    """Order of a context: its length; of a dual one 2k for k parent and k child symbols, 2k - 1 for k parent symbols alone."""
    parent, bar, child = context.partition("|")
    return len(context) if not bar else 2 * len(parent) - (len(child) < len(parent))


def keys_of(n: int, dual: bool) -> list[str]:
    """The contexts of one order, in the order of files."""
    if not dual:
        return contexts(n)
    return [f"{c}|" for c in contexts((n + 1) // 2)] if n % 2 else [f"{c[: n // 2]}|{c[n // 2 :]}" for c in contexts(n)]


@dataclass(frozen=True)
class ContextModel:
    """One model per context of each length up to `order`; a context's model is that of its longest known suffix.

    Keys are (phase, context); phase 0 alone unless periodic. A dual context is written parent|child: even orders hold as
    many symbols of either, odd ones those of the parent alone.
    """

    order: int
    models: dict[tuple[int, str], Model] = field(default_factory=dict)
    dual: bool = False
    periodic: bool = False

    @classmethod
    def build(cls, order: int, make, periodic: bool = False, dual: bool = False) -> ContextModel:
        phases = range(3) if periodic else (0,)
        return cls(order, {(f, c): make(f, c) for f in phases for k in range((2 if dual else 1) * order + 1) for c in keys_of(k, dual)}, dual, periodic)

    @classmethod
    def random(cls, order: int, kind: str, sigma: float, rng: np.random.Generator, dual: bool = False) -> ContextModel:
        """A random matrix of order 0; each longer context has its suffix's matrix with noise. In a dual model odd orders
        start from the parent's suffix, even ones from the parent context alone."""
        made: dict[str, Model] = {}
        for n in range((2 if dual else 1) * order + 1):
            for c in keys_of(n, dual):
                parent, bar, child = c.partition("|")
                if n == 0:
                    made[c] = random_model(kind, rng)
                elif not bar:
                    made[c] = made[c[1:]].perturbed(sigma, rng)
                else:
                    made[c] = made[f"{parent}|" if child else f"{parent[1:]}|"].perturbed(sigma, rng)
        return cls(order, {(0, c): m for c, m in made.items()}, dual)

    def top(self) -> int:
        return max(level(c) for _, c in self.models)

    def lookup(self, context: str, phase: int = 0) -> Model:
        phase = phase % 3 if self.periodic else 0
        for k in range(len(context) + 1):
            if (phase, context[k:]) in self.models:
                return self.models[phase, context[k:]]
        raise KeyError(context)

    def lookup_dual(self, parent: str, child: str, phase: int = 0) -> Model:
        """By as many of the last symbols of both as are known."""
        phase = phase % 3 if self.periodic else 0
        for k in range(min(len(parent), len(child)), -1, -1):
            key = phase, f"{parent[len(parent) - k :]}|{child[len(child) - k :]}"
            if key in self.models:
                return self.models[key]
        raise KeyError(f"{parent}|{child}")

    def averaged(self) -> ContextModel:
        """Shorter contexts replaced by means over the symbol that they drop: over both the parent's and the child's in a
        dual model, whose odd orders go."""
        step, top = (2 if self.dual else 1), self.top()
        out = {k: m for k, m in self.models.items() if level(k[1]) == top}
        for n in range(top, 0, -step):
            for f in {f for f, _ in out}:
                for c in keys_of(n - step, self.dual):
                    parent, bar, child = c.partition("|")
                    out[f, c] = average([out[f, f"{x}{parent}|{y}{child}"] for x in BASES for y in BASES] if bar else [out[f, x + c] for x in BASES])
        return ContextModel(self.order, out, self.dual, self.periodic)

    def lower(self) -> ContextModel:
        least = self.top() - (2 if self.dual else 1)
        return ContextModel(self.order - 1, {k: m for k, m in self.models.items() if level(k[1]) <= least}, self.dual, self.periodic)

    def raised(self) -> ContextModel:
        """One order more; each new context has the model of its suffix (of both suffixes in a dual model)."""
        top, more = self.top(), dict(self.models)
        for f in {f for f, _ in self.models}:
            for c in keys_of(top + (2 if self.dual else 1), self.dual):
                parent, bar, child = c.partition("|")
                more[f, c] = self.models[f, f"{parent[1:]}|{child[1:]}" if bar else c[1:]]
        return ContextModel(self.order + 1, more, self.dual, self.periodic)

    def even_orders(self) -> ContextModel:
        return ContextModel(self.order, {k: m for k, m in self.models.items() if level(k[1]) % 2 == 0}, self.dual, self.periodic)

    def ancestral(self) -> ContextModel:
        """The parent contexts of a dual model alone: the matrices of its odd orders, and that of order 0."""
        if not self.dual:
            return self
        out = {(f, c.partition("|")[0]): m for (f, c), m in self.models.items() if level(c) % 2 or level(c) == 0}
        return ContextModel(self.order, out, False, self.periodic)

    def parameter_contexts(self) -> list[str]:
        """The context that each parameter belongs to, when the parameters of the highest order's matrices stand in a row."""
        some = keys_of(self.top(), self.dual)
        return [c for c in some for _ in self.models[0, c].params]

    def log_tables(self, t: float) -> dict[tuple[int, str], np.ndarray]:
        return {k: log_matrix(m.at(t)) for k, m in self.models.items()}


# -- n-mers -----------------------------------------------------------------------------------------------------------


def nmer_rates(n: int, eq: np.ndarray, rate) -> np.ndarray:
    """4^n x 4^n: n-mers one substitution apart exchange at rate(from, to) times the frequency of the target."""
    names = ["".join(c) for c in product(BASES, repeat=n)]
    q = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for k in range(n):
            for b in BASES:
                if b != a[k]:
                    to = a[:k] + b + a[k + 1 :]
                    j = int("".join(str(BASES.index(c)) for c in to), 4)
                    q[i, j] = rate(a, to) * eq[j]
    return closed(q)


def nmer_frequencies(n: int, single: tuple[float, ...]) -> np.ndarray:
    return np.array([np.prod([single[BASES.index(c)] for c in x]) for x in product(BASES, repeat=n)])


def nmer_lower(p: np.ndarray, eq: np.ndarray) -> np.ndarray:
    """P of the (n-1)-mers: summed over the last target base, averaged over the last source base by frequency."""
    k = len(p) // 4
    weight = eq.reshape(k, 4) / eq.reshape(k, 4).sum(1, keepdims=True)
    return np.einsum("iajb,ia->ij", p.reshape(k, 4, k, 4), weight)


def degenerate(nmer: str) -> list[int]:
    """Codes of all n-mers of A C G T that match one with missing symbols."""
    choices = [(BASES.index(c),) if c in BASES else range(4) for c in nmer]
    return [int("".join(map(str, c)), 4) for c in product(*choices)]


#: Longest n-mers that have tables: 4^6 squared are 134 MB for a branch.
LONGEST = 6


def context_nmers(model: ContextModel, n: int, t: float) -> np.ndarray:
    """4^n x 4^n: P of one n-mer turning into another, symbol by symbol, each by the model of what both (a dual model) or
    the parent alone hold before it. Built up a symbol at a time as products of arrays; n is LONGEST at most."""
    if n > LONGEST:
        raise ValueError(f"n-mers of more than {LONGEST} symbols have no table")
    known = list(dict.fromkeys(c for _, c in model.models))
    at = {c: k for k, c in enumerate(known)}
    held = np.stack([{k: m for (_, k), m in model.models.items()}[c].at(t) for c in known])
    out = np.ones((1, 1))
    for k in range(n):
        names = contexts(k)
        if model.dual:  # the longest suffixes of both, equally long, that are known
            find = lambda a, b: next(at[x] for j in range(len(a) + 1) if (x := f"{a[j:]}|{b[j:]}") in at)
            index = np.array([[find(a, b) for b in names] for a in names])
            out = np.einsum("ab,abxy->axby", out, held[index])
        else:
            index = np.array([next(at[a[j:]] for j in range(len(a) + 1) if a[j:] in at) for a in names])
            out = np.einsum("ab,axy->axby", out, held[index])
        out = out.reshape(4 ** (k + 1), 4 ** (k + 1))
    return out


@dataclass(frozen=True)
class NmerModel:
    """Rates between n-mers one substitution apart, and the model of the next shorter n-mers. n is order + 1.

    A rate belongs to an unordered pair and is multiplied by the frequency of its target."""

    rate: dict[tuple[str, str], float]
    single: tuple[float, ...] = UNIFORM
    less: NmerModel | None = None

    @property
    def n(self) -> int:
        return len(next(iter(self.rate))[0])

    @staticmethod
    def pairs(n: int) -> list[tuple[str, str]]:
        names = contexts(n)
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sum(x != y for x, y in zip(a, b, strict=True)) == 1]

    @property
    def eq(self) -> np.ndarray:
        return nmer_frequencies(self.n, self.single)

    def rates(self) -> np.ndarray:
        return nmer_rates(self.n, self.eq, lambda a, b: self.rate[min(a, b), max(a, b)])

    def averaged(self) -> NmerModel:
        """Rates of the shorter n-mers from those with one base more at the end, equal in both, by that base's frequency."""
        if self.n == 1:
            return self
        less = {(a, b): sum(self.single[k] * self.rate[a + x, b + x] for k, x in enumerate(BASES)) for a, b in self.pairs(self.n - 1)}
        return NmerModel(self.rate, self.single, NmerModel(less, self.single).averaged())

    def chain(self, n: int) -> NmerModel:
        """The model of n-mers of length n at most its own."""
        return self if self.n == n or self.less is None else self.less.chain(n)

    def raised(self) -> NmerModel:
        """Rates of longer n-mers: where the change lies in the suffix, the suffix's rate times how often the first base
        stays; where it is the first base, that base's rate times how often the suffix stays. A base or an n-mer stays at 1
        less the rates out of it."""
        zero = self.chain(1).rate
        stay1 = {x: 1 - sum(r for pair, r in zero.items() if x in pair) for x in BASES}
        stay = {a: 1 - sum(r for pair, r in self.rate.items() if a in pair) for a in contexts(self.n)}
        more = {(a, b): self.rate[a[1:], b[1:]] * stay1[a[0]] if a[0] == b[0] else stay[a[1:]] * zero[a[0], b[0]] for a, b in self.pairs(self.n + 1)}
        return NmerModel(more, self.single, self)


# -- files ------------------------------------------------------------------------------------------------------------


def to_text(model: Model) -> str:
    """Tag, parameters, and the frequencies as a length-prefixed vector over A C G T N - . where the kind has them."""
    line = " ".join([model.kind, *(repr(float(x)) for x in model.params)])
    eq = "7 " + " ".join(repr(float(x)) for x in (*model.eq, 0, 0, 0))
    if model.kind == "HB":
        return f"HB\n{eq}\n{to_text(model.base)}"
    return line + ("\n" + eq if model.kind in ("FEL", "HKY", "REV") else "") + "\n"


def _vector(tokens) -> tuple[float, ...]:
    return tuple(float(next(tokens)) for _ in range(int(next(tokens))))[:4]


def from_tokens(tokens) -> Model:
    kind = next(tokens)
    if kind == "HB":
        eq = _vector(tokens)
        return Model("HB", (), eq, from_tokens(tokens))
    if kind not in PARAMS:
        raise ValueError(f"no such matrix: {kind}")
    params = tuple(float(next(tokens)) for _ in range(PARAMS[kind]))
    return Model(kind, params, _vector(tokens) if kind in ("FEL", "HKY", "REV") else UNIFORM)


def from_text(text: str) -> Model:
    return from_tokens(iter(text.split()))


def context_to_text(model: ContextModel) -> str:
    """COND, periodic, dual, sequence type, matrix type, order, count, matrices; then the next lower order."""
    kind, out = next(iter(model.models.values())).kind, []
    phases = range(3) if model.periodic else (0,)
    for n in range(model.top(), -1, -1):
        some = [model.models[f, c] for f in phases for c in keys_of(n, model.dual) if (f, c) in model.models]
        if some:
            out.append(f"COND {int(model.periodic)} {int(model.dual)} DNA {kind} {n} {len(some)}\n" + "".join(map(to_text, some)))
    return "".join(out)


def context_from_text(text: str) -> ContextModel:
    tokens, models, top, dual, periodic = iter(text.split()), {}, 0, False, False
    for tag in tokens:
        if named(tag, ORDER_TYPES) != "COND":
            raise ValueError(tag)
        periodic, dual = next(tokens) == "1", next(tokens) == "1"
        next(tokens)
        named(next(tokens), MATRIX_TYPES)
        n, count = int(next(tokens)), int(next(tokens))
        top = max(top, n)
        keys = [(f, c) for f in (range(3) if periodic else (0,)) for c in keys_of(n, dual)]
        if count != len(keys):
            raise ValueError(f"order {n} has {count} matrices")
        models |= {k: from_tokens(tokens) for k in keys}
    return ContextModel(top // 2 if dual else top, models, dual, periodic)


def nmer_to_text(model: NmerModel) -> str:
    """NMER, order, rates by pair, n-mer frequencies, base frequencies, each with its length; then the next lower order."""
    row = lambda v: f"{len(v)} " + " ".join(repr(float(x)) for x in v) + "\n"
    own = f"NMER\n{model.n - 1}\n{row([model.rate[p] for p in NmerModel.pairs(model.n)])}{row(model.eq)}{row(model.single)}"
    return own + (nmer_to_text(model.less) if model.less else "")


def nmer_from_text(text: str) -> NmerModel:
    tokens = iter(text.split())
    row = lambda: [float(next(tokens)) for _ in range(int(next(tokens)))]

    def take() -> NmerModel | None:
        if next(tokens, None) is None:
            return None
        n = int(next(tokens)) + 1
        rate, _, single = row(), row(), tuple(row())
        return NmerModel(dict(zip(NmerModel.pairs(n), rate, strict=True)), single, take())

    if text.split()[:1] != ["NMER"]:
        raise ValueError("no NMER file")
    return take()


def raw_nmer_to_text(eq: np.ndarray, rates: np.ndarray) -> str:
    """NMER_RAW, order, frequencies and the whole rate matrix, n-mers as numbers of base 4, the last base least."""
    order = round(np.log(len(eq)) / np.log(4)) - 1
    rows = "".join(" ".join(repr(float(x)) for x in r) + "\n" for r in rates)
    return f"NMER_RAW\n{order}\n{len(eq)} " + " ".join(repr(float(x)) for x in eq) + f"\n{len(eq)} {len(eq)}\n{rows}"


def raw_nmer_from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    tag, order, *rest = text.split()
    if named(tag, ORDER_TYPES) != "NMER_RAW":
        raise ValueError(tag)
    size = 4 ** (int(order) + 1)
    values = np.array(rest, float)
    if values[0] != size or len(values) != 3 + size + size * size:
        raise ValueError(f"order {order} needs {size} n-mers")
    return values[1 : size + 1], values[size + 3 :].reshape(size, size)


def labelled_matrix(text: str) -> np.ndarray:
    """A square matrix whose first row and first column name the bases, in any order; rows and columns of A C G T."""
    head, *rows = [line.split() for line in text.splitlines() if line.strip()]
    at = {name: k for k, name in enumerate(head)}
    by = {r[0]: r[1:] for r in rows}
    return np.array([[float(by[a][at[b]]) for b in BASES] for a in BASES])


def configuration(text: str) -> dict[str, str]:
    """Lines `key = value` of a training file; # begins a comment. The keys of SETTINGS must be there."""
    lines = [line.partition("#")[0] for line in text.splitlines()]
    found = {k.strip(): v.strip() for k, bar, v in (line.partition("=") for line in lines) if bar}
    if missing := [k for k in SETTINGS if k not in found]:
        raise ValueError(f"no {', '.join(missing)}")
    named(found["context-type"], CONTEXT_TYPES), named(found["matrix-type"], MATRIX_TYPES)
    return found


#: What a training file must say.
SETTINGS = (
    "matrix-type", "max-iterations", "optimizer", "stopping-criterion", "tolerance", "gradient-threshold", "gradient-epsilon", "step-size", "order",
    "sequence-type", "context-type", "regularize", "max-seq-length", "num-progressive-replicates", "fix-one-branch-length",
)


def from_mod(text: str) -> Model:
    """Order-0 .mod file: the rows after RATE_MAT: give the six reversible rates; frequencies are left uniform."""
    rows = text.split("RATE_MAT:")[1].split()
    q = np.array([float(x) for x in rows[:16]]).reshape(4, 4)
    at = lambda pair: float(q[BASES.index(pair[0]), BASES.index(pair[1])])
    return Model("REV", tuple(at(p) for p, _ in sorted(REVERSIBLE.items(), key=lambda x: x[1])))


def raw_nmer_from_mod(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Higher-order .mod file: (n, frequencies, rate matrix)."""
    order = int(text.split("ORDER:")[1].split()[0]) + 1
    size = 4**order
    eq = np.array([float(x) for x in text.split("BACKGROUND:")[1].split()[:size]])
    return order, eq, np.array([float(x) for x in text.split("RATE_MAT:")[1].split()[: size * size]]).reshape(size, size)
