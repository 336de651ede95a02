"""Maximum-likelihood training: the data is a table of site patterns on the cluster, the optimiser runs on the driver.

A point of the parameter space becomes rows (point, context, P of every branch), at most a few hundred, which are broadcast
to the patterns: one aggregation gives the objective at all points that are asked for, and its plan does not grow with
their number or with the tree. Where a parameter belongs to one context's matrix, only that context's patterns are
evaluated again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.models import ContextModel, Model, keys_of, random_model
from cladeframe.operators import alignment
from cladeframe.operators.likelihood import TABULATED, branch_table, column_likelihood, trimmed
from cladeframe.operators.tree import Tree

LEAST_BRANCH = 0.01


def constrain(x: np.ndarray, n_branches: int) -> np.ndarray:
    """Any reals to branch lengths (at least LEAST_BRANCH) and rates in (0, 1)."""
    out = np.arctan(x) / math.pi + 0.5
    out[:n_branches] = np.maximum(out[:n_branches], LEAST_BRANCH)
    return out


def unconstrain(p: np.ndarray) -> np.ndarray:
    return np.tan((np.clip(p, 1e-6, 1 - 1e-6) - 0.5) * math.pi)


class Objective:
    """-ln L (and a Gaussian penalty if asked for) of branch lengths and rates, over patterns with weights n.

    A context model takes its context from the column ctx, under the engine that lets the target's left context choose the
    matrix of all branches. Its parameters are those of the highest order; lower orders stay as they are, or with
    `averaged` follow as means. Points are memoised; a value that is no number counts as the worst one seen.
    """

    def __init__(self, patterns: DataFrame, tree: Tree, model: Model | ContextModel, symbol_of: Callable, sigma: float | None = None, fixed_branch: int | None = None, tree_scale_only: bool = False, averaged: bool = False):
        self.plain = isinstance(model, Model)
        self.tree, self.model, self.symbol_of = tree, ContextModel(0, {(0, ""): model}) if self.plain else model, symbol_of
        ctx = F.lit("") if self.plain else trimmed(F.col("ctx"), self.model)
        self.patterns = patterns.withColumn("_ctx", ctx).cache()
        self.sigma, self.fixed, self.scale_only, self.averaged = sigma, fixed_branch, tree_scale_only, averaged
        self.names = [c.name for _, c, _ in tree.branches()]
        self.lengths = {c.name: d for _, c, d in tree.branches()}
        self.n_branches = 1 if tree_scale_only else len(self.names)
        self.top = keys_of(self.model.top(), False)
        self.owner: list[str | None] = [None] * self.n_branches + self.model.parameter_contexts()
        self.held: dict[bytes, dict[str, float]] = {}
        self.jobs = 0
        self.worst = 0.0

    def start(self) -> np.ndarray:
        branches = [0.5] if self.scale_only else [self.lengths[n] for n in self.names]
        return unconstrain(np.array([*branches, *(x for c in self.top for x in self.model.models[0, c].params)]))

    def contexts_of(self, x: np.ndarray) -> tuple[Tree, ContextModel]:
        p = constrain(x.copy(), self.n_branches)
        if self.scale_only:
            tree = self.tree.scaled(2 * p[0])
        else:
            new = dict(zip(self.names, p, strict=False))
            if self.fixed is not None:
                new[self.names[self.fixed]] = self.lengths[self.names[self.fixed]]
            tree = self.tree.with_lengths(lambda name, d: float(new[name]))
        at, models = self.n_branches, dict(self.model.models)
        for c in self.top:
            old = models[0, c]
            models[0, c] = Model(old.kind, tuple(float(v) for v in p[at : at + len(old.params)]), old.eq, old.base)
            at += len(old.params)
        model = ContextModel(self.model.order, models)
        return tree, model.averaged() if self.averaged else model

    def parts(self, x: np.ndarray) -> tuple[Tree, Model | ContextModel]:
        tree, model = self.contexts_of(x)
        return tree, model.models[0, ""] if self.plain else model

    def _sums(self, asked: list[tuple[int, np.ndarray, str | None]]) -> dict[tuple[int, str], float]:
        """Sums of n ln L by point and context; with a context, of its patterns alone."""
        rows, tree = [], self.tree
        for k, x, only in asked:
            point, model = self.contexts_of(x)
            branches = [(child, d) for _, child, d in point.branches()]
            rows += [(k, c, *(branch_table(m, child, d) for child, d in branches)) for (_, c), m in model.models.items() if only in (None, c)]
        if len(rows) > TABULATED:
            raise ValueError(f"more than {TABULATED} points and contexts at once")
        ids = [tree.ids[id(c)] for _, c, _ in tree.branches()]
        table = self.patterns.sparkSession.createDataFrame(rows, "point int, _ctx string, " + ", ".join(f"_p{k} array<array<double>>" for k in ids))
        df = column_likelihood(self.patterns.join(F.broadcast(table), "_ctx"), tree, lambda c, d: F.col(f"_p{tree.ids[id(c)]}"), self.symbol_of, "_ll", "zero" if self.plain else "sum")
        self.jobs += 1
        got = df.groupBy("point", "_ctx").agg(F.sum(F.col("_ll") * F.col("n")).alias("s")).collect()  # points x contexts
        return {(r.point, r["_ctx"]): float(r.s) for r in got}

    def _value(self, x: np.ndarray, sums: dict[str, float]) -> float:
        value = -sum(sums.values()) + (float(x @ x) / (2 * self.sigma**2) if self.sigma else 0.0)
        value = value if math.isfinite(value) else self.worst or 1e300
        self.worst = max(self.worst, value)
        return value

    def many(self, points: list[np.ndarray]) -> list[float]:
        """The objective at each point: one job for all that are new."""
        new = list({x.tobytes(): x for x in points if x.tobytes() not in self.held}.values())
        if new:
            got = self._sums([(k, x, None) for k, x in enumerate(new)])
            for k, x in enumerate(new):
                self.held[x.tobytes()] = {c: v for (point, c), v in got.items() if point == k}
        return [self._value(x, self.held[x.tobytes()]) for x in points]

    def gradient(self, x: np.ndarray, step: float = 1e-4, points: int = 2) -> np.ndarray:
        """Symmetric differences from 2 points per parameter, one-sided from 1, or 4-point ones; a fixed branch has 0.

        A matrix's parameters are shifted on the patterns of its context alone, unless lower orders follow them."""
        free = [k for k in range(len(x)) if k != self.fixed or self.scale_only]
        shifts = {1: (0, 1), 2: (-1, 1), 4: (-2, -1, 1, 2)}[points]
        at = [(k, x + s * step * (np.arange(len(x)) == k)) for k in free for s in shifts]
        whole = [p for k, p in at if self.owner[k] is None or self.averaged or self.plain]
        self.many([x, *whole])
        base = self.held[x.tobytes()]
        some = [(j, p, self.owner[k]) for j, (k, p) in enumerate(at) if p.tobytes() not in self.held]
        got = self._sums(some) if some else {}
        f = []
        for j, (k, p) in enumerate(at):
            f.append(self._value(p, self.held[p.tobytes()] if p.tobytes() in self.held else base | ({self.owner[k]: got[j, self.owner[k]]} if (j, self.owner[k]) in got else {})))
        weight = {1: (-1, 1), 2: (-0.5, 0.5), 4: (1 / 12, -8 / 12, 8 / 12, -1 / 12)}[points]
        out = np.zeros(len(x))
        out[free] = np.array(f).reshape(len(free), len(shifts)) @ np.array(weight) / step
        return out


def minimise(objective: Objective, x: np.ndarray, rounds: int = 30, tolerance: float = 1e-2, points: int = 2, gain: float = 1e-9) -> tuple[np.ndarray, float]:
    """BFGS with step halving; ends when the gradient is small or a step gains no more than `gain` of the value."""
    (f,), g = objective.many([x]), objective.gradient(x, points=points)
    h = np.eye(len(x)) / max(1.0, np.linalg.norm(g))
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        way = -h @ g
        if way @ g >= 0:
            h, way = np.eye(len(x)) / max(1.0, np.linalg.norm(g)), -g / max(1.0, np.linalg.norm(g))
        tries = [x + way * s for s in (1.0, 0.5, 0.25, 0.1, 0.02)]
        values = objective.many(tries)
        k = int(np.argmin(values))
        if values[k] >= f - gain * max(1.0, abs(f)):
            break
        new = objective.gradient(tries[k], points=points)
        s, y = tries[k] - x, new - g
        if (sy := float(s @ y)) > 1e-12:
            rho = 1 / sy
            left = np.eye(len(x)) - rho * np.outer(s, y)
            h = left @ h @ left.T + rho * np.outer(s, s)
        x, f, g = tries[k], values[k], new
    return x, f


def train(patterns: DataFrame, tree: Tree, model: Model | ContextModel, symbol_of: Callable, **options) -> tuple[Tree, Model | ContextModel, float]:
    """The tree and model of highest likelihood found, and its -ln L (penalty included)."""
    rounds, tolerance, points = options.pop("rounds", 30), options.pop("tolerance", 1e-2), options.pop("points", 2)
    objective = Objective(patterns, tree, model, symbol_of, **options)
    x, f = minimise(objective, objective.start(), rounds, tolerance, points)
    objective.patterns.unpersist()
    return *objective.parts(x), f


def train_known_tree(patterns: DataFrame, tree: Tree, model: Model | ContextModel, symbol_of: Callable, **options) -> tuple[Tree, Model | ContextModel, float]:
    """Two passes from a tree whose proportions are known: one factor for all its branches first, then every branch freely."""
    scaled, found, _ = train(patterns, tree, model, symbol_of, tree_scale_only=True, **options)
    return train(patterns, scaled, found, symbol_of, **options)


def train_progressively(patterns: DataFrame, tree: Tree, kind: str, order: int, symbol_of: Callable, restarts: int = 1, seed: int = 0, eq: tuple[float, ...] | None = None, always: bool = True, **options) -> tuple[Tree, ContextModel, float, list[float]]:
    """Order 0 from `restarts` random matrices, the best of which is raised order by order and trained again each time.

    patterns: symbols, n, and ctx, as wide as the highest order. The last item lists the best value of each order. Without
    `always`, raising ends where an order gains nothing.
    """
    rng, best = np.random.default_rng(seed), None
    for _ in range(max(1, restarts)):
        start = random_model(kind, rng)
        start = Model(kind, start.params, eq, start.base) if eq is not None and kind in ("FEL", "HKY", "REV") else start
        got = train(patterns, tree, ContextModel(0, {(0, ""): start}), symbol_of, **options)
        best = got if best is None or got[2] < best[2] else best
    values = [best[2]]
    for _ in range(order):
        got = train(patterns, best[0], best[1].raised(), symbol_of, **options)
        if not always and got[2] >= values[-1]:
            break
        best = got
        values.append(got[2])
    return *best, values


def wobble_tracks(tracks: DataFrame, n: int, order: int, frame: int = 2) -> DataFrame:
    """Columns of one codon position of codon-trimmed tracks, with the target's left neighbours: input of a wobble model."""
    return alignment.left_sites(alignment.codon_trim(tracks), n, order, [0]).where(F.col("col") % 3 == frame)
