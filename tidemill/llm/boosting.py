"""Gradient-boosted trees for small tables of features, and their form as a Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, threshold, low, high) or a leaf's value.
Tree = tuple | float


@dataclass(frozen=True)
class Boosted:
    trees: list[Tree]
    start: float
    scale: float
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))

    def sql(self, features: str) -> str:
        """The calibrated probability, in SQL over an array of the features."""
        total = " + ".join([_number(self.start), *(_sql(t, features) for t in self.trees)])
        return f"1.0D / (1.0D + exp(-(({total}) * {_number(self.scale)} + {_number(self.shift)})))"

    def column(self, feature: dict[int, Column]) -> Column:
        """The same from the features' columns."""
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _column(t, feature)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * self.scale + self.shift)))


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _values(low, x), _values(high, x))


def _column(tree: Tree, feature: dict[int, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, t, low, high = tree
    return F.when(feature[f] <= float(t), _column(low, feature)).otherwise(_column(high, feature))


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _sql(tree: Tree, features: str) -> str:
    if not isinstance(tree, tuple):
        return _number(tree)
    f, t, low, high = tree
    return f"(CASE WHEN {features}[{f}] <= {_number(t)} THEN {_sql(low, features)} ELSE {_sql(high, features)} END)"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Tree:
    leaf = float(rate * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 10:
        return leaf
    best = (1e-6, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(np.diff(v) > 0)
        if not len(ends):
            continue
        gain = gs[ends] ** 2 / (hs[ends] + 1.0) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + 1.0) - whole
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    if best[1] is None:
        return leaf
    f, t = best[1]
    low = x[:, f] <= t
    return (f, t, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.5) -> Boosted:
    """Logistic boosting on two thirds of the rows; the last third calibrates scale and shift (Platt)."""
    held = np.arange(len(y)) % 3 == 2
    xs, ys = x[~held], y[~held]
    rateof = min(max(ys.mean(), 0.01), 0.99)
    start, trees = float(np.log(rateof / (1 - rateof))), []
    margin = np.full(len(ys), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(xs, ys - p, p * (1 - p), depth, rate))
        margin += _values(trees[-1], xs)
    raw = Boosted(trees, start, 1.0, 0.0).margin(x[held])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        e, w = y[held] - p, p * (1 - p) + 1e-9
        grad = np.array([(e * raw).sum() - 1e-2 * (a - 1), e.sum()])
        curve = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(curve, grad)
        a, b = a + step[0], b + step[1]
    return Boosted(trees, start, float(a), float(b))


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the rows reach the precision; 1.1, never reached, if there is none."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(np.diff(probability[order]) < 0, True)
    good = np.flatnonzero((right >= precision) & ends)
    return float(probability[order][good[-1]]) if len(good) else 1.1
