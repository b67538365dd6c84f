"""Small decision trees, learned in numpy on the driver and applied as SQL expressions.

``forest`` grows classification trees on bootstrap samples with a random choice of features a split; ``boosted`` fits
regression trees to the gradient of the logistic loss. Training sets are bounded by whoever calls (labelled findings).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        out, low = np.empty(len(x)), x[:, self.feature] <= self.cut
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out

    def expression(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= F.lit(float(self.cut)), self.left.expression(features)).otherwise(self.right.expression(features))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, least: float, choice, leaf) -> Node:
    """A tree of least squares. ``choice()`` gives the features to try, ``leaf(y, weight)`` a leaf's value."""
    node = Node(leaf(y, weight))
    total = weight.sum()
    if depth == 0 or total < 2 * least or np.ptp(y) == 0:
        return node
    best = 1e-12
    s, base = (weight * y).sum(), (weight * y).sum() ** 2 / total
    for f in choice():
        order = np.argsort(x[:, f], kind="stable")
        v, w, wy = x[order, f], np.cumsum(weight[order]), np.cumsum((weight * y)[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        ends = ends[(w[ends] >= least) & (total - w[ends] >= least)]
        if len(ends):
            gain = wy[ends] ** 2 / w[ends] + (s - wy[ends]) ** 2 / (total - w[ends]) - base
            k = int(gain.argmax())
            if gain[k] > best:
                best, node.feature, node.cut = gain[k], int(f), float((v[ends[k]] + v[ends[k] + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.left = grow(x[low], y[low], weight[low], depth - 1, least, choice, leaf)
        node.right = grow(x[~low], y[~low], weight[~low], depth - 1, least, choice, leaf)
    return node


@dataclass
class Ensemble:
    """Trees whose sum (of log-odds, or of shares) is the score."""

    trees: list[Node]
    start: float = 0.0
    logistic: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.start + sum(t.predict(x) for t in self.trees)
        return 1 / (1 + np.exp(-total)) if self.logistic else total

    def expression(self, features: list[Column]) -> Column:
        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + t.expression(features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if self.logistic else total


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, least: float = 3, seed: int = 5) -> Ensemble:
    rng = np.random.default_rng(seed)
    some = max(1, round(x.shape[1] ** 0.5))
    grown = []
    for _ in range(trees):
        weight = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        used = weight > 0
        grown.append(grow(x[used], y[used].astype(float), weight[used], depth, least, lambda: rng.choice(x.shape[1], some, False), lambda v, w: float((v * w).sum() / w.sum()) / trees))
    return Ensemble(grown)


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.3, least: float = 5) -> Ensemble:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Ensemble([], float(np.log(share / (1 - share))), True)
    for _ in range(trees):
        p = model.predict(x)
        rest, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        # weighted by the curvature, least squares on the ratio is one Newton step
        model.trees.append(grow(x, rest / curve, curve, depth, least * 0.05, lambda: range(x.shape[1]), lambda v, w: float(rate * (v * w).sum() / (w.sum() + 1.0))))
    return model


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration of log-odds, by Newton steps with a small ridge."""
    z = np.log(np.clip(score, 1e-6, 1 - 1e-6) / np.clip(1 - score, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-9:
            break
    return float(a), float(b)
