"""Small gradient-boosted trees for binary labels: fitted on a bounded sample, applied as a SQL expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAVES = tuple[int, float, int, int] | float


class Booster:
    """Trees of logistic loss; each is a nested tuple (feature, threshold, below, above) or a leaf's value."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, bins: int = 24, gain: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.bins, self.gain = rounds, depth, rate, least, bins, gain
        self.trees, self.prior = [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        share = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        self.prior, self.trees = float(np.log(share / (1 - share))), []
        if not 0 < y.sum() < len(y):
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        score = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            score += apply(tree, x)
        return self

    def grow(self, x, g, h, rows, cuts, depth):
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best, split = self.gain, None
        if depth and len(rows) >= 2 * self.least:
            top = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f, edges in enumerate(cuts):
                if len(edges):
                    at = np.searchsorted(edges, x[rows, f])  # value <= edges[i] falls in bins up to i
                    n, gs, hs = (np.cumsum(np.bincount(at, w, len(edges) + 1))[:-1] for w in (None, g[rows], h[rows]))
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - top
                    gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                    if gain.max() > best:
                        best, split = gain.max(), (f, float(edges[gain.argmax()]))
        if split is None:
            return float(value)
        f, edge = split
        low = x[rows, f] <= edge
        return f, edge, self.grow(x, g, h, rows[low], cuts, depth - 1), self.grow(x, g, h, rows[~low], cuts, depth - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.prior + sum((apply(t, x) for t in self.trees), np.zeros(len(x))))))

    def column(self, features: list[Column]) -> Column:
        """The same score as an expression over the features' columns."""

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, edge, low, high = tree
            return F.when(features[f] <= F.lit(edge), of(low)).otherwise(of(high))

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum((of(t) for t in self.trees), F.lit(self.prior))))


def apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, edge, low, high = tree
    return np.where(x[:, f] <= edge, apply(low, x), apply(high, x))


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on labels hold with this precision; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] < score[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.nonzero(last & (hits / n >= precision) & (hits > 0))[0] if len(y) else []
    return float(score[order][good[-1]]) if len(good) else 2.0
