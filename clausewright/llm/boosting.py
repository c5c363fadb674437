"""Gradient-boosted trees for two classes, small enough to be sent with a task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth, thresholds from quantiles; deterministic.

    Fitted on the driver from a bounded sample; the model has a fixed size.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base = 0.0
        self.nodes: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features, y: 0 or 1."""
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 2)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])  # how many cuts a value is above
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            where = np.zeros(len(y), dtype=np.int64)
            for node in range(len(tree)):
                m = where == node
                g, h = grad[m].sum(), hess[m].sum()
                value = g / (h + 1.0)
                tree[node] = (-1, 0.0, float(value))
                if node >= 2**self.depth - 1 or m.sum() < 10:
                    continue
                best, pick = 1e-6, None
                gs, hs = grad[m], hess[m]
                for f, c in enumerate(cuts):
                    above = code[f, m]
                    gr, hr = (np.bincount(above, v, len(c) + 1)[::-1].cumsum()[::-1][1:] for v in (gs, hs))
                    gain = gr**2 / (hr + 1) + (g - gr) ** 2 / (h - hr + 1) - g**2 / (h + 1)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best:
                        best, pick = gain[k], (f, float(c[k]))
                if pick is None:
                    continue
                tree[node] = (pick[0], pick[1], float(value))
                rows = np.flatnonzero(m)
                where[rows] = 2 * node + 1 + (x[rows, pick[0]] > pick[1])
            self.nodes.append(tree)
            score += self.rate * np.array([t[2] for t in tree])[where]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        score = np.full(len(x), self.base)
        for tree in self.nodes:
            feature = np.array([t[0] for t in tree])
            cut, value = np.array([t[1] for t in tree]), np.array([t[2] for t in tree])
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                step = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(inner, step, at)
            score += self.rate * value[at]
        return 1 / (1 + np.exp(-score))
