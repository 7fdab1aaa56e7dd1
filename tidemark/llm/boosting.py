"""Gradient-boosted trees for a yes-no label: binned features, fixed depth, logistic loss. Small and vectorised."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, depth: int = 3, trees: int = 36, rate: float = 0.3, bins: int = 24):
        self.depth, self.trees, self.rate, self.bins = depth, trees, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        nodes = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((self.trees, nodes), int), np.zeros((self.trees, nodes), int), np.zeros((self.trees, nodes + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), int)  # node of this level
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, -1.0)
                for f in range(x.shape[1]):
                    k = at * (self.bins + 1) + b[:, f]
                    gs = np.bincount(k, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(k, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1))[:, :-1]
                    c = gain.argmax(1)
                    better = gain[np.arange(width), c] > best + 1e-9
                    best = np.where(better, gain[np.arange(width), c], best)
                    self.feature[t, first : first + width][better] = f
                    self.cut[t, first : first + width][better] = c[better]
                node = first + at
                at = at * 2 + (b[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            gs, hs = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
            self.leaf[t] = self.rate * gs / (hs + 1)
            score += self.leaf[t, at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes."""
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        score = np.full(len(x), self.start)
        # a tree's tests on all rows first, then the path through them
        for t in range(self.trees):
            yes = b[:, self.feature[t]] > self.cut[t]
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                side = yes[:, (1 << level) - 1]
                for k in range(1, 1 << level):
                    side = np.where(at == k, yes[:, (1 << level) - 1 + k], side)
                at = at * 2 + side
            score += self.leaf[t, at]
        return 1 / (1 + np.exp(-score))
