"""Small gradient-boosted trees for binary labels, trained on a bounded sample and applied in batches with NumPy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting over quantile bins; every tree has the same depth and splits by the exact gain."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, d = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        rate = np.clip((w @ y) / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        inner, width = 2**self.depth - 1, self.bins + 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64)
            node = np.zeros(n, dtype=np.int64)  # position within the level
            for level in range(self.depth):
                m = 2**level
                best, best_gain = np.zeros((m, 2), dtype=np.int64), np.full(m, 1e-6)
                best[:, 1] = width
                for j in range(d):
                    at = node * width + binned[:, j]
                    gs = np.cumsum(np.bincount(at, g, m * width).reshape(m, width), axis=1)
                    hs = np.cumsum(np.bincount(at, h, m * width).reshape(m, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least * 0.01) | (ht - hs < self.least * 0.01)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(m), k]
                    better = top > best_gain
                    best[better] = np.stack([np.full(m, j), k], axis=1)[better]
                    best_gain[better] = top[better]
                feature[m - 1 : 2 * m - 1], cut[m - 1 : 2 * m - 1] = best[:, 0], best[:, 1]
                node = node * 2 + (binned[np.arange(n), best[node, 0]] > best[node, 1])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            score += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        n = len(x)
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if n else np.zeros((0, len(self.edges)), dtype=np.int64)
        out, rows = np.full(n, self.base), np.arange(n)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (binned[rows, feature[at]] > cut[at])
            out += value[node]
        return 1 / (1 + np.exp(-out))
