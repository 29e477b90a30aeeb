"""Gradient-boosted trees on histograms of dense features, and isotonic calibration (numpy only)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; every tree splits all nodes of a level by their best histogram cut."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """weight: how many rows each row stands for, 1 on average so that l2 keeps its meaning; cuts and least go by rows."""
        n, f = x.shape
        weight = np.ones(n) if weight is None else weight
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([np.quantile(x[:, j], q), np.quantile(x[x[:, j] > 0, j], q) if (x[:, j] > 0).any() else []])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        width = max(len(e) for e in self.edges) + 1
        rate = min(max(np.average(y, weights=weight), 1e-6), 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, dtype=np.int64)
            feature = np.full(2**self.depth - 1, -1)
            cut = np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.zeros(count)
                where = np.full((count, 2), -1)
                for j in range(f):
                    key = (node - first) * width + binned[:, j]
                    sums = [np.bincount(key, w, count * width).reshape(count, width).cumsum(1) for w in (g, h, None)]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(count), top]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    where[better] = np.stack([np.full(count, j), top], 1)[better]
                go = np.zeros(n, dtype=np.int64)
                for k in range(count):
                    j, b = where[k]
                    own = node == first + k
                    if j >= 0 and b < len(self.edges[j]):
                        feature[first + k], cut[first + k] = j, self.edges[j][b]
                        go[own] = binned[own, j] > b
                node = 2 * node + 1 + go
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.forest.append((feature, cut, value))
            score += value[leaf]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.forest:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[node]
                node = 2 * node + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > cut[node]))
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of probabilities that rise with the score; linear between, flat beyond."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        weight = np.ones(len(y)) if weight is None else weight
        s, inverse = np.unique(score, return_inverse=True)
        w = np.bincount(inverse, weight)
        v = np.bincount(inverse, weight * y) / w
        blocks: list[list[float]] = []  # value, weight, first, last
        for i in range(len(s)):
            blocks.append([v[i], w[i], s[i], s[i]])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        self.x = np.array([z for b in blocks for z in b[2:]])
        self.y = np.array([b[0] for b in blocks for _ in range(2)])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0, 1)
