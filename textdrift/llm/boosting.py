"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.12, 20.0, 1.0


@dataclass
class Forest:
    """``trees`` complete binary trees of ``depth`` levels: node i has the children 2i + 1 and
    2i + 2; a node that does not split has threshold infinity, so that all rows go left."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.value)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - (2 ** self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        least: float = LEAST) -> Forest:
    """Logistic loss; classes are weighted equally. Splits are searched on quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    nodes, leaves = 2 ** depth - 1, 2 ** depth
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, leaves))
    total = np.zeros(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            at = node - first
            best_gain, best = np.full(count, 1e-9), [None] * count
            for j in range(width):
                key = at * bins + binned[:, j]
                sums = [np.bincount(key, w, count * bins).reshape(count, bins).cumsum(axis=1) for w in (g, h, None)]
                left_g, left_h, left_n = sums
                all_g, all_h, all_n = (s[:, -1:] for s in sums)
                gain = (left_g ** 2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
                        - all_g ** 2 / (all_h + RIDGE))
                gain[(left_n < least) | (all_n - left_n < least)] = 0
                gain = gain[:, :len(edges[j])]
                if gain.shape[1]:
                    cut = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(count), cut] > best_gain).tolist():
                        best_gain[i], best[i] = gain[i, cut[i]], (j, cut[i])
            for i, found in enumerate(best):
                if found:
                    feature[t, first + i], threshold[t, first + i] = found[0], edges[found[0]][found[1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - nodes
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[t, leaf]
    return Forest(depth, feature, threshold, value, 0.0)
