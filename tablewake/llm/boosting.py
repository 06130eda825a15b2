"""Gradient-boosted regression trees for a yes-or-no question, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth, side by side: a split feature, a threshold, and values at the leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float) -> None:
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Logistic loss, second-order leaf values, splits between quantile bins, all nodes of a level at a time."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    positive = y.mean()
    base = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    logits = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logits))
        slope, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (node - first) * bins + binned[:, f]
                g = np.bincount(cell, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(cell, curve, width * bins).reshape(width, bins).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
                gain = gain[:, : len(c)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
        logits += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
