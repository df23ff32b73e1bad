"""Gradient-boosted trees for yes or no, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees: at inner node i a row goes to 2i + 1, or to 2i + 2 if its feature exceeds the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 48, smooth: float = 5.0) -> BoostedTrees:
        """Newton boosting of the logistic loss; each split is the one with most gain among the bins' borders."""
        n, width = rows.shape
        borders = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(b, rows[:, f], side="left") for f, b in enumerate(borders)])
        y = labels.astype(float)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        score = np.full(n, start)
        inner, leaves = (1 << depth) - 1, 1 << depth
        feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                count, base = 1 << level, (1 << level) - 1
                best = np.full(count, 1e-6)
                for f in range(width):
                    if not len(borders[f]):
                        continue
                    size = len(borders[f]) + 1
                    key = at * size + binned[f]
                    gs = np.cumsum(np.bincount(key, g, count * size).reshape(count, size), axis=1)
                    hs = np.cumsum(np.bincount(key, h, count * size).reshape(count, size), axis=1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    left, right = gs[:, :-1], total_g - gs[:, :-1]
                    gain = left**2 / (hs[:, :-1] + smooth) + right**2 / (total_h - hs[:, :-1] + smooth) - total_g**2 / (total_h + smooth)
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(count), top] > best
                    best = np.where(better, gain[np.arange(count), top], best)
                    feature[t, base : base + count][better] = f
                    threshold[t, base : base + count][better] = borders[f][top[better]]
                own = base + at
                at = 2 * at + (rows[np.arange(n), feature[t, own]] > threshold[t, own])
            value[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + smooth)
            score += value[t][at]
        return cls(feature, threshold.astype(np.float32), value, start)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        n, depth = len(rows), self.value.shape[1].bit_length() - 1
        score, each = np.full(n, self.start), np.arange(n)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(n, np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[each, feature[at]] > threshold[at])
            score += value[at - len(feature)]
        return 1 / (1 + np.exp(-score))
