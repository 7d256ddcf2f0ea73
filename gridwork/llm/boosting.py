"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: a feature and a threshold per inner node, a value per leaf."""
    features: np.ndarray    # trees x (2**depth - 1)
    thresholds: np.ndarray
    values: np.ndarray      # trees x 2**depth
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float,
        bins: int = 24, ridge: float = 4.0) -> Trees:
    """Fit by second-order steps on the logistic loss; splits lie between quantiles of a feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.average(y, weights=weight)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2 ** depth - 1
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            start, nodes = 2 ** level - 1, 2 ** level
            best = np.full(nodes, 1e-6)
            split = np.full((nodes, 2), -1)
            for f in range(width):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                cell = (at - start) * size + binned[:, f]
                g = np.bincount(cell, slope, nodes * size).reshape(nodes, size).cumsum(axis=1)
                h = np.bincount(cell, curve, nodes * size).reshape(nodes, size).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g ** 2 / (whole_h + ridge))[:, :-1]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(nodes), cut]
                better = top > best
                best[better] = top[better]
                split[better] = np.stack([np.full(nodes, f), cut], axis=1)[better]
            for i, (f, cut) in enumerate(split):
                if f >= 0:
                    feature[start + i], threshold[start + i] = f, edges[f][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        score = score + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
