"""Gradient-boosted trees for two classes: logistic loss, binned features, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if value > threshold
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner > 0 and at[:1].size and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], 1)  # bin > b means value > edges[b]
    shifted = coded + np.arange(width) * bins
    usable = np.arange(bins)[None, :] < np.array([len(e) for e in edges])[:, None]
    p = float(np.average(y, weights=weight))
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = weight * (q - y), weight * q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            rows = np.arange(n)
            slot = ((at - first) * (width * bins))[:, None] + shifted
            gs = np.bincount(slot.ravel(), np.repeat(g, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            hs = np.bincount(slot.ravel(), np.repeat(h, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            gt, ht = gs[..., -1:], hs[..., -1:]
            gain = np.where(usable, gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge), 0).reshape(count, -1)
            k = gain.argmax(1)
            for node, (j, b) in enumerate(zip(k // bins, k % bins, strict=True)):
                if gain[node, k[node]] > 1e-6:
                    feature[first + node], threshold[first + node] = j, edges[j][b]
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        gl = np.bincount(at - inner, g, 2**depth)
        hl = np.bincount(at - inner, h, 2**depth)
        leaf = -rate * gl / (hl + ridge)
        score += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
