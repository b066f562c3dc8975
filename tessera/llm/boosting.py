"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy.

Fitted on the driver over a bounded sample; a model is a few small arrays that score batches on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Newton boosting on quantile bins; a level of a tree is split by histograms of gradients."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            here = node - first
            best = np.zeros(wide)
            total_g, total_h = np.bincount(here, g, wide), np.bincount(here, h, wide)
            for j in range(m):
                size = len(edges[j]) + 1
                cell = here * size + binned[:, j]
                left_g = np.bincount(cell, g, wide * size).reshape(wide, size).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(cell, h, wide * size).reshape(wide, size).cumsum(axis=1)[:, :-1]
                if not left_g.size:
                    continue
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                k = gain.argmax(axis=1)
                top = gain[np.arange(wide), k]
                better = top > best + 1e-9
                best[better] = top[better]
                features[t, first : first + wide][better] = j
                thresholds[t, first : first + wide][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        at = node - inner
        values[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += values[t, at]
    return Trees(base, features, thresholds, values)


@dataclass(frozen=True)
class Isotonic:
    """A rising step function through (at, value), linear between its steps."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted sum, first and last margin
    for m, v, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([w, w * v, m, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, hi = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][3] = hi
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    value = np.array([x for b in blocks for x in (b[1] / b[0],) * 2])
    return Isotonic(at, value)
