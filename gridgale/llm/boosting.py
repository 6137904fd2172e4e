"""Gradient-boosted trees on a bounded numeric sample, scored as NumPy arrays inside tasks.

Trees are complete to a fixed depth and stored level by level, so that scoring a batch is ``depth``
vectorised steps per tree and the whole model is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # the same shape: x > threshold goes right
    leaf: np.ndarray  # trees x 2**depth
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2,
        bins: int = 32, l2: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over quantile histograms."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, bias)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            size = 2**level
            best = np.full(size, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cells = len(edges[j]) + 1
                at = (node - first) * cells + binned[:, j]
                gs = np.bincount(at, g, size * cells).reshape(size, cells)
                hs = np.bincount(at, h, size * cells).reshape(size, cells)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                cut = gain.argmax(1)
                won = gain[np.arange(size), cut]
                for i in np.flatnonzero(won > best):
                    best[i] = won[i]
                    feature[k, first + i], threshold[k, first + i] = j, edges[j][cut[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        at = node - inner
        leaf[k] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[k][at]
    return Trees(feature, threshold, leaf, bias, depth)


def calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: steps (lowest score, probability) of each pool."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(scores[order], y[order], strict=True):
        pools.append([s, float(v), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, v2, n2 = pools.pop()
            pools[-1][1] += v2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])
