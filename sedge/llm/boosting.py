"""Gradient-boosted trees for two classes on binned features; numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: features and edges of the inner nodes, values of the leaves."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, e, v in zip(self.feature, self.edge, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > e[node])
            out += v[node - (len(v) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Newton steps on the logistic loss; a split needs gain, else the node passes all to the left."""
    n, n_feat = x.shape
    edges = np.array([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).tolist() + [np.inf] * bins for j in range(n_feat)], dtype=object)
    edges = np.array([row[: bins - 1] for row in edges], float)
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(n_feat)], 1)
    column = np.arange(n_feat) * bins
    p0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, edge, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width = 2**d
            at = ((node - (width - 1))[:, None] * (n_feat * bins) + column + code).ravel()
            size = width * n_feat * bins
            gs = np.bincount(at, np.repeat(g, n_feat), size).reshape(width, n_feat, bins).cumsum(2)
            hs = np.bincount(at, np.repeat(h, n_feat), size).reshape(width, n_feat, bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[:, :, -1] = 0
            best = gain.reshape(width, -1).argmax(1)
            won = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // bins, best % bins
            cut = np.where(won, edges[f, np.minimum(b, bins - 2)], np.inf)
            feature[t, width - 1 : 2 * width - 1], edge[t, width - 1 : 2 * width - 1] = f, cut
            k = node - (width - 1)
            node = 2 * node + 1 + (x[np.arange(n), f[k]] > cut[k])
        k = node - inner
        value[t] = rate * np.bincount(k, g, leaves) / (np.bincount(k, h, leaves) + ridge)
        score += value[t][k]
    return Trees(feature, edge, value, base)
