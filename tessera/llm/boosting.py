"""Gradient-boosted trees for a small dense matrix, and isotonic calibration, in numpy.

Trees are fitted on a bounded sample on the driver and applied in batches on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Trees:
    """Depth-limited trees as heaps: node i has children 2i + 1 and 2i + 2; rows go right if value > cut."""

    base: float
    feature: np.ndarray  # trees x inner nodes, -1: no split
    cut: np.ndarray
    leaf: np.ndarray  # trees x all nodes

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                split = (node < inner) & (f[np.minimum(node, inner - 1)] >= 0)
                if not split.any():
                    break
                i = node[split]
                node[split] = 2 * i + 1 + (x[rows[split], f[i]] > c[i])
            out += v[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 32, most: float = 6.0, ridge: float = 2.0) -> Trees:
    """Boosted trees for the log-odds of y by second-order gains over quantile bins. One class only: no splits."""
    n, d = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    model = Trees(float(np.log(share / (1 - share))), np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, total)))
    if not n or not d:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    flat = code + bins * np.arange(d)  # one histogram for all features
    real = np.arange(bins - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    z = np.full(n, model.base)
    for t in range(trees):
        p = _sigmoid(z)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        least = min(most, 0.06 * float(h.sum()))  # a small sample may be split, too
        node = np.zeros(n, np.int64)
        for i in range(total):
            at = np.flatnonzero(node == i)
            ga, ha = g[at], h[at]
            gs, hs = ga.sum(), ha.sum()
            model.leaf[t, i] = rate * gs / (hs + ridge)
            if i >= inner or len(at) < 6:
                continue
            where = flat[at].ravel()
            cg = np.bincount(where, np.repeat(ga, d), d * bins).reshape(d, bins).cumsum(1)[:, :-1]
            ch = np.bincount(where, np.repeat(ha, d), d * bins).reshape(d, bins).cumsum(1)[:, :-1]
            gain = cg**2 / (ch + ridge) + (gs - cg) ** 2 / (hs - ch + ridge) - gs**2 / (hs + ridge)
            gain[~real | (ch < least) | (hs - ch < least)] = 0
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] > 1e-3:
                model.feature[t, i], model.cut[t, i] = j, edges[j][b]
                node[at] = 2 * i + 1 + (code[at, j] > b)
        z += model.leaf[t, node]
    return model


@dataclass
class Isotonic:
    """A non-decreasing step map from raw scores to probabilities, linear between the steps."""

    at: np.ndarray
    value: np.ndarray

    def apply(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value)


def isotonic(z: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pooled adjacent violators; no rows give a constant of one half."""
    if not len(z):
        return Isotonic(np.zeros(1), np.full(1, 0.5))
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of z
    for s, t in zip(z[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
