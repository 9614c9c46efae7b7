"""Gradient-boosted trees on binned features with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges of each column: distinct quantiles; none without rows."""
    if not len(x):
        return [np.zeros(0) for _ in range(x.shape[1])]
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], 1)


@dataclass
class Forest:
    """All trees in one set of arrays: node i tests x[feature] > threshold and goes to child + (result)."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: int = 12) -> Forest:
    """Logistic boosting by second-order gains. signs: +1 or -1 for features the score must rise or fall with.

    A constrained split whose children break the order is not taken, and bounds on the leaf values pass
    down (the middle of the two children's), so the whole score is monotonic. Leaves loop onto themselves,
    so each row takes the same number of steps.
    """
    edges = edges_of(x, bins)
    codes = binned(x, edges)
    width = max(len(e) for e in edges) + 1
    p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), bias)
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(v)
        return len(value) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, width))[: len(e)] for w in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) - gs**2 / (2 * (hs + ridge))
                gain[(nl < least) | (nr < least)] = -1
                if f in signs:
                    gain[(vr - vl) * signs[f] < 0] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            value[at] = rate * float(np.clip(-gs / (hs + ridge), low, high))
            score[rows] += value[at]
            return
        f, k, vl, vr = best[1]
        left = leaf(0.0)
        leaf(0.0)
        feature[at], threshold[at], child[at] = f, edges[f][k], left
        middle, right = (vl + vr) / 2, codes[rows, f] > k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs.get(f, 0), ((low, high), (low, high)))
        grow(left, rows[~right], g, h, level + 1, *bounds[0])
        grow(left + 1, rows[right], g, h, level + 1, *bounds[1])

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        root = leaf(0.0)
        roots.append(root)
        grow(root, np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0)
    # np.searchsorted(edges, x, "right") > k is x >= edges[k]: tests are "greater", so thresholds go one step down
    return Forest(np.array(feature, int), np.where(np.isinf(threshold), np.inf, np.nextafter(np.array(threshold, float), -np.inf)), np.array(child, int), np.array(value, float), np.array(roots, int), depth, bias)
