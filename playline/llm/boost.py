"""Gradient-boosted trees for two classes, in numpy, for bounded samples.

Features are binned at quantiles; a tree splits every node of a level at the
best bin by second-order gain; leaves take one Newton step. The fitted model is
a small dict of arrays that tasks apply to whole batches."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 3,
        rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> dict:
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    start = float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
    score = np.full(n, start)
    feat, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(n, dtype=np.int64)
        tree_f, tree_c = np.zeros(2 ** depth - 1, dtype=np.int64), np.full(2 ** depth - 1, np.inf)
        for d in range(depth):
            width = 2 ** d
            best = np.full(width, 1e-9)
            best_f, best_b = np.zeros(width, dtype=np.int64), np.full(width, bins)
            for j in range(f):
                key = node * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                gain[:, len(edges[j]):] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better], best_f[better], best_b[better] = top[better], j, b[better]
            for k in range(width):
                at = width - 1 + k
                tree_f[at] = best_f[k]
                if best_b[k] < len(edges[best_f[k]]):
                    tree_c[at] = edges[best_f[k]][best_b[k]]
            node = 2 * node + (binned[np.arange(n), best_f[node]] > best_b[node])
        gl = np.bincount(node, g, 2 ** depth)
        hl = np.bincount(node, h, 2 ** depth)
        value = -rate * gl / (hl + ridge)
        score = score + value[node]
        feat.append(tree_f)
        cut.append(tree_c)
        leaf.append(value)
    return {"start": start, "depth": depth, "feat": np.array(feat), "cut": np.array(cut), "leaf": np.array(leaf)}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    """Additive score of every row (log-odds before calibration)."""
    out = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for f, c, v in zip(model["feat"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), dtype=np.int64)
        for d in range(model["depth"]):
            at = 2 ** d - 1 + node
            node = 2 * node + (x[rows, f[at]] > c[at])
        out += v[node]
    return out


def calibrate(s: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling (a, b): P(1 | s) = 1 / (1 + exp(-(a s + b))), by damped Newton steps."""
    a, b = 1.0, 0.0
    # smoothed targets keep the fit finite on separable data
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        d, w = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = d @ s, d.sum()
        haa, hab, hbb = w @ (s * s) + 1e-3, w @ s, w.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a - 0.7 * (hbb * ga - hab * gb) / det, b - 0.7 * (haa * gb - hab * ga) / det
    return float(a), float(b)
