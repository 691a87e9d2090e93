"""Gradient-boosted regression trees for binary labels, in NumPy, and isotonic calibration.

Trees are complete binary trees of a fixed depth grown level by level on quantile histograms
with second-order gains; a node that cannot be split sends all rows left.
"""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Boosted:
    """A fitted ensemble; ``raw`` gives log-odds, ``proba`` probabilities."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.depth, self.feature, self.threshold, self.leaf = base, depth, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float32)
        out = np.full(len(x), self.base, dtype=np.float64)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Fit on all rows of ``x``; with no rows or one class the result is a constant."""
    x = np.asarray(x, dtype=np.float32)
    n, width = x.shape
    w = np.ones(n) if weight is None else weight
    total = w.sum()
    rate0 = ((w * y).sum() + 0.5) / (total + 1.0) if n else 0.5
    base = float(np.log(rate0 / (1 - rate0)))
    inner, leaves = 2**depth - 1, 2**depth
    empty = Boosted(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(score)
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            choice = np.full((count, 2), -1)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = local * (bins + 1) + code[:, j]
                gs = np.bincount(cell, g, count * (bins + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(cell, h, count * (bins + 1)).reshape(count, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[j]):] = 0
                top = gain.argmax(1)
                value = gain[np.arange(count), top]
                better = value > best + 1e-9
                best[better] = value[better]
                choice[better, 0], choice[better, 1] = j, top[better]
            for k in range(count):
                if choice[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(base, depth, np.array(features), np.array(thresholds, np.float32), np.array(values))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of ``y`` on ``score``: knots for ``np.interp``."""
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # mean, weight, lowest score, highest score
    for a, b in zip(s, v):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
            last[1] += w
            last[3] = hi
    xs, ys = [], []
    for m, _, lo, hi in blocks:
        xs += [lo, hi]
        ys += [m, m]
    return np.array(xs), np.array(ys)
