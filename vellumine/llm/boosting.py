"""Gradient-boosted trees for two classes over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of full depth; each node splits where a feature exceeds a bound, leaves hold log odds."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.features: list[np.ndarray] = []
        self.bounds: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, b, leaf in zip(self.features, self.bounds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; splits by gain over at most `bins` quantile bounds of each feature."""
    n, m = x.shape
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)  # above bound i from bin i + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    score = np.full(n, model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            lo = 2**level - 1
            width = 2**level
            best = np.full(width, 1e-6)
            local = at - lo
            for j in range(m):
                k = len(bounds[j]) + 1
                if k == 1:
                    continue
                cell = local * k + binned[:, j]
                gs = np.bincount(cell, g, width * k).reshape(width, k)
                hs = np.bincount(cell, h, width * k).reshape(width, k)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, :-1]
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[lo : lo + width][better] = j
                bound[lo : lo + width][better] = bounds[j][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > bound[at])
        at -= inner
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        score += leaf[at]
        model.features.append(feature)
        model.bounds.append(bound)
        model.leaves.append(leaf)
    return model
