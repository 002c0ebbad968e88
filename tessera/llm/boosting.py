"""Gradient-boosted regression trees for a binary target, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf (log odds)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> Forest:
    """Newton steps on the logistic loss; splits by the gain over histograms of quantile bins."""
    w = np.ones(len(y)) if weight is None else weight
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    p = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    k = x.shape[1]
    flat = code + np.arange(k) * bins
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = w * (y - q), w * q * (1 - q)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) > 1:
                idx = flat[rows].ravel()
                hg = np.bincount(idx, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(axis=1)
                hh = np.bincount(idx, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(axis=1)
                gt, ht = hg[0, -1], hh[0, -1]
                gain = hg**2 / (hh + ridge) + (gt - hg) ** 2 / (ht - hh + ridge) - gt**2 / (ht + ridge)
                for f in range(k):
                    gain[f, len(cuts[f]) :] = -1
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] > 1e-9:
                    feature[t, node], threshold[t, node] = f, cuts[f][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = rate * gs / (hs + ridge)
        score += value[t][leaf]
    return Forest(start, feature, threshold, value)
