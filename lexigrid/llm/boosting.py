"""Gradient-boosted trees for two classes on small tables: histogram splits, logistic loss, numpy alone."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth, as arrays: of node k, the children are 2k + 1 and 2k + 2."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, limit, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2 * inner + 1)
            at = np.zeros(n, int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = self._split(binned[rows], g[rows], h[rows], cuts) if len(rows) > 1 else None
                if best:
                    feature[node], limit[node] = best
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            for leaf in range(inner, 2 * inner + 1):
                rows = at == leaf
                value[leaf] = -self.rate * g[rows].sum() / (h[rows].sum() + self.penalty)
            self.trees.append((feature, limit, value))
            score += value[at]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
        total_g, total_h, best, found = g.sum(), h.sum(), 1e-6, None
        whole = total_g**2 / (total_h + self.penalty)
        for f, limits in enumerate(cuts):
            if not len(limits):
                continue
            left_g = np.bincount(binned[:, f], g, len(limits) + 1).cumsum()[:-1]
            left_h = np.bincount(binned[:, f], h, len(limits) + 1).cumsum()[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - whole
            gain[(left_h < self.least * 0.05) | (right_h < self.least * 0.05)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, float(limits[k]))
        return found

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            score += value[at]
        return score
