"""Gradient-boosted regression trees for a log loss, and isotonic calibration.

Small and dense: features are cut into quantile bins once, a node's split is
found from bin sums of gradients and curvatures, trees have a fixed depth and
are stored as flat arrays, so scoring a batch is a few array look-ups a level.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.start, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = _sigmoid(margin)
            tree, leaf = self._grow(codes, p - y, p * (1 - p))
            self.nodes.append(tree)
            margin += tree[2][leaf]
        return self

    def _grow(self, codes, gradient, curvature):
        n_nodes = (1 << self.depth) - 1
        feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes)
        at = np.zeros(len(codes), dtype=np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(count, 1e-9)
            chosen, bin_of = np.full(count, -1), np.zeros(count, dtype=np.int64)
            for f in range(codes.shape[1]):
                cell = local * width + codes[:, f]
                g = np.bincount(cell, gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(cell, curvature, count * width).reshape(count, width).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(h < self.least) | (total_h - h < self.least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], chosen[better], bin_of[better] = top[better], f, k[better]
            for node in range(count):
                if chosen[node] >= 0:
                    edges = self.edges[chosen[node]]
                    feature[first + node] = chosen[node]
                    cut[first + node] = edges[bin_of[node]] if bin_of[node] < len(edges) else np.inf
            split = chosen[local] >= 0
            right = split & (codes[np.arange(len(codes)), np.maximum(chosen[local], 0)] > bin_of[local])
            at = 2 * at + 1 + right
        leaf = at - n_nodes
        g = np.bincount(leaf, gradient, 1 << self.depth)
        h = np.bincount(leaf, curvature, 1 << self.depth)
        return (feature, cut, -self.rate * g / (h + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
            out += value[at - len(feature)]
        return out


class Isotonic:
    """Non-decreasing calibration by pooling adjacent violators, linear between the pools."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, sum of scores
        for s, v in zip(score[order], y[order]):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                v2, w2, s2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + w2, blocks[-1][2] + s2]
        self.x = np.array([b[2] / b[1] for b in blocks]) if blocks else np.array([0.0])
        # Half a case of either kind keeps the ends off 0 and 1.
        self.y = np.maximum.accumulate([(b[0] + 0.25) / (b[1] + 0.5) for b in blocks]) if blocks else np.array([0.0])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 5, **settings) -> tuple[BoostedTrees, Isotonic]:
    """Trees on all rows, calibrated on margins that trees of other folds gave."""
    out_of_fold = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        if (fold != k).any() and (fold == k).any():
            out_of_fold[fold == k] = BoostedTrees(**settings).fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return BoostedTrees(**settings).fit(x, y), Isotonic().fit(out_of_fold, y)
