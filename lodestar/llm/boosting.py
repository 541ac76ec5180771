"""Gradient-boosted trees for small feature matrices, with calibration.

Logistic loss, second-order leaf values, exact search over quantile bins, and
isotonic calibration on rows that the trees have not seen.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees as flat arrays (feature, cut, value) of full trees."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        cuts = np.full((x.shape[1], self.bins - 1), np.inf)  # of few different values, all but the largest
        for f, column in enumerate(x.T):
            values = np.unique(column)
            found = values[:-1] if len(values) <= self.bins else np.unique(np.quantile(column, steps))
            cuts[f, : len(found)] = found
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        cell = binned + np.arange(x.shape[1]) * self.bins
        margin = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cell, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self.rate * self._leaf(tree, x)
        return self

    def _grow(self, binned, cell, cuts, gradient, curvature):
        """One level at a time: the sums of all nodes, features and bins at once."""
        columns, inner = binned.shape[1], (1 << self.depth) - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(gradient), int)
        for level in range(self.depth):
            nodes, first = 1 << level, (1 << level) - 1
            where = (cell + (node * columns * self.bins)[:, None]).ravel()
            g, h = (np.cumsum(np.bincount(where, np.repeat(v, columns), nodes * columns * self.bins).reshape(nodes, columns, self.bins), 2) for v in (gradient, curvature))
            score = lambda a, b: a**2 / (b + self.ridge)
            gain = score(g, h) + score(g[..., -1:] - g, h[..., -1:] - h) - score(g[..., -1:], h[..., -1:])
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(1)
            some = gain[np.arange(nodes), best] > 1e-6
            at_bin = np.where(some, best % self.bins, self.bins)
            feature[first : first + nodes] = np.where(some, best // self.bins, 0)
            at = np.minimum(at_bin, self.bins - 2)
            cut[first : first + nodes] = np.where(at_bin < self.bins - 1, cuts[feature[first : first + nodes], at], np.inf)
            node = 2 * node + (binned[np.arange(len(node)), feature[first + node]] > at_bin[node])
        sums = [np.bincount(node, v, inner + 1) for v in (gradient, curvature)]
        return feature, cut, sums[0] / (sums[1] + self.ridge)

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))


class Calibrated:
    """Margin to probability by isotonic regression (pool adjacent violators)."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, first margin
        for m, label in zip(margin[order], y[order], strict=True):
            blocks.append([float(label), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                label_sum, rows, _ = blocks.pop()
                blocks[-1][0] += label_sum
                blocks[-1][1] += rows
        self.at = np.array([b[2] for b in blocks])
        self.p = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return self.p[np.maximum(np.searchsorted(self.at, margin, side="right") - 1, 0)]


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability from which on that precision is reached."""
    for t in np.unique(p[p > 0]):
        if y[p >= t].mean() >= precision:
            return float(t)
    return 1.0
