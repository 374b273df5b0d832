"""Gradient-boosted trees and isotonic calibration over bounded dense samples (NumPy)."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Binary logistic boosting of depth-limited trees on quantile-binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.start)
        self.forest = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, add = self._grow(binned, y - p, p * (1 - p))
            self.forest.append(tree)
            score += add
        return self

    def _grow(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """A complete binary tree as (feature, bin, values); feature -1 marks a node that sends all rows left."""
        nodes = 2**self.depth - 1
        feature, cut = np.full(nodes, -1), np.zeros(nodes, int)
        node = np.zeros(len(grad), int)
        for k in range(nodes):
            rows = np.flatnonzero(node == k)
            if len(rows):
                feature[k], cut[k] = self._split(x[rows], grad[rows], hess[rows])
            right = x[rows, feature[k]] > cut[k] if feature[k] >= 0 else np.zeros(len(rows), bool)
            node[rows] = 2 * k + 1 + right
        leaf = node - nodes
        g, h = (np.bincount(leaf, v, nodes + 1) for v in (grad, hess))
        values = self.rate * g / (h + self.ridge)
        return (feature, cut, values), values[leaf]

    def _split(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best, found = 1e-6, (-1, 0)
        whole = grad.sum() ** 2 / (hess.sum() + self.ridge)
        for f in range(x.shape[1]):
            g, h = (np.cumsum(np.bincount(x[:, f], v, BINS)) for v in (grad, hess))
            gain = g**2 / (h + self.ridge) + (g[-1] - g) ** 2 / (h[-1] - h + self.ridge) - whole
            gain[(h < self.least) | (h[-1] - h < self.least)] = 0
            if gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows."""
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1)
        out = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, values in self.forest:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (binned[at, np.maximum(f, 0)] > cut[node]))
            out += values[node - len(feature)]
        return out


class Isotonic:
    """Non-decreasing fit of labels on scores (pool adjacent violators), linear between the blocks' centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
        for s, label in zip(score[order], y[order], strict=True):
            blocks.append([label, 1, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        # half a label of each kind keeps a block's value off 0 and 1
        self.at = np.array([s / n for _, n, s in blocks]) if blocks else np.zeros(1)
        self.value = np.maximum.accumulate([(t + 0.5) / (n + 1) for t, n, _ in blocks]) if blocks else np.full(1, 0.5)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
