"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy; for fits on bounded samples."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees for the logistic loss. A tree of depth ``d`` is kept as a full one, with its nodes level by level."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 64, penalty: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.penalty = depth, rounds, rate, bins, penalty
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for n in range(first, 2 * first + 1):
                    own = node == n
                    f, at, gain = self._best(binned[own], g[own], h[own], edges)
                    if gain > 1e-6:
                        feature[n], cut[n] = f, edges[f][at]
                    node[own] = 2 * n + 1 + (x[own, feature[n]] > cut[n])
            leaf = node - (2**self.depth - 1)
            sums = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = -self.rate * sums[0] / (sums[1] + self.penalty)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _best(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int, float]:
        best, all_g, all_h = (0, 0, 0.0), g.sum(), h.sum()
        whole = all_g**2 / (all_h + self.penalty)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            low_g = np.cumsum(np.bincount(binned[:, f], g, len(e) + 1))[:-1]
            low_h = np.cumsum(np.bincount(binned[:, f], h, len(e) + 1))[:-1]
            gain = low_g**2 / (low_h + self.penalty) + (all_g - low_g) ** 2 / (all_h - low_h + self.penalty) - whole
            at = int(gain.argmax())
            if gain[at] > best[2]:
                best = (f, at, float(gain[at]))
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels, by pooling neighbours that are out of order."""

    def fit(self, margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        at, of = np.unique(margin, return_inverse=True)  # equal margins have one value
        blocks: list[list[float]] = []
        for m, t, w in zip(at, np.bincount(of, y * weight, len(at)), np.bincount(of, weight, len(at))):
            blocks.append([t, w, m, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                total, mass, _, last = blocks.pop()
                blocks[-1][0] += total
                blocks[-1][1] += mass
                blocks[-1][3] = last
        self.at = np.array([m for b in blocks for m in b[2:]])
        self.value = np.repeat([b[0] / b[1] for b in blocks], 2)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        """Constant inside a block; linear in the gap between its last and the next block's first margin."""
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)
