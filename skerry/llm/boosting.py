"""Gradient-boosted regression trees for binary labels, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    edges: list[np.ndarray]
    base: float
    features: np.ndarray  # trees x (2^depth - 1): feature of each inner node
    cuts: np.ndarray  # trees x (2^depth - 1): goes right if its bin is above
    leaves: np.ndarray  # trees x 2^depth

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        b, rows = self.binned(x), np.arange(len(x))
        out, inner = np.full(len(x), self.base), self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
                if not len(node) or node[0] >= inner:
                    break
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Fits trees of full depth to the logistic loss by Newton steps; an inner node without gain sends everything left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, 0.0, np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, 1 << depth)))
    b = model.binned(x).astype(np.int64)
    p = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(p / (1 - p)))
    margin = np.full(len(x), model.base)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            for j in range(x.shape[1]):
                cell = (node - first) * (BINS + 1) + b[:, j]
                gs, hs = (np.bincount(cell, v, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                features[first:][:count][better], cuts[first:][:count][better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), features[node]] > cuts[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.features, model.cuts, model.leaves = np.vstack([model.features, features]), np.vstack([model.cuts, cuts]), np.vstack([model.leaves, value])
    return model
