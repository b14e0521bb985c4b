"""Gradient-boosted trees for a few classes: binned features, trees grown level by level, softmax loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Trees of equal depth in level order: ``feature`` and ``limit`` of every inner node, ``value`` of every leaf."""

    classes: int
    depth: int
    feature: np.ndarray  # tree x inner node
    limit: np.ndarray
    value: np.ndarray  # tree x leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes, one row per row of ``x``."""
        out = np.zeros((len(x), self.classes))
        every = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, self.feature[t, node]] > self.limit[t, node])
            out[:, t % self.classes] += self.value[t, node - self.feature.shape[1]]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 5, rate: float = 0.2, smooth: float = 2.0) -> Forest:
    """Trees for the labels ``y``; every split maximises the gain of a second-order step."""
    rows, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    limits = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(limit, column, side="left") for limit, column in zip(limits, x.T, strict=True)], axis=1)
    places = binned + np.arange(width) * BINS
    trees = rounds * classes
    forest = Forest(classes, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    scores, truth = np.zeros((rows, classes)), np.eye(classes)[y]
    for step in range(rounds):
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for c in range(classes):
            slope, bend = chance[:, c] - truth[:, c], chance[:, c] * (1 - chance[:, c])
            tree, node = step * classes + c, np.zeros(rows, np.int64)
            for level in range(depth):
                first, many = (1 << level) - 1, 1 << level
                cells = ((node - first)[:, None] * (width * BINS) + places).reshape(-1)
                shape = (many, width, BINS)
                g = np.bincount(cells, np.repeat(slope, width), many * width * BINS).reshape(shape).cumsum(axis=2)
                h = np.bincount(cells, np.repeat(bend, width), many * width * BINS).reshape(shape).cumsum(axis=2)
                gain = g**2 / (h + smooth) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + smooth) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + smooth)
                flat = gain[:, :, :-1].reshape(many, -1)
                best = flat.argmax(axis=1)
                for k in range(many):
                    column, cut = divmod(int(best[k]), BINS - 1)
                    if flat[k, best[k]] > 1e-9 and cut < len(limits[column]):
                        forest.feature[tree, first + k], forest.limit[tree, first + k] = column, limits[column][cut]
                node = 2 * node + 1 + (x[np.arange(rows), forest.feature[tree, node]] > forest.limit[tree, node])
            leaf = node - inner
            value = -rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + smooth)
            forest.value[tree] = value
            scores[:, c] += value[leaf]
    return forest
