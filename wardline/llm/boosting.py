"""Gradient-boosted trees for two classes, on rows that fit in memory: binned features, depth-first growth."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees in arrays: a node's feature (-1: a leaf), threshold, left child (the right one follows) and value."""

    def __init__(self, base: float = 0.0):
        self.base, self.trees = base, []

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (x[rows, np.maximum(f, 0)] > threshold[at])
                at = np.where(inner, step, at)
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; with one class only, the model is that class's log odds."""
    share = (weight @ y + 0.5) / (weight.sum() + 1)
    model = BoostedTrees(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: up to cut b
    out = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = rate * g / (h + ridge)
            if level == depth or len(rows) < 20:
                out[rows] += value[node]
                continue
            best, found = 1e-6, None
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                own = bins[rows, f]
                gl = np.cumsum(np.bincount(own, grad[rows], len(cuts[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(own, hess[rows], len(cuts[f]) + 1))[:-1]
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], (f, k)
            if found is None:
                out[rows] += value[node]
                continue
            f, k = found
            feature[node], threshold[node], left[node] = f, cuts[f][k], len(feature)
            feature += [-1, -1]
            threshold += [0.0, 0.0]
            left += [0, 0]
            value += [0.0, 0.0]
            goes_left = bins[rows, f] <= k
            todo += [(left[node], rows[goes_left], level + 1), (left[node] + 1, rows[~goes_left], level + 1)]
        model.trees.append((np.array(feature), np.array(threshold), np.array(left), np.array(value)))
    return model
