"""Small decision trees and boosted trees, trained here on small labelled tables."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    """Classification tree on Gini impurity; ``classes`` are the labels in sorted order."""

    def __init__(self, depth: int = 12, least: int = 1):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, labels: list[str]) -> DecisionTree:
        self.classes = sorted(set(labels))
        y = np.array([self.classes.index(v) for v in labels])
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, np.eye(len(self.classes))[y], 0)
        self._freeze()
        return self

    def _freeze(self) -> None:
        for name in ("feature", "left", "right", "value"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.cut = np.array(self.cut, float)

    def _grow(self, x: np.ndarray, hot: np.ndarray, depth: int) -> int:
        me = len(self.feature)
        for column, value in zip((self.feature, self.cut, self.left, self.right, self.value), (-1, 0.0, me, me, int(hot.sum(axis=0).argmax()))):
            column.append(value)
        total = hot.sum(axis=0)
        if depth == self.depth or total.max() == len(x) or len(x) < 2 * self.least:
            return me
        best = (1e-9, -1, 0.0)
        whole = len(x) - (total**2).sum() / len(x)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            ends = np.flatnonzero(v[1:] > v[:-1]) + 1
            ends = ends[(ends >= self.least) & (len(x) - ends >= self.least)]
            if not len(ends):
                continue
            low = np.cumsum(hot[order], axis=0)[ends - 1]
            high = total - low
            impure = len(x) - (low**2).sum(axis=1) / ends - (high**2).sum(axis=1) / (len(x) - ends)
            k = int(impure.argmin())
            if whole - impure[k] > best[0] + 1e-12:
                best = (whole - impure[k], f, (v[ends[k] - 1] + v[ends[k]]) / 2)
        if best[1] < 0:
            return me
        self.feature[me], self.cut[me] = best[1], best[2]
        low = x[:, best[1]] <= best[2]
        self.left[me] = self._grow(x[low], hot[low], depth + 1)
        self.right[me] = self._grow(x[~low], hot[~low], depth + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The index in ``classes`` of every row."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth + 1):
            f = self.feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                break
            low = x[go, f[go]] <= self.cut[at[go]]
            at[go] = np.where(low, self.left[at[go]], self.right[at[go]])
        return self.value[at]


class BoostedTrees:
    """Gradient boosting of depth-limited regression trees on logistic loss, with Newton leaf values."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        y = y.astype(float)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(x), self.base)
        self.trees: list[tuple[np.ndarray, ...]] = []
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            nodes: list[list] = []
            self._grow(binned, cuts, grad, hess, np.arange(len(x)), 0, nodes)
            tree = tuple(np.array(c, t) for c, t in zip(zip(*nodes), (np.int64, float, np.int64, np.int64, float)))
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, binned, cuts, grad, hess, rows, depth, nodes) -> int:
        me = len(nodes)
        own_grad, own_hess = grad[rows], hess[rows]
        g, h = own_grad.sum(), own_hess.sum()
        nodes.append([-1, 0.0, me, me, self.rate * g / (h + self.ridge)])
        if depth == self.depth or len(rows) < 4:
            return me
        best = (1e-6, -1, 0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            own = binned[f][rows]
            gs = np.bincount(own, own_grad, len(c) + 1).cumsum()[:-1]
            hs = np.bincount(own, own_hess, len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            return me
        _, f, k = best
        low = binned[f][rows] <= k
        if low.all() or not low.any():
            return me
        nodes[me][0], nodes[me][1] = f, cuts[f][k]
        nodes[me][2] = self._grow(binned, cuts, grad, hess, rows[low], depth + 1, nodes)
        nodes[me][3] = self._grow(binned, cuts, grad, hess, rows[~low], depth + 1, nodes)
        return me

    def _apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            leaf = f < 0
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(leaf, at, np.where(low, left[at], right[at]))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the positive class."""
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self._apply(tree, x)
        return 1 / (1 + np.exp(-total))
