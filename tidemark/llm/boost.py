"""Gradient-boosted trees for binary labels: histogram fit in numpy, prediction in numpy or as a Column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A tree is a leaf value (float) or (feature index, threshold, tree if x <= threshold, tree otherwise).
Tree = float | tuple


class Booster:
    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0, share: float = 1.0):
        """share: of the features, those that a tree may split on, drawn anew for each tree."""
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.share = rounds, depth, rate, bins, penalty, share
        self.base, self.trees, self.scale, self.shift = 0.0, [], 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """x: rows by features, finite; y: 0 or 1. One class or no rows: a constant prediction."""
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), self.base)
        rng = np.random.default_rng(x.shape[1])
        use = max(1, math.ceil(self.share * x.shape[1]))
        for _ in range(self.rounds):
            mine = set(rng.permutation(x.shape[1])[:use].tolist())
            offered = [e if j in mine else e[:0] for j, e in enumerate(edges)]
            p = 1 / (1 + np.exp(-raw))
            tree, step = self._grow(code, offered, y - p, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += step
        return self

    def _grow(self, code, edges, g, h, rows, depth) -> tuple[Tree, np.ndarray]:
        step = np.zeros(len(g))
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(self.rate * total_g / (total_h + self.penalty))
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 8:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                left_g = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + self.penalty) + (total_g - left_g) ** 2 / (total_h - left_h + self.penalty)
                gain -= total_g**2 / (total_h + self.penalty)
                gain[(left_h < 1e-3) | (total_h - left_h < 1e-3)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            step[rows] = value
            return value, step
        goes = code[rows, best[1]] <= best[2]
        a, sa = self._grow(code, edges, g, h, rows[goes], depth - 1)
        b, sb = self._grow(code, edges, g, h, rows[~goes], depth - 1)
        return (best[1], float(edges[best[1]][best[2]]), a, b), sa + sb

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """Platt scaling on rows that fit() has not seen; too few rows leave the scores as they are."""
        if len(y) < 20 or y.min() == y.max():
            return self
        raw, a, b = self.raw(x), 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((target - p) * raw).sum(), (target - p).sum()])
            hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if a > 0:
            self.scale, self.shift = float(a), float(b)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        def value(tree: Tree, rows: np.ndarray, out: np.ndarray) -> None:
            if not isinstance(tree, tuple):
                out[rows] += tree
                return
            goes = x[rows, tree[0]] <= tree[1]
            value(tree[2], rows[goes], out)
            value(tree[3], rows[~goes], out)

        out = np.full(len(x), self.base)
        for t in self.trees:
            value(t, np.arange(len(x)), out)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def column(self, features: Sequence[Column]) -> Column:
        """The same probability as a Column over double columns."""

        def value(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(features[tree[0]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

        raw = reduce(lambda a, b: a + b, map(value, self.trees), F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * self.scale + self.shift)))
