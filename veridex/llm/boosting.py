"""Gradient boosted trees on a small table of integer features, and their score as a column expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf's value, or feature, split (left where the feature is at most this), left and right.
Tree = float | tuple[int, int, "Tree", "Tree"]


def _tree(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, depth: int, least: int) -> Tree:
    leaf = float(gradient.sum() / (curvature.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, at = gradient.sum() ** 2 / (curvature.sum() + 1.0) + 1e-6, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(gradient[order]), np.cumsum(curvature[order])
        k = np.flatnonzero(v[1:] != v[:-1])
        k = k[(k + 1 >= least) & (len(v) - k - 1 >= least)]
        if len(k):
            gain = g[k] ** 2 / (h[k] + 1.0) + (g[-1] - g[k]) ** 2 / (h[-1] - h[k] + 1.0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, at = gain[i], (f, int(v[k[i]]))
    if at is None:
        return leaf
    left = x[:, at[0]] <= at[1]
    return (*at, *(_tree(x[m], gradient[m], curvature[m], depth - 1, least) for m in (left, ~left)))


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, split, left, right = tree
    return np.where(x[:, f] <= split, _values(left, x), _values(right, x))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> list[Tree]:
    """Trees of the logistic loss, each on the residuals of those before; the score is ``rate`` times their sum."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), depth, least)
        trees.append(tree)
        score += rate * _values(tree, x)
    return trees


def scores(trees: list[Tree], x: np.ndarray, rate: float = 0.3) -> np.ndarray:
    return rate * sum((_values(t, x) for t in trees), np.zeros(len(x)))


def score_column(trees: list[Tree], feature: Callable[[int], Column], rate: float = 0.3) -> Column:
    def of(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, split, left, right = tree
        return F.when(feature(f) <= split, of(left)).otherwise(of(right))

    total = F.lit(0.0)
    for t in trees:
        total = total + of(t)
    return total * rate
