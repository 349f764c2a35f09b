"""Small gradient-boosted trees: fitted in numpy on a bounded table, evaluated as a Column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: int, l2: float) -> Node:
    g, h = grad.sum(), hess.sum()
    leaf = Node(value=float(rate * g / (h + l2)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(x) - cut - 1 >= least)]
        if len(cut):
            gain = gs[cut] ** 2 / (hs[cut] + l2) + (g - gs[cut]) ** 2 / (h - hs[cut] + l2) - g**2 / (h + l2)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(feature=best[1], at=best[2], low=_grow(x[low], grad[low], hess[low], depth - 1, rate, least, l2), high=_grow(x[~low], grad[~low], hess[~low], depth - 1, rate, least, l2))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, _value(node.low, x), _value(node.high, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8, l2: float = 1.0) -> list[Node]:
    """Trees whose values add up to the log odds of y."""
    total = np.zeros(len(x))
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        out.append(_grow(x, y - p, p * (1 - p), depth, rate, least, l2))
        total += _value(out[-1], x)
    return out


def log_odds(trees: list[Node], x: np.ndarray) -> np.ndarray:
    return sum(_value(t, x) for t in trees)


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which the held-out rows have the precision wanted."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (np.append(np.diff(score[order]), -1.0) < 0))
    return float(score[order][good[-1]]) if len(good) else float("inf")


def as_column(trees: list[Node], feature: list[Column]) -> Column:
    """The sum of the trees as nested conditions."""

    def one(n: Node) -> Column:
        return F.lit(n.value) if n.feature < 0 else F.when(feature[n.feature] <= F.lit(n.at), one(n.low)).otherwise(one(n.high))

    total = one(trees[0])
    for t in trees[1:]:
        total = total + one(t)
    return total
