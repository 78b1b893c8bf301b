"""Gradient-boosted trees: fitted on the driver over a bounded labelled sample, compiled into a column.

Logistic loss, least-squares trees of depth two on integer features, shrunken.
Fitting is exact and deterministic. The compiled model is nested CASE
expressions, so scoring stays in Spark's generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Split | float
    high: Split | float


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    bias: float
    trees: tuple[Split | float, ...]


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Split | float:
    leaf = float(rate * grad.sum() / (hess.sum() + 1.0))
    if not depth or len(x) < 8:
        return leaf
    whole, best = grad.sum() ** 2 / (hess.sum() + 1.0), (1e-6, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < at
            g, h = grad[low].sum(), hess[low].sum()
            gain = g * g / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
            if gain > best[0] + 1e-12:
                best = (gain, f, float(at))
    if best[0] <= 1e-6:
        return leaf
    low = x[:, best[1]] < best[2]
    return Split(best[1], best[2], _tree(x[low], grad[low], hess[low], depth - 1, rate), _tree(x[~low], grad[~low], hess[~low], depth - 1, rate))


def _value(t: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, Split):
        return np.full(len(x), t)
    return np.where(x[:, t.feature] < t.at, _value(t.low, x), _value(t.high, x))


def fit(names: tuple[str, ...], x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 2, rate: float = 0.4) -> Model:
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grown.append(_tree(x, y - p, p * (1 - p), depth, rate))
        score = score + _value(grown[-1], x)
    return Model(names, bias, tuple(grown))


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Log-odds."""
    return model.bias + sum(_value(t, x) for t in model.trees)


def compiled(model: Model, features: Column) -> Column:
    """score() as a column; features: a struct with the model's names."""

    def of(t: Split | float) -> Column:
        if not isinstance(t, Split):
            return F.lit(t)
        return F.when(features[model.names[t.feature]] < t.at, of(t.low)).otherwise(of(t.high))

    total = F.lit(model.bias)
    for t in model.trees:
        total = total + of(t)
    return total


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold above which held-out precision is as asked for, midway between the scores on either side of it."""
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(ranked[1:] != ranked[:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return float("inf")
    below = ranked[good[-1] + 1] if good[-1] + 1 < len(ranked) else ranked[good[-1]] - 1.0
    return float((ranked[good[-1]] + below) / 2)
