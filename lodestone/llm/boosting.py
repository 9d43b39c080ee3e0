"""Gradient-boosted trees of depth two on a bounded training set, written out as one SQL expression.

Fitting is plain numpy on the driver; scoring runs wherever Spark evaluates columns.
"""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) of one split; rows at or below the threshold go left."""
    best = (0.0, -1, 0.0)
    g, h = grad.sum(), hess.sum() + 1.0
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        gl, hl = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1] + 1.0
        gain = gl * gl / hl + (g - gl) ** 2 / (h - hl + 1.0) - g * g / h
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and gain.max() > best[0] + 1e-9:
            i = int(gain.argmax())
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, rate: float = 0.4) -> list[tuple]:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values."""
    margin, out = np.zeros(len(y)), []

    def grow(rows: np.ndarray, depth: int):
        p = 1 / (1 + np.exp(-margin[rows]))
        grad, hess = y[rows] - p, p * (1 - p)
        gain, f, at = _split(x[rows], grad, hess) if depth else (0.0, -1, 0.0)
        if f < 0:
            value = rate * float(grad.sum() / (hess.sum() + 1.0))
            margin[rows] += value
            return value
        left = x[rows, f] <= at
        return f, at, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    for _ in range(trees):
        out.append(grow(np.arange(len(y)), 2))
    return out


def predict(model: list, x: np.ndarray) -> np.ndarray:
    def run(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return np.array([sum(run(t, row) for t in model) for row in x])


def sql(model: list, names: list[str]) -> str:
    """The summed margin as an SQL expression over columns ``names``."""

    def one(node) -> str:
        if not isinstance(node, tuple):
            return f"{node!r}D"
        return f"CASE WHEN {names[node[0]]} <= {node[1]!r}D THEN {one(node[2])} ELSE {one(node[3])} END"

    return " + ".join(one(t) for t in model) or "0D"


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic link from margin to probability (Newton's method)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((y - p) * margin).sum() - (a - 1), (y - p).sum() - 0.1 * b
        haa, hab, hbb = (w * margin * margin).sum() + 1, (w * margin).sum(), w.sum() + 0.1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        short = min(1.0, 1 / max(abs(da), abs(db), 1e-9))
        a, b = a + short * da, b + short * db
    return float(a), float(b)


def cutoff(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest threshold from which the precision on held-out rows is at least ``precision``."""
    order = np.argsort(-probability, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fits = np.flatnonzero(good >= precision)
    return float(probability[order][fits[-1]]) if len(fits) else 1.0
