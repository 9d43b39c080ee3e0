"""A bidirectional gated recurrent network with attention pooling, in numpy: forward pass and gradients."""

from __future__ import annotations

import numpy as np

HIDDEN = 8


def start(inputs: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {}
    for side in "fb":
        out |= {f"w{side}": draw(inputs, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"d{side}": np.zeros(3 * HIDDEN, np.float32), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
    return out | {"a": draw(2 * HIDDEN) * 0.1, "o": draw(2 * HIDDEN), "k": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def row_sums(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows of ``values`` by number."""
    return np.stack([np.bincount(rows, values[:, i], minlength=count) for i in range(values.shape[1])], axis=1).astype(values.dtype)


def _direction(p: dict, side: str, gate: np.ndarray, places: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (T, B, H); ``gate`` holds input projections by row number, ``places`` (B, T) the row numbers."""
    many, steps = places.shape
    h = np.zeros((many, HIDDEN), np.float32)
    out = np.empty((steps, many, HIDDEN), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        gx = gate[places[:, t]]
        gh = h @ p[f"u{side}"] + p[f"c{side}"]
        rz = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, r, z, n, gh[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def logits(p: dict, table: np.ndarray, places: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Score of each window: ``table`` holds word inputs by row number, ``real`` (B, T) marks words that are there."""
    sides = []
    for side in "fb":
        kept = None if keep is None else keep.setdefault(side, [])
        sides.append(_direction(p, side, table @ p[f"w{side}"] + p[f"d{side}"], places, kept))
    h = np.concatenate(sides, axis=2)
    e = np.where(real.T, h @ p["a"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = (alpha[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep |= {"h": h, "alpha": alpha, "pooled": pooled}
    return pooled @ p["o"] + p["k"][0]


def gradients(p: dict, table: np.ndarray, places: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean log loss, its gradients by the weights, and those by the rows of ``table``."""
    keep: dict = {}
    margin = logits(p, table, places, real, keep)
    prob = _sigmoid(margin)
    loss = float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())
    d = ((prob - y) / len(y)).astype(table.dtype)
    h, alpha, g = keep["h"], keep["alpha"], {}
    g["o"], g["k"] = keep["pooled"].T @ d, np.array([d.sum()])
    dp = d[:, None] * p["o"]
    da = (h * dp).sum(axis=2)
    de = alpha * (da - (alpha * da).sum(axis=0))
    g["a"] = (de[:, :, None] * h).sum(axis=(0, 1))
    dh_all = alpha[:, :, None] * dp + de[:, :, None] * p["a"]
    rows, dtable = places.T.ravel(), np.zeros_like(table)
    for i, side in enumerate("fb"):
        u, csum = np.zeros_like(p[f"u{side}"]), np.zeros(3 * HIDDEN, np.float32)
        gates = np.empty((*places.T.shape, 3 * HIDDEN), table.dtype)
        carry = np.zeros((len(y), HIDDEN), np.float32)
        for t, before, r, z, n, ghn in reversed(keep[side]):
            dh = carry + dh_all[t, :, i * HIDDEN : (i + 1) * HIDDEN]
            dan = dh * (1 - z) * (1 - n * n)
            dgx = gates[t]
            dgx[:, :HIDDEN], dgx[:, HIDDEN : 2 * HIDDEN], dgx[:, 2 * HIDDEN :] = dan * ghn * r * (1 - r), dh * (before - n) * z * (1 - z), dan
            dgh = dgx.copy()
            dgh[:, 2 * HIDDEN :] *= r
            u += before.T @ dgh
            csum += dgh.sum(axis=0)
            carry = dh * z + dgh @ p[f"u{side}"].T
        summed = row_sums(rows, gates.reshape(-1, 3 * HIDDEN), len(table))
        dtable += summed @ p[f"w{side}"].T
        g |= {f"w{side}": table.T @ summed, f"u{side}": u, f"d{side}": summed.sum(axis=0), f"c{side}": csum}
    return loss, g, dtable
