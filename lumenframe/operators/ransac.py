"""Two-view verification: fundamental matrix and homography by RANSAC, a group of matches at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HYPOTHESES = 2000
#: Matches of a pair that are worked on at once, with 250 hypotheses: what memory a pair takes beyond its matches.
MATCHES = 1024
_SCHEMA = "source long, target long, model string, inliers long, matches long, coverage double, displacement double, matrix array<double>"


def _normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points with zero mean and mean distance sqrt 2, and the transform, for a stack of samples."""
    mean = p.mean(axis=-2, keepdims=True)
    scale = np.sqrt(2) / np.maximum(np.linalg.norm(p - mean, axis=-1).mean(axis=-1), 1e-12)
    t = np.zeros((*p.shape[:-2], 3, 3))
    t[..., 0, 0] = t[..., 1, 1] = scale
    t[..., :2, 2] = -scale[..., None] * mean[..., 0, :]
    t[..., 2, 2] = 1
    return (p - mean) * scale[..., None, None], t


def _least(rows: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The vector that the matrix of ``rows`` of the matches shrinks most, per sample."""
    total = 0.0
    for at in range(0, x.shape[-2], MATCHES):
        m = rows(x[..., at : at + MATCHES, :], y[..., at : at + MATCHES, :])
        total = total + np.swapaxes(m, -1, -2) @ m
    return np.linalg.eigh(total)[1][..., 0]


def _epipolar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    one = np.ones(x.shape[:-1])
    return np.stack([y[..., 0] * x[..., 0], y[..., 0] * x[..., 1], y[..., 0], y[..., 1] * x[..., 0], y[..., 1] * x[..., 1], y[..., 1], x[..., 0], x[..., 1], one], axis=-1)


def _transfer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    zero, one = np.zeros(x.shape[:-1]), np.ones(x.shape[:-1])
    top = np.stack([x[..., 0], x[..., 1], one, zero, zero, zero, -y[..., 0] * x[..., 0], -y[..., 0] * x[..., 1], -y[..., 0]], axis=-1)
    low = np.stack([zero, zero, zero, x[..., 0], x[..., 1], one, -y[..., 1] * x[..., 0], -y[..., 1] * x[..., 1], -y[..., 1]], axis=-1)
    return np.concatenate([top, low], axis=-2)


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank-two matrices of samples of eight or more matches."""
    x, tx = _normal(a)
    y, ty = _normal(b)
    u, s, vt = np.linalg.svd(_least(_epipolar, x, y).reshape(*a.shape[:-2], 3, 3))
    s[..., 2] = 0
    return np.swapaxes(ty, -1, -2) @ (u * s[..., None, :]) @ vt @ tx


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, tx = _normal(a)
    y, ty = _normal(b)
    return np.linalg.inv(ty) @ _least(_transfer, x, y).reshape(*a.shape[:-2], 3, 3) @ tx


def errors(model: str, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared errors (models, matches): larger point-line distance, or one-way transfer."""
    (ax, ay), (bx, by) = a.T, b.T
    row = lambda i, x, y: m[:, i, 0, None] * x + m[:, i, 1, None] * y + m[:, i, 2, None]
    with np.errstate(all="ignore"):
        if model == "homography":
            z = row(2, ax, ay)
            out = (row(0, ax, ay) / z - bx) ** 2 + (row(1, ax, ay) / z - by) ** 2
        else:
            l0, l1 = row(0, ax, ay), row(1, ax, ay)
            n = (l0 * bx + l1 * by + row(2, ax, ay)) ** 2
            r0, r1 = (m[:, 0, i, None] * bx + m[:, 1, i, None] * by + m[:, 2, i, None] for i in range(2))
            out = n / np.minimum(l0 * l0 + l1 * l1, r0 * r0 + r1 * r1)
    return np.where(np.isfinite(out), out, np.inf)


def _scored(model: str, m: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Inliers and truncated cost of each model over all matches."""
    n, cost = np.zeros(len(m), int), np.zeros(len(m))
    for at in range(0, len(a), MATCHES):
        e = errors(model, m, a[at : at + MATCHES], b[at : at + MATCHES])
        n += (e <= limit).sum(axis=1)
        cost += np.minimum(e, limit).sum(axis=1)
    return n, cost


def _inside(model: str, m: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    return np.concatenate([errors(model, m[None], a[at : at + MATCHES], b[at : at + MATCHES])[0] <= limit for at in range(0, len(a), MATCHES)])


def verify(source: int, target: int, a: np.ndarray, b: np.ndarray, size_a: tuple[float, float], size_b: tuple[float, float], pixels: float = 2.0, hypotheses: int = HYPOTHESES) -> tuple:
    """Best model of one pair: most inliers, least truncated cost, first hypothesis; refit on inliers if better; a homography only if it has more."""
    limit, rng = pixels * pixels, np.random.default_rng([source, target])
    best: dict[str, tuple] = {}
    for name, need, solve in (("fundamental", 8, fundamental), ("homography", 4, homography)):
        if len(a) < need:
            continue
        picks = np.argsort(rng.random((hypotheses, len(a))), axis=1)[:, :need] if len(a) < 64 else rng.integers(0, len(a), (hypotheses, need))
        found = (0, np.inf, None)
        for at in range(0, hypotheses, 250):
            m = solve(a[picks[at : at + 250]], b[picks[at : at + 250]])
            n, cost = _scored(name, m, a, b, limit)
            k = np.lexsort((np.arange(len(n)), cost, -n))[0]
            if (-n[k], cost[k]) < (-found[0], found[1]):
                found = (int(n[k]), float(cost[k]), m[k])
        if found[2] is not None and found[0] >= need:
            inside = _inside(name, found[2], a, b, limit)
            again = solve(a[inside][None], b[inside][None])
            (n,), (cost,) = _scored(name, again, a, b, limit)
            refit = (int(n), float(cost), again[0])
            found = refit if (-refit[0], refit[1]) < (-found[0], found[1]) else found
        best[name] = found
    name = "homography" if best.get("homography", (0,))[0] > best.get("fundamental", (0,))[0] else "fundamental"
    n, _, m = best.get(name, (0, 0, None))
    if m is None or not n:
        return "fundamental", 0, 0.0, 0.0, None, np.zeros(len(a), bool)
    inside = _inside(name, m, a, b, limit)
    cells = lambda p, w, h: len(np.unique(np.clip((p[:, 1] * 4 / h).astype(int), 0, 3) * 4 + np.clip((p[:, 0] * 4 / w).astype(int), 0, 3)))
    coverage = min(cells(a[inside], *size_a), cells(b[inside], *size_b)) / 16
    moved = np.sort(np.linalg.norm(a[inside] - b[inside], axis=1))[n // 2] / np.hypot(*size_a)
    return name, n, coverage, float(moved), m, inside


def verify_pairs(matches: DataFrame, size_a: tuple[float, float], size_b: tuple[float, float], pixels: float = 2.0, hypotheses: int = HYPOTHESES) -> DataFrame:
    """One row per pair of ``matches(source, target, au, av, bu, bv)``; a pair's matches are one task's, its errors are worked out in parts."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = int(pdf["source"].iloc[0]), int(pdf["target"].iloc[0])
        pdf = pdf.sort_values(["au", "av", "bu", "bv"])
        name, n, coverage, moved, m, _ = verify(s, t, pdf[["au", "av"]].to_numpy(), pdf[["bu", "bv"]].to_numpy(), size_a, size_b, pixels, hypotheses)
        return pd.DataFrame([(s, t, name, n, len(pdf), coverage, moved, None if m is None else m.ravel().tolist())], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return matches.select("source", "target", "au", "av", "bu", "bv").groupBy("source", "target").applyInPandas(one, _SCHEMA)
