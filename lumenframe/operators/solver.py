"""Bundle adjustment of one map: Levenberg-Marquardt with landmarks eliminated, on the driver.

A map's cameras are few (thousands at most), so the reduced camera system is dense and local; landmarks are
eliminated block by block. Whole-map residuals and point blocks over Spark tables are in ``mapping``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

from ..options import require
from .alignment import _rodrigues

NEAR = 1e-4


@dataclass
class Problem:
    """Cameras world-to-camera (n, 3, 3) and (n, 3), focals (n, 2), principals (n, 2), points (m, 3), observations (camera, point, u, v)."""

    rotations: np.ndarray
    translations: np.ndarray
    focals: np.ndarray
    principals: np.ndarray
    points: np.ndarray
    camera: np.ndarray
    point: np.ndarray
    pixels: np.ndarray

    def check(self) -> None:
        if len(self.rotations) < 3 or len(self.points) < 3:
            raise ValueError("at least three cameras and three points are required")
        if len(np.unique(np.c_[self.camera, self.point], axis=0)) != len(self.camera):
            raise ValueError("a camera sees a point twice")
        if np.bincount(self.point, minlength=len(self.points)).min() < 3 or np.bincount(self.camera, minlength=len(self.rotations)).min() < 6:
            raise ValueError("each point needs three views and each camera six observations")
        label = np.arange(len(self.rotations))
        while True:
            low = np.full(len(self.points), len(label))
            np.minimum.at(low, self.point, label[self.camera])
            new = label.copy()
            np.minimum.at(new, self.camera, low[self.point])
            if (new == label).all():
                break
            label = new
        if label.any():
            raise ValueError("cameras are not connected")


@dataclass
class Report:
    cost: list[float]
    rounds: int
    converged: bool
    weights: np.ndarray
    median: float
    within: int


class Priors(NamedTuple):
    """How far poses and cameras may stray from their input: deviations in radians, scene units and pixels."""

    rotation: float = 0.1
    translation: float = 0.1
    focal: float = 10.0
    principal: float = 2.0


class Adjuster:
    """State: pose increments on the right, points, logarithms of focals, principals. The first camera is fixed."""

    def __init__(self, problem: Problem, *, gnc: bool = True, iterations: int = 50, rounds: int = 64, pixels: float = 3.0, priors: Priors = Priors(), shared_calibration: bool = True, refine_principal: bool = False):
        require(1 <= iterations <= 1000 and rounds >= 1 and pixels > 0, "iterations must lie in [1, 1000], rounds and pixels be positive")
        problem.check()
        self.p, self.gnc, self.iterations, self.rounds, self.pixels, self.priors = problem, gnc, iterations, rounds, pixels, priors
        self.r, self.t, self.x = problem.rotations.copy(), problem.translations.copy(), problem.points.copy()
        self.log_f, self.c = np.log(problem.focals), problem.principals.copy()
        self.f0, self.c0, self.r0, self.t0 = problem.focals.copy(), problem.principals.copy(), problem.rotations.copy(), problem.translations.copy()
        self.n = len(self.r)
        self.shared = shared_calibration
        if self.shared:
            self.log_f = np.repeat(np.log(np.median(problem.focals, axis=0))[None], self.n, axis=0)
        self.k = 4 if refine_principal else 2
        self.weights = np.ones(len(problem.camera))
        if not np.isfinite(self.squared()).all():
            raise ValueError("an observation starts behind its camera")

    def _camera_points(self) -> np.ndarray:
        i = self.p.camera
        return np.einsum("nij,nj->ni", self.r[i], self.x[self.p.point]) + self.t[i]

    def squared(self) -> np.ndarray:
        """Squared pixel errors; infinite at or behind the near plane."""
        y = self._camera_points()
        z = np.maximum(y[:, 2], NEAR)
        i = self.p.camera
        e = np.exp(self.log_f[i]) * y[:, :2] / z[:, None] + self.c[i] - self.p.pixels
        s = (e**2).sum(axis=1)
        return np.where((y[:, 2] > NEAR) & np.isfinite(s), s, np.inf)

    def _priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of poses, focals and principals against their input, and the camera-parameter scale of each."""
        out = np.zeros((self.n, 6 + 4))
        for i in range(self.n):
            d = self.r0[i].T @ self.r[i]
            a = np.arccos(np.clip((np.trace(d) - 1) / 2, -1, 1))
            w = np.array([d[2, 1] - d[1, 2], d[0, 2] - d[2, 0], d[1, 0] - d[0, 1]]) * (0.5 if a < 1e-9 else a / (2 * np.sin(a)))
            out[i, :3] = w / self.priors.rotation
            out[i, 3:6] = self.r0[i].T @ (self.t[i] - self.t0[i]) / self.priors.translation
        out[:, 6:8] = (np.exp(self.log_f) - self.f0) / self.priors.focal
        out[:, 8:10] = (self.c - self.c0) / self.priors.principal
        return out, np.exp(self.log_f) / self.priors.focal

    def _objective(self, huber: bool) -> float:
        e, r, _, _, _ = self._rows(huber, False)
        prior, _ = self._priors()
        return float((r**2).sum() + (prior**2).sum()) if np.isfinite(e).all() else np.inf

    def _rows(self, huber: bool, jacobians: bool):
        i = self.p.camera
        y = self._camera_points()
        z = np.maximum(y[:, 2], NEAR)
        f = np.exp(self.log_f[i])
        raw = f * y[:, :2] / z[:, None] + self.c[i] - self.p.pixels
        length = np.linalg.norm(raw, axis=1)
        d = self.pixels
        q = d / np.maximum(length, 1e-12)
        h = np.where(length > d, np.sqrt(np.maximum(q * (2 - q), 0)), 1.0) if huber else np.ones(len(raw))
        w = (h * self.weights)[:, None]
        barrier = 1000 * np.minimum(y[:, 2] - NEAR, 0)
        r = np.c_[raw * w, barrier]
        if not jacobians:
            return raw, r, None, None, None
        ahead = (y[:, 2] > NEAR).astype(float)
        dy = np.zeros((len(raw), 3, 3))
        dy[:, 0, 0], dy[:, 1, 1] = f[:, 0] / z, f[:, 1] / z
        dy[:, 0, 2], dy[:, 1, 2] = -f[:, 0] * y[:, 0] / z**2 * ahead, -f[:, 1] * y[:, 1] / z**2 * ahead
        if huber:  # derivative of the factor along the residual
            far = length > d
            slope = np.where(far, (d * d / np.maximum(length, 1e-12) ** 3 - d / np.maximum(length, 1e-12) ** 2) / np.maximum(h, 1e-12) / np.maximum(length, 1e-12), 0)
            dh = slope[:, None, None] * (raw[:, :, None] * raw[:, None, :])
            turn = h[:, None, None] * np.eye(2) + dh
        else:
            turn = np.broadcast_to(np.eye(2), (len(raw), 2, 2))
        scale = turn * self.weights[:, None, None]
        dpix = dy[:, :2] * 1.0
        full = np.zeros((len(raw), 3, 3))
        full[:, :2] = scale @ dpix
        full[:, 2, 2] = 1000 * (y[:, 2] < NEAR)
        rot = self.r[i]
        point = full @ rot
        x = self.x[self.p.point]
        cross = np.zeros((len(raw), 3, 3))
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0], cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = -x[:, 2], x[:, 1], x[:, 2], -x[:, 0], -x[:, 1], x[:, 0]
        pose = np.concatenate([-point @ cross, point], axis=2)
        calibration = np.zeros((len(raw), 3, self.k))
        df = np.zeros((len(raw), 2, 2))
        df[:, 0, 0], df[:, 1, 1] = f[:, 0] * y[:, 0] / z, f[:, 1] * y[:, 1] / z
        calibration[:, :2, :2] = scale @ df
        if self.k == 4:
            calibration[:, :2, 2:] = scale
        return raw, r, pose, calibration, point

    def _column(self, i: np.ndarray) -> np.ndarray:
        return 6 * self.n + (0 if self.shared else self.k * i)

    def _step(self, damping: float, huber: bool):
        """The damped Gauss-Newton step through the reduced camera system."""
        _, r, pose, cal, point = self._rows(huber, True)
        i, j = self.p.camera, self.p.point
        size = 6 * self.n + (self.k if self.shared else self.k * self.n)
        wide = np.concatenate([pose, cal], axis=2)
        hcc, g = np.zeros((size, size)), np.zeros(size)
        columns = np.concatenate([6 * i[:, None] + np.arange(6), np.broadcast_to(np.asarray(self._column(i)).reshape(-1, 1), (len(i), 1)) + np.arange(self.k)], axis=1)
        blocks = np.swapaxes(wide, 1, 2) @ wide
        np.add.at(hcc, (columns[:, :, None], columns[:, None, :]), blocks)
        np.add.at(g, columns, np.einsum("nij,ni->nj", wide, r))
        hpp, gp = np.zeros((len(self.x), 3, 3)), np.zeros((len(self.x), 3))
        np.add.at(hpp, j, np.swapaxes(point, 1, 2) @ point)
        np.add.at(gp, j, np.einsum("nij,ni->nj", point, r))
        prior, focal = self._priors()
        for c in range(self.n):
            a = slice(6 * c, 6 * c + 6)
            sigma = np.array([1 / self.priors.rotation] * 3 + [1 / self.priors.translation] * 3)
            hcc[a, a] += np.diag(sigma**2)
            g[a] += sigma * prior[c, :6]
            b = np.arange(self.k) + (6 * self.n if self.shared else 6 * self.n + self.k * c)
            slope = np.r_[focal[c], np.full(2, 1 / self.priors.principal)][: self.k]
            hcc[b, b] += slope**2
            g[b] += slope * prior[c, 6 : 6 + self.k]
        hcc[np.diag_indices(size)] *= 1 + damping
        hpp[:, range(3), range(3)] = hpp[:, range(3), range(3)] * (1 + damping) + 1e-12
        inverse = np.linalg.inv(hpp)
        cross = np.zeros((len(self.x), size, 3)) if len(self.x) * size * 3 < 5e7 else None
        hcp = np.swapaxes(wide, 1, 2) @ point
        if cross is not None:
            np.add.at(cross, (j[:, None], columns), hcp)
            reduced = hcc - np.einsum("mai,mij,mbj->ab", cross, inverse, cross, optimize=True)
            rhs = g - np.einsum("mai,mij,mj->a", cross, inverse, gp, optimize=True)
        else:
            reduced, rhs = hcc, g.copy()
            order = np.argsort(j, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(j[order])) + 1):
                cols, inv = columns[rows], inverse[j[rows[0]]]
                e = hcp[rows].reshape(-1, 3)
                flat = cols.ravel()
                np.subtract.at(reduced, (flat[:, None], flat[None, :]), e @ inv @ e.T)
                np.subtract.at(rhs, flat, e @ inv @ gp[j[rows[0]]])
        free = np.arange(6, size)  # the first camera stays
        step = np.zeros(size)
        step[free] = -np.linalg.solve(reduced[np.ix_(free, free)], rhs[free])
        back = gp.copy()
        np.add.at(back, j, np.einsum("nai,na->ni", hcp, step[columns]))
        return step, -np.einsum("mij,mj->mi", inverse, back)

    def _apply(self, step: np.ndarray, move: np.ndarray) -> None:
        for c in range(self.n):
            d = step[6 * c : 6 * c + 6]
            self.t[c] = self.t[c] + self.r[c] @ d[3:]
            self.r[c] = self.r[c] @ _rodrigues(d[:3])
        self.x = self.x + move
        tail = step[6 * self.n :].reshape(-1, self.k)
        self.log_f = self.log_f + (tail[:, :2] if not self.shared else tail[:1, :2])
        if self.k == 4:
            self.c = self.c + tail[:, 2:]

    def minimize(self, iterations: int, huber: bool) -> tuple[list[float], bool]:
        """Costs never rise: a step that would is taken back and damped more."""
        damping, cost = 1e-4, self._objective(huber)
        costs = [cost]
        for _ in range(iterations):
            held = (self.r.copy(), self.t.copy(), self.x.copy(), self.log_f.copy(), self.c.copy())
            try:
                self._apply(*self._step(damping, huber))
                new = self._objective(huber)
            except np.linalg.LinAlgError:
                new = np.inf
            if new <= cost:
                done = cost - new <= 1e-9 * max(1.0, cost)
                damping, cost = max(damping / 5, 1e-10), new
                costs.append(cost)
                if done:
                    return costs, True
            else:
                self.r, self.t, self.x, self.log_f, self.c = held
                damping *= 5
                if damping > 1e8:
                    return costs, True
        return costs, False

    def solve(self) -> Report:
        """Graduated non-convexity of truncated least squares, or one Huber run."""
        c2 = self.pixels**2
        costs: list[float] = []
        if not self.gnc:
            costs, done = self.minimize(self.iterations, True)
            rounds = 1
        else:
            e = self.squared()
            mu = max(1e-6, c2 / max(c2, 2 * e.max() - c2))
            previous, done, rounds = np.inf, False, 0
            for rounds in range(1, self.rounds + 1):
                e = self.squared()
                root = np.sqrt(np.where(e <= mu / (mu + 1) * c2, 1.0, np.where(e >= (mu + 1) / mu * c2, 0.0, np.sqrt(c2 * mu * (mu + 1) / np.maximum(e, 1e-300)) - mu)))
                active = np.bincount(self.p.point, weights=root > 0.01, minlength=len(self.x)) >= 3
                self.weights = np.where(active[self.p.point], root, 0.0)
                made, _ = self.minimize(self.iterations, False)
                costs += made
                e = self.squared()
                now = float(np.minimum(e, c2).sum())
                soft = ((root > 0.01) & (root < 0.99)).any()
                if mu >= 1 and not soft and abs(previous - now) <= 1e-5 * max(1.0, previous):
                    done = True
                    break
                previous, mu = now, min(1.6 * mu, 1e6)
        e = self.squared()
        return Report(costs, rounds, done, self.weights, float(np.sort(np.sqrt(e))[len(e) // 2]), int((e <= c2).sum()))


def finite_difference_error(adjuster: Adjuster, huber: bool = True, step: float = 1e-6) -> float:
    """Largest gap between the analytic and the numeric derivative of residuals by points, relative to its size."""
    _, _, _, _, point = adjuster._rows(huber, True)
    worst = 0.0
    for axis in range(3):
        held = adjuster.x.copy()
        adjuster.x = held + step * np.eye(3)[axis]
        up = adjuster._rows(huber, False)[1]
        adjuster.x = held - step * np.eye(3)[axis]
        down = adjuster._rows(huber, False)[1]
        adjuster.x = held
        numeric = (up - down) / (2 * step)
        worst = max(worst, float(np.abs(numeric - point[:, :, axis]).max() / max(1.0, np.abs(point).max())))
    return worst
