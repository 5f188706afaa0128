"""Parameters of a covariance family by maximum likelihood, from the moments of the curves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from curvelake.frames import Curves
from curvelake.operators.stats import moments


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 400, tol: float = 1e-8) -> np.ndarray:
    """Downhill simplex for a few parameters."""
    n = len(start)
    points = np.vstack([start, start + 0.3 * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < tol * (abs(values[0]) + tol):
            break
        centre = points[:-1].mean(0)
        far = centre + (centre - points[-1])
        v = f(far)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = centre + 0.5 * ((far if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[values.argmin()]


def fit_covariance(curves: Curves, family: Callable[..., Callable], start: tuple[float, ...], noise: bool = True) -> tuple[tuple[float, ...], np.ndarray]:
    """(parameters, covariance matrix) of ``family(*parameters)``; parameters are positive, the last is the noise variance if fitted.

    One pass over the curves; the likelihood of every trial needs the summed products alone.
    """
    n, _, scatter = moments(curves)
    x = curves.meta.points
    first = np.log(np.array([*start, *([0.1 * max(start[0], 1e-6)] if noise else [])]))

    def matrix(p: np.ndarray) -> np.ndarray:
        q = np.exp(np.clip(p, -20, 20))
        return family(*(q[:-1] if noise else q))(x) + (q[-1] if noise else 1e-8) * np.eye(len(x))

    def loss(p: np.ndarray) -> float:
        try:
            low = np.linalg.cholesky(matrix(p))
        except np.linalg.LinAlgError:
            return 1e300
        half = np.linalg.solve(low, scatter)
        return 2 * np.log(np.diag(low)).sum() + np.trace(np.linalg.solve(low.T, half)) / n

    best = nelder_mead(loss, first)
    return tuple(np.exp(best).tolist()), matrix(best)
