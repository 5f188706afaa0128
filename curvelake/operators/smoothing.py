"""Linear smoothers: a hat matrix of the size of the grid, made on the driver, applied to every curve."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.basis import Basis
from curvelake.columns import apply_matrix
from curvelake.frames import BasisCurves, Curves
from curvelake.functions.kernels import ARRAYS


def _normalised(weights: np.ndarray) -> np.ndarray:
    total = weights.sum(1, keepdims=True)
    return np.divide(weights, total, out=np.zeros_like(weights), where=total != 0)


def _distances(x, t) -> np.ndarray:
    return np.abs(np.asarray(t, float)[:, None] - np.asarray(x, float)[None])


def default_bandwidth(x) -> float:
    """15th percentile of all pairwise distances, those of points to themselves included."""
    return float(np.percentile(_distances(x, x), 15))


@dataclass(frozen=True)
class NadarayaWatson:
    bandwidth: float | None = None
    kernel: str = "normal"
    weights: tuple[float, ...] | None = None

    def hat(self, x, t=None) -> np.ndarray:
        h = default_bandwidth(x) if self.bandwidth is None else self.bandwidth
        k = ARRAYS[self.kernel](_distances(x, x if t is None else t) / h)
        return _normalised(k if self.weights is None else k * np.asarray(self.weights))


@dataclass(frozen=True)
class LocalLinear:
    bandwidth: float | None = None
    kernel: str = "normal"
    weights: tuple[float, ...] | None = None

    def hat(self, x, t=None) -> np.ndarray:
        x, t = np.asarray(x, float), np.asarray(x if t is None else t, float)
        h = default_bandwidth(x) if self.bandwidth is None else self.bandwidth
        d = x[None] - t[:, None]
        k = ARRAYS[self.kernel](np.abs(d) / h)
        s1, s2 = (k * d).sum(1, keepdims=True), (k * d * d).sum(1, keepdims=True)
        b = k * (s2 - d * s1)
        return _normalised(b if self.weights is None else b * np.asarray(self.weights))


@dataclass(frozen=True)
class KNeighbours:
    n_neighbours: int | None = None
    kernel: str = "uniform"
    weights: tuple[float, ...] | None = None

    def hat(self, x, t=None) -> np.ndarray:
        d = _distances(x, x if t is None else t)
        n = self.n_neighbours
        if n is None:
            n = max(1, int(np.floor(np.percentile(range(1, len(np.asarray(x))), 5))))
        if n <= 0:
            raise ValueError("the number of neighbours must be positive")
        width = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
        tiny = np.finfo(float).eps
        k = ARRAYS[self.kernel](d / (width + tiny))
        return _normalised(k if self.weights is None else k * np.asarray(self.weights))


@dataclass(frozen=True)
class PenalisedBasis:
    basis: Basis
    smoothing: float = 1.0
    order: int = 2
    weights: tuple[float, ...] | None = None

    def coefficients(self, x) -> np.ndarray:
        return self.basis.fit_matrix(x, self.smoothing, self.order, None if self.weights is None else np.asarray(self.weights))

    def hat(self, x, t=None) -> np.ndarray:
        return self.basis(x if t is None else t) @ self.coefficients(x)


def smooth(curves: Curves, smoother, points=None) -> Curves:
    h = smoother.hat(curves.meta.points, points)
    meta = curves.meta if points is None else curves.meta.with_points(points)
    return Curves(apply_matrix(curves.df, h), meta)


def smooth_to_basis(curves: Curves, smoother: PenalisedBasis) -> BasisCurves:
    return BasisCurves(apply_matrix(curves.df, smoother.coefficients(curves.meta.points)).withColumnRenamed("data", "coef"), smoother.basis)


PENALTIES = {
    "gcv": lambda h: (1 - np.mean(np.diag(h))) ** -2.0,
    "akaike": lambda h: float(np.exp(2 * np.mean(np.diag(h)))),
    "finite_prediction_error": lambda h: float((1 + np.mean(np.diag(h))) / (1 - np.mean(np.diag(h)))),
    "shibata": lambda h: float(1 + 2 * np.mean(np.diag(h))),
    "rice": lambda h: float(1 / (1 - 2 * np.mean(np.diag(h)))),
}


def _residual_score(curves: Curves, h: np.ndarray) -> float:
    """Minus the mean squared residual over (1 - H_ii)."""
    scaled = (np.eye(len(h)) - h) / (1 - np.diag(h))[:, None]
    off = apply_matrix(curves.df.select("data"), scaled)
    return -off.select(F.explode("data").alias("e")).agg(F.avg(F.col("e") * F.col("e"))).first()[0]


def leave_one_out_score(curves: Curves, smoother) -> float:
    return _residual_score(curves, smoother.hat(curves.meta.points))


def gcv_score(curves: Curves, smoother, penalty: str = "gcv") -> float:
    """Minus the mean squared residual times a penalty of the hat matrix."""
    h = smoother.hat(curves.meta.points)
    off = apply_matrix(curves.df.select("data"), np.eye(len(h)) - h)
    return -off.select(F.explode("data").alias("e")).agg(F.avg(F.col("e") * F.col("e"))).first()[0] * PENALTIES[penalty](h)


def parameter_search(curves: Curves, smoothers: dict, score=gcv_score) -> tuple[object, dict]:
    """(best key, score by key); the moments of the curves are taken once, so one job serves all parameters."""
    from curvelake.operators.stats import moments

    n, mean, scatter = moments(curves)
    second = scatter / n + np.outer(mean, mean)
    out = {}
    for key, s in smoothers.items():
        h = s.hat(curves.meta.points)
        m = np.eye(len(h)) - h
        if score is leave_one_out_score:
            m, factor = m / (1 - np.diag(h))[:, None], 1.0
        else:
            factor = PENALTIES["gcv"](h)
        out[key] = -float(np.einsum("ij,jk,ik->", m, second, m)) / len(h) * factor
    return max(out, key=lambda k: out[k]), out


def hat_frame(spark, smoother, points) -> DataFrame:
    """``(i, j, weight)`` of a hat matrix."""
    h = smoother.hat(points)
    return spark.createDataFrame([(int(i), int(j), float(h[i, j])) for i in range(len(h)) for j in range(h.shape[1])], "i int, j int, weight double")
