"""Linear operators on gridded curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvelake.columns import apply_matrix, constant
from curvelake.frames import Curves
from curvelake.numerics import difference_matrix, simpson_weights


def matrix_operator(curves: Curves, matrix: np.ndarray, points=None) -> Curves:
    """A times the values of each curve."""
    meta = curves.meta
    if points is not None:
        low, high = meta.domain[0]
        meta = meta.with_points(points, domain=((min(low, points[0]), max(high, points[-1])),))
    return Curves(apply_matrix(curves.df, matrix), meta)


def identity_matrix(size: int) -> np.ndarray:
    """The matrix of the operator that leaves curves as they are."""
    return np.eye(size)


def differential_operator_matrix(points, weights) -> np.ndarray:
    """Sum of w_i(t) D^i on a grid; a weight is a number or a function of the points."""
    if not len(weights):
        raise ValueError("at least one weight is needed")
    x = np.asarray(points, float)
    value = lambda w: np.broadcast_to(w(x) if callable(w) else float(w), x.shape)
    return sum(value(w)[:, None] * difference_matrix(x, k) for k, w in enumerate(weights) if callable(w) or w != 0) + np.zeros((len(x), len(x)))


def differential_operator(curves: Curves, weights) -> Curves:
    return matrix_operator(curves, differential_operator_matrix(curves.meta.points, weights))


def grid_penalty(points, weights) -> np.ndarray:
    """The roughness penalty of a differential operator for values on a grid."""
    m = differential_operator_matrix(points, weights)
    return m.T @ (simpson_weights(points)[:, None] * m)


def integral_transform(curves: Curves, kernel, points) -> Curves:
    """(K f)(t) = integral of k(s, t) f(s) ds at the given points, by Simpson's rule."""
    s, t = curves.meta.points, np.asarray(points, float)
    return matrix_operator(curves, kernel(s[None], t[:, None]) * curves.weights()[None], t)


def slope_root_inverse(curves: Curves, start: float | str = 0.0) -> Curves:
    """f(a) + integral of q |q| by the cumulative trapezoid; ``start`` is a number or a column of the frame."""
    h = np.diff(curves.meta.points)
    g = F.transform("data", lambda q: q * F.abs(q))
    steps = F.zip_with(F.zip_with(F.slice("_g", 1, len(h)), F.slice("_g", 2, len(h)), lambda a, b: (a + b) / 2), constant(h), lambda a, w: a * w)
    first = F.col(start).cast("double") if isinstance(start, str) else F.lit(float(start))
    empty = F.array().cast("array<double>")
    run = F.aggregate(
        F.col("_s"), F.struct(first.alias("last"), F.concat(empty, F.array(first)).alias("seen")),
        lambda a, x: F.struct((a["last"] + x).alias("last"), F.concat(a["seen"], F.array(a["last"] + x)).alias("seen")), lambda a: a["seen"],
    )
    return curves.with_df(curves.df.withColumn("_g", g).withColumn("_s", steps).withColumn("data", run).drop("_g", "_s"))


def partial_derivative(curves: Curves, axis: int, order: int = 1) -> Curves:
    """Derivative of a surface along one argument."""
    sizes = [len(a) for a in curves.meta.axes] + [curves.meta.codomain]
    m = np.ones((1, 1))
    for k, n in enumerate(sizes):
        m = np.kron(m, difference_matrix(curves.meta.axes[k], order) if k == axis else np.eye(n))
    return curves.with_df(apply_matrix(curves.df, m))


def evaluate_surface(curves: Curves, points) -> Curves:
    """Multilinear values of a surface at points (one row each, an entry for each argument); clamped to the grid."""
    from curvelake.meta import GridMeta
    from curvelake.numerics import linear_matrix

    points = np.asarray(points, float)
    m = np.ones((len(points), 1))
    for k, axis in enumerate(curves.meta.axes):
        e = linear_matrix(axis, np.clip(points[:, k], axis[0], axis[-1]))
        m = (m[:, :, None] * e[:, None]).reshape(len(points), -1)
    return Curves(apply_matrix(curves.df, m), GridMeta.regular(len(points), 0.0, float(max(1, len(points) - 1))))
