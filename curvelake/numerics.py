"""Small dense numerics for the driver: quadrature, differences, splines, bases, least squares.

Only numpy is used. Everything here has the size of a grid or a basis, never of the data.
"""

from __future__ import annotations

import math
import warnings

import numpy as np


class Unfinished(RuntimeWarning):
    """A loop ended at its bound of rounds before it converged."""


def report_unfinished(what: str, rounds: int, moved: float, tol: float) -> None:
    warnings.warn(f"{what} has not converged in {rounds} rounds: the last moved {moved:.3g}, the tolerance is {tol:.3g}", Unfinished, stacklevel=3)


def simpson_weights(x) -> np.ndarray:
    """Composite Simpson weights on a sorted grid; an even number of points corrects the last interval by a parabola."""
    x = np.asarray(x, float)
    n, w = len(x), np.zeros(len(x))
    if n < 2:
        return w
    if n == 2:
        return np.full(2, (x[1] - x[0]) / 2)
    h = np.diff(x)
    last = n - 1 if n % 2 else n - 2
    for i in range(0, last, 2):
        a, b = h[i], h[i + 1]
        s = a + b
        w[i] += s / 6 * (2 - b / a)
        w[i + 1] += s**3 / (6 * a * b)
        w[i + 2] += s / 6 * (2 - a / b)
    if n % 2 == 0:
        a, b = h[-2], h[-1]
        w[-1] += (2 * b * b + 3 * a * b) / (6 * (a + b))
        w[-2] += (b * b + 3 * a * b) / (6 * a)
        w[-3] -= b**3 / (6 * a * (a + b))
    return w


def tensor_weights(axes) -> np.ndarray:
    """Weights of the product rule, flattened row-major."""
    w = np.ones(1)
    for a in axes:
        w = np.outer(w, simpson_weights(a)).ravel()
    return w


def difference_weights(x, at: float, order: int) -> np.ndarray:
    """Weights of the derivative of the polynomial through the points x, at one place."""
    x = np.asarray(x, float) - at
    n = len(x)
    scale = np.abs(x).max() or 1.0
    vander = (x / scale)[None] ** np.arange(n)[:, None]
    right = np.zeros(n)
    right[order] = math.factorial(order) / scale**order
    return np.linalg.solve(vander, right)


def difference_matrix(x, order: int = 1) -> np.ndarray:
    """Second-order accurate finite differences on a grid that need not be uniform."""
    x = np.asarray(x, float)
    n = len(x)
    if order == 0:
        return np.eye(n)
    inner = 2 * ((order + 1) // 2) + 1
    edge = order + 2
    if n < max(inner, edge):
        raise ValueError(f"a derivative of order {order} needs at least {max(inner, edge)} points")
    m, half = np.zeros((n, n)), inner // 2
    for i in range(n):
        if half <= i < n - half:
            pick = range(i - half, i + half + 1)
        elif i < half:
            pick = range(0, edge)
        else:
            pick = range(n - edge, n)
        pick = list(pick)
        m[i, pick] = difference_weights(x[pick], x[i], order)
    return m


def interval_of(x, t) -> np.ndarray:
    """Index of the grid interval that holds, or is nearest to, each t."""
    return np.clip(np.searchsorted(x, t, side="right") - 1, 0, max(len(x) - 2, 0))


def linear_matrix(x, t) -> np.ndarray:
    """Rows that evaluate the broken line through the grid at each t (outer pieces are prolonged)."""
    x, t = np.asarray(x, float), np.asarray(t, float)
    m = np.zeros((len(t), len(x)))
    if len(x) == 1:
        m[:, 0] = 1
        return m
    k = interval_of(x, t)
    u = (t - x[k]) / (x[k + 1] - x[k])
    m[np.arange(len(t)), k] = 1 - u
    m[np.arange(len(t)), k + 1] += u
    return m


def bspline_values(knots, degree: int, t, derivative: int = 0) -> np.ndarray:
    """(len(t), n_basis) values of the B-splines on a full knot vector, by the Cox-de Boor recursion."""
    knots, t = np.asarray(knots, float), np.asarray(t, float)
    n = len(knots) - degree - 1
    if derivative:
        low = bspline_values(knots, degree - 1, t, derivative - 1) if degree else np.zeros((len(t), n + 1))
        out = np.zeros((len(t), n))
        if not degree:
            return out
        for i in range(n):
            a, b = knots[i + degree] - knots[i], knots[i + degree + 1] - knots[i + 1]
            if a > 0:
                out[:, i] += degree / a * low[:, i]
            if b > 0:
                out[:, i] -= degree / b * low[:, i + 1]
        return out
    spans = np.flatnonzero(np.diff(knots) > 0)
    k = spans[np.clip(np.searchsorted(knots[spans], t, side="right") - 1, 0, len(spans) - 1)]
    v = np.zeros((len(t), len(knots) - 1))
    v[np.arange(len(t)), k] = 1
    for d in range(1, degree + 1):
        new = np.zeros((len(t), len(knots) - 1 - d))
        for i in range(len(knots) - 1 - d):
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            if a > 0:
                new[:, i] += (t - knots[i]) / a * v[:, i]
            if b > 0:
                new[:, i] += (knots[i + d + 1] - t) / b * v[:, i + 1]
        v = new
    return v


def spline_matrix(x, t, degree: int) -> np.ndarray:
    """Rows that evaluate the interpolating spline of a degree at each t; odd degrees are not-a-knot."""
    x, t = np.asarray(x, float), np.asarray(t, float)
    if degree == 1:
        return linear_matrix(x, t)
    if len(x) <= degree:
        raise ValueError(f"degree {degree} needs more than {degree} points")
    if degree % 2:
        inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2]
    else:
        middle = (x[1:] + x[:-1]) / 2
        inner = middle[degree // 2 : len(middle) - degree // 2]
    knots = np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]
    return bspline_values(knots, degree, t) @ np.linalg.inv(bspline_values(knots, degree, x))


def pchip_slopes(x, y) -> np.ndarray:
    """Slopes of the monotone cubic through the columns of y (len(x), m)."""
    h, d = np.diff(x)[:, None], np.diff(y, axis=0) / np.diff(x)[:, None]
    if len(x) == 2:
        return np.repeat(d, 2, axis=0)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[1:] * d[:-1] > 0
    safe = np.where(same, d[:-1], 1), np.where(same, d[1:], 1)
    inner = np.where(same, (w1 + w2) / (w1 / safe[0] + w2 / safe[1]), 0)

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m = np.where(np.sign(m) != np.sign(d0), 0, m)
        return np.where((np.sign(d0) != np.sign(d1)) & (np.abs(m) > 3 * np.abs(d0)), 3 * d0, m)

    return np.vstack([end(h[0], h[1], d[0], d[1])[None], inner, end(h[-1], h[-2], d[-1], d[-2])[None]])


def pchip(x, y, t) -> np.ndarray:
    """Monotone cubic interpolation of y (len(x),) or (len(x), m) at t."""
    x, y, t = np.asarray(x, float), np.asarray(y, float), np.asarray(t, float)
    flat = y.ndim == 1
    y = y[:, None] if flat else y
    s, k = pchip_slopes(x, y), interval_of(x, t)
    h = (x[k + 1] - x[k])[:, None]
    u = (t - x[k])[:, None] / h
    out = (1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h * s[k] + u * u * (3 - 2 * u) * y[k + 1] + u * u * (u - 1) * h * s[k + 1]
    return out[:, 0] if flat else out


def gauss_legendre(spans, n: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the rule of n points on every span between sorted break points."""
    node, weight = np.polynomial.legendre.leggauss(n)
    a, b = np.asarray(spans[:-1], float)[:, None], np.asarray(spans[1:], float)[:, None]
    return ((b - a) / 2 * node + (a + b) / 2).ravel(), ((b - a) / 2 * weight).ravel()


def square_root(matrix) -> np.ndarray:
    """R with R'R = the matrix, symmetric and without negative eigenvalues beyond rounding."""
    value, vector = np.linalg.eigh(np.asarray(matrix, float))
    return np.sqrt(np.maximum(value, 0))[:, None] * vector.T


def weighted_lstsq(design, right, weights=None, penalty=None, method: str = "normal") -> np.ndarray:
    """Solution of (B'WB + P) c = B'W y; rank-deficient systems get the least-norm solution.

    ``method``: ``normal`` solves these equations; ``qr`` and ``svd`` decompose the stacked system of sqrt(W) B and
    sqrt(P) instead, which keeps twice the digits.
    """
    design, right = np.asarray(design, float), np.asarray(right, float)
    if method in ("qr", "svd"):
        if weights is not None:
            root = np.diag(np.sqrt(weights)) if np.ndim(weights) == 1 else square_root(weights)
            design, right = root @ design, root @ right
        if penalty is not None:
            design, right = np.vstack([design, square_root(penalty)]), np.concatenate([right, np.zeros((design.shape[1], *right.shape[1:]))])
        if method == "svd":
            return np.linalg.pinv(design) @ right
        q, r = np.linalg.qr(design)
        return np.linalg.solve(r, q.T @ right)
    left = design.T if weights is None else design.T @ (np.diag(weights) if np.ndim(weights) == 1 else weights)
    gram = left @ design if penalty is None else left @ design + penalty
    try:
        return np.linalg.solve(gram, left @ right)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(gram) @ left @ right


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Rows with their entry of largest magnitude positive, so that eigenvectors have one sign."""
    at = np.abs(rows).argmax(1)
    sign = np.sign(rows[np.arange(len(rows)), at])
    return rows * np.where(sign == 0, 1, sign)[:, None]
