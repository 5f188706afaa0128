"""Covariance functions over grid points: driver matrices of the size of a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def _columns(x) -> np.ndarray:
    x = np.asarray(x, float)
    return x[:, None] if x.ndim == 1 else x


def _distances(x, y) -> np.ndarray:
    x, y = _columns(x), _columns(y)
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


class Covariance:
    """k(x, y) for all pairs of rows."""

    def __call__(self, x, y=None) -> np.ndarray:
        return self.matrix(x, x if y is None else y)

    def matrix(self, x, y) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class Brownian(Covariance):
    variance: float = 1.0
    origin: float = 0.0

    def matrix(self, x, y):
        x, y = _columns(x) - self.origin, _columns(y) - self.origin
        norm = lambda a: np.sqrt((a * a).sum(1))
        return self.variance * (norm(x)[:, None] + norm(y)[None] - _distances(x, y)) / 2


@dataclass(frozen=True)
class Linear(Covariance):
    variance: float = 1.0
    intercept: float = 0.0

    def matrix(self, x, y):
        return self.variance * (_columns(x) @ _columns(y).T + self.intercept)


@dataclass(frozen=True)
class Polynomial(Covariance):
    variance: float = 1.0
    intercept: float = 0.0
    slope: float = 1.0
    degree: float = 2.0

    def matrix(self, x, y):
        return self.variance * (self.slope * _columns(x) @ _columns(y).T + self.intercept) ** self.degree


@dataclass(frozen=True)
class Gaussian(Covariance):
    variance: float = 1.0
    length_scale: float = 1.0

    def matrix(self, x, y):
        return self.variance * np.exp(-(_distances(x, y) ** 2) / (2 * self.length_scale**2))


@dataclass(frozen=True)
class Exponential(Covariance):
    variance: float = 1.0
    length_scale: float = 1.0

    def matrix(self, x, y):
        return self.variance * np.exp(-_distances(x, y) / self.length_scale)


@dataclass(frozen=True)
class WhiteNoise(Covariance):
    """Variance on the diagonal by index."""

    variance: float = 1.0

    def matrix(self, x, y):
        return self.variance * np.eye(len(_columns(x)), len(_columns(y)))


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the second kind, from its integral over cosh, by a fine trapezoid."""
    s = np.linspace(0, 12, 4001)
    with np.errstate(over="ignore"):
        f = np.exp(-np.asarray(x, float)[..., None] * np.cosh(s)) * np.cosh(nu * s)
    return ((f[..., 1:] + f[..., :-1]) / 2).sum(-1) * (s[1] - s[0])


@dataclass(frozen=True)
class Matern(Covariance):
    variance: float = 1.0
    length_scale: float = 1.0
    nu: float = 1.5

    def matrix(self, x, y):
        d = _distances(x, y) / self.length_scale
        if math.isinf(self.nu):
            return self.variance * np.exp(-d * d / 2)
        p = self.nu - 0.5
        if p == int(p) and p >= 0:
            p = int(p)
            z = math.sqrt(2 * self.nu) * d
            total = sum(math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i)) * (2 * z) ** (p - i) for i in range(p + 1))
            return self.variance * np.exp(-z) * math.factorial(p) / math.factorial(2 * p) * total
        z = np.where(d == 0, 1, math.sqrt(2 * self.nu) * d)
        value = 2 ** (1 - self.nu) / math.gamma(self.nu) * z**self.nu * bessel_k(self.nu, z)
        return self.variance * np.where(d == 0, 1, value)


@dataclass(frozen=True)
class Empirical(Covariance):
    """A sample covariance on a grid, evaluated bilinearly elsewhere."""

    points: tuple
    values: np.ndarray

    def matrix(self, x, y):
        from curvelake.numerics import linear_matrix

        return linear_matrix(self.points, x) @ self.values @ linear_matrix(self.points, y).T


@dataclass(frozen=True)
class EmpiricalBasis(Covariance):
    """The sample covariance of curves in a basis, from that of their coefficients: B(x) C B(y)'."""

    basis: object
    coefficients: np.ndarray

    def matrix(self, x, y):
        return self.basis(x) @ self.coefficients @ self.basis(y).T
