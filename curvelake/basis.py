"""Families of basis functions: immutable driver objects with values, Gram matrices and penalties."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelake import numerics as nm


@dataclass(frozen=True)
class Basis:
    domain: tuple[float, float] = (0.0, 1.0)
    n_basis: int = 1

    def values(self, t: np.ndarray, derivative: int = 0) -> np.ndarray:
        """(len(t), n_basis)"""
        raise NotImplementedError

    def __call__(self, t, derivative: int = 0) -> np.ndarray:
        return self.values(np.atleast_1d(np.asarray(t, float)), derivative)

    def breaks(self) -> np.ndarray:
        """Points between which every function is smooth."""
        return np.linspace(*self.domain, 33)

    def _rule(self, other: Basis | None = None):
        return nm.gauss_legendre(np.unique(np.r_[self.breaks(), other.breaks()]) if other else self.breaks())

    def inner(self, other: Basis) -> np.ndarray:
        x, w = self._rule(other)
        return self(x).T @ (w[:, None] * other(x))

    def gram(self) -> np.ndarray:
        return self.inner(self)

    def integrals(self) -> np.ndarray:
        x, w = self._rule()
        return w @ self(x)

    def penalty(self, order: int = 2, weights=None) -> np.ndarray:
        """Inner products of L f, with L a derivative order or the weights of several orders."""
        x, w = self._rule()
        parts = [0.0] * order + [1.0] if weights is None else weights
        image = sum((p(x)[:, None] if callable(p) else p) * self(x, k) for k, p in enumerate(parts))
        return image.T @ (w[:, None] * image)

    def derivative(self, order: int = 1) -> tuple[Basis, np.ndarray]:
        """A basis of the derivatives and the matrix from old to new coefficients."""
        target = self._derivative_basis(order)
        x, w = self._rule(target)
        b = target(x)
        return target, np.linalg.pinv(b.T @ (w[:, None] * b)) @ (b.T @ (w[:, None] * self(x, order)))

    def _derivative_basis(self, order: int) -> Basis:
        return self

    def fit_matrix(self, points, smoothing: float = 0.0, order: int = 2, weights=None) -> np.ndarray:
        """(n_basis, n_points): least-squares coefficients from values, with a roughness penalty."""
        return nm.weighted_lstsq(self(points), np.eye(len(points)), weights, smoothing * self.penalty(order) if smoothing else None)

    def columns(self, t: Column) -> list[Column]:
        """The functions as column expressions."""
        raise NotImplementedError(f"{type(self).__name__} has no column form")

    def rescale(self, low: float, high: float) -> Basis:
        from dataclasses import replace

        return replace(self, domain=(low, high))


@dataclass(frozen=True)
class ConstantBasis(Basis):
    n_basis: int = field(default=1, init=False)

    def values(self, t, derivative=0):
        return np.full((len(t), 1), 0.0 if derivative else 1.0)

    def columns(self, t):
        return [F.lit(1.0)]


@dataclass(frozen=True)
class MonomialBasis(Basis):
    def values(self, t, derivative=0):
        out = np.zeros((len(t), self.n_basis))
        for k in range(derivative, self.n_basis):
            out[:, k] = math.perm(k, derivative) * t ** (k - derivative)
        return out

    def columns(self, t):
        out = [F.lit(1.0)]
        for _ in range(1, self.n_basis):
            out.append(out[-1] * t)
        return out

    def breaks(self):
        return np.array(self.domain)

    def _rule(self, other=None):
        return nm.gauss_legendre(np.unique(np.r_[self.breaks(), other.breaks()]) if other else self.breaks(), 2 * self.n_basis + 12)

    def _derivative_basis(self, order):
        return MonomialBasis(self.domain, max(1, self.n_basis - order))


@dataclass(frozen=True)
class FourierBasis(Basis):
    """Orthonormal constant, sine and cosine pairs; an even number of functions becomes the next odd one."""

    n_basis: int = 3
    period: float | None = None

    def __post_init__(self):
        if self.n_basis % 2 == 0:
            object.__setattr__(self, "n_basis", self.n_basis + 1)
        if self.period is None:
            object.__setattr__(self, "period", self.domain[1] - self.domain[0])

    def values(self, t, derivative=0):
        out = np.zeros((len(t), self.n_basis))
        out[:, 0] = 0 if derivative else 1 / math.sqrt(self.period)
        for k in range(1, self.n_basis // 2 + 1):
            w = 2 * math.pi * k / self.period
            angle = w * (t - self.domain[0]) + derivative * math.pi / 2
            out[:, 2 * k - 1] = w**derivative * np.sin(angle) * math.sqrt(2 / self.period)
            out[:, 2 * k] = w**derivative * np.cos(angle) * math.sqrt(2 / self.period)
        return out

    def columns(self, t):
        size = math.sqrt(2 / self.period)
        angle = (t - self.domain[0]) * (2 * math.pi / self.period)
        return [F.lit(1 / math.sqrt(self.period))] + [f(angle * k) * size for k in range(1, self.n_basis // 2 + 1) for f in (F.sin, F.cos)]


@dataclass(frozen=True)
class BSplineBasis(Basis):
    """Clamped B-splines of an order (degree + 1) on equal or given knots."""

    n_basis: int = 0
    order: int = 4
    knots: tuple[float, ...] = ()

    def __post_init__(self):
        if self.knots:
            object.__setattr__(self, "domain", (self.knots[0], self.knots[-1]))
            n = len(self.knots) + self.order - 2
            if self.n_basis not in (0, n):
                raise ValueError("the number of functions must be that of the knots plus the order minus two")
            object.__setattr__(self, "n_basis", n)
            return
        if self.n_basis < self.order:
            raise ValueError("a spline basis has at least as many functions as its order")
        object.__setattr__(self, "knots", tuple(np.linspace(*self.domain, self.n_basis - self.order + 2)))

    def values(self, t, derivative=0):
        if derivative >= self.order:
            return np.zeros((len(t), self.n_basis))
        ends = self.order - 1
        return nm.bspline_values(np.r_[[self.knots[0]] * ends, self.knots, [self.knots[-1]] * ends], self.order - 1, t, derivative)

    def breaks(self):
        return np.array(self.knots)

    def _derivative_basis(self, order):
        if order >= self.order:
            return ConstantBasis(self.domain)
        return BSplineBasis(self.domain, 0, self.order - order, self.knots)

    def rescale(self, low, high):
        a, b = self.domain
        return BSplineBasis((low, high), 0, self.order, tuple(low + (k - a) / (b - a) * (high - low) for k in self.knots))


@dataclass(frozen=True)
class CustomBasis(Basis):
    """Linearly independent functions given by values on a grid, joined by straight lines or splines."""

    points: tuple[float, ...] = ()
    rows: tuple[tuple[float, ...], ...] = ()
    degree: int = 1

    def __post_init__(self):
        values = np.array(self.rows)
        if np.linalg.matrix_rank(values) < len(values):
            raise ValueError("the functions of a basis must be linearly independent")
        object.__setattr__(self, "n_basis", len(values))
        object.__setattr__(self, "domain", (self.points[0], self.points[-1]))

    def values(self, t, derivative=0):
        x = np.array(self.points)
        v = np.array(self.rows).T
        for _ in range(derivative):
            v = nm.difference_matrix(x) @ v
        return nm.spline_matrix(x, t, self.degree) @ v

    def breaks(self):
        return np.array(self.points)


@dataclass(frozen=True)
class GridBasis(Basis):
    """One function a grid point, 1 there and 0 at the others, joined by straight lines: coefficients are values."""

    points: tuple[float, ...] = ()

    def __post_init__(self):
        if len(self.points) < 2 or any(b <= a for a, b in zip(self.points, self.points[1:])):
            raise ValueError("a grid basis needs two or more increasing points")
        object.__setattr__(self, "n_basis", len(self.points))
        object.__setattr__(self, "domain", (self.points[0], self.points[-1]))

    def values(self, t, derivative=0):
        x = np.array(self.points)
        v = np.eye(len(x))
        for _ in range(derivative):
            v = nm.difference_matrix(x) @ v
        return nm.linear_matrix(x, t) @ v

    def breaks(self):
        return np.array(self.points)


@dataclass(frozen=True)
class TensorBasis:
    """Products of one-argument bases, for surfaces; the last basis varies fastest."""

    bases: tuple[Basis, ...]

    @property
    def n_basis(self) -> int:
        return int(np.prod([b.n_basis for b in self.bases]))

    def __call__(self, points: np.ndarray, derivative: tuple[int, ...] | None = None) -> np.ndarray:
        points = np.asarray(points, float)
        out = np.ones((len(points), 1))
        for k, b in enumerate(self.bases):
            out = (out[:, :, None] * b(points[:, k], (derivative or (0,) * len(self.bases))[k])[:, None]).reshape(len(points), -1)
        return out

    def gram(self) -> np.ndarray:
        out = np.ones((1, 1))
        for b in self.bases:
            out = np.kron(out, b.gram())
        return out


@dataclass(frozen=True)
class VectorBasis:
    """Direct sum of bases, one for each coordinate."""

    bases: tuple[Basis, ...]

    @property
    def n_basis(self) -> int:
        return sum(b.n_basis for b in self.bases)

    def __call__(self, t) -> np.ndarray:
        """(len(t), n_basis, coordinates)"""
        t = np.atleast_1d(np.asarray(t, float))
        out, at = np.zeros((len(t), self.n_basis, len(self.bases))), 0
        for k, b in enumerate(self.bases):
            out[:, at : at + b.n_basis, k] = b(t)
            at += b.n_basis
        return out

    def gram(self) -> np.ndarray:
        out, at = np.zeros((self.n_basis, self.n_basis)), 0
        for b in self.bases:
            out[at : at + b.n_basis, at : at + b.n_basis] = b.gram()
            at += b.n_basis
        return out

    def coordinate(self, k: int) -> tuple[Basis, slice]:
        start = sum(b.n_basis for b in self.bases[:k])
        return self.bases[k], slice(start, start + self.bases[k].n_basis)


@dataclass(frozen=True)
class FiniteElementBasis:
    """Piecewise linear functions on a simplicial mesh, one for each vertex."""

    vertices: tuple[tuple[float, ...], ...]
    cells: tuple[tuple[int, ...], ...]

    @property
    def n_basis(self) -> int:
        return len(self.vertices)

    def __call__(self, points) -> np.ndarray:
        points, v = np.asarray(points, float), np.asarray(self.vertices, float)
        out, done = np.zeros((len(points), len(v))), np.zeros(len(points), bool)
        for cell in self.cells:
            corner = v[list(cell)]
            share = np.linalg.solve(np.vstack([corner.T, np.ones(len(cell))]), np.vstack([points.T, np.ones(len(points))])).T
            here = ~done & (share >= -1e-12).all(1)
            out[np.ix_(here, list(cell))] = share[here]
            done |= here
        return out
