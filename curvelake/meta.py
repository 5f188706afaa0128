"""Grids and domains: small immutable facts that the driver knows about a set of curves."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class GridMeta:
    """The grid that all curves of a set share.

    ``axes``: sorted grid points for each argument; ``domain``: (low, high) for each argument; values are
    flattened row-major over the axes, the coordinate (of ``codomain`` many) last.
    """

    axes: tuple[tuple[float, ...], ...]
    domain: tuple[tuple[float, float], ...] = ()
    codomain: int = 1
    argument_names: tuple[str, ...] = ()
    coordinate_names: tuple[str, ...] = ()
    extrapolation: str | float | None = None
    interpolation: int = field(default=1)

    def __post_init__(self) -> None:
        if not self.axes or any(len(a) == 0 for a in self.axes):
            raise ValueError("a grid needs at least one point on every axis")
        if any(b <= a for axis in self.axes for a, b in zip(axis, axis[1:])):
            raise ValueError("grid points must increase")
        if not self.domain:
            object.__setattr__(self, "domain", tuple((a[0], a[-1]) for a in self.axes))
        if len(self.domain) != len(self.axes):
            raise ValueError("one domain range is needed for each axis")
        for (low, high), axis in zip(self.domain, self.axes):
            if low > high or low > axis[0] or high < axis[-1]:
                raise ValueError("grid points must lie inside the domain")
        if self.codomain < 1:
            raise ValueError("the codomain has at least one dimension")

    @staticmethod
    def of(points, domain=None, codomain: int = 1, **names) -> GridMeta:
        """From one array of points, or a tuple of arrays for several arguments."""
        many = isinstance(points, (tuple, list)) and len(points) and np.ndim(points[0]) == 1
        axes = tuple(tuple(float(x) for x in a) for a in (points if many else [points]))
        if domain is not None and np.ndim(domain) == 1:
            domain = (tuple(domain),)
        return GridMeta(axes, tuple((float(a), float(b)) for a, b in domain) if domain is not None else (), codomain, **names)

    @staticmethod
    def regular(n: int, low: float = 0.0, high: float = 1.0) -> GridMeta:
        return GridMeta.of(np.linspace(low, high, n))

    @property
    def points(self) -> np.ndarray:
        """Grid points of a one-argument set."""
        if len(self.axes) != 1:
            raise ValueError("this operation takes functions of one argument")
        return np.array(self.axes[0])

    @property
    def size(self) -> int:
        return int(np.prod([len(a) for a in self.axes])) * self.codomain

    def with_points(self, points, **changes) -> GridMeta:
        return replace(self, axes=(tuple(float(x) for x in points),), **changes)
