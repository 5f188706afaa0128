"""Features of single curves: expressions of one row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant, dot, total
from curvelake.frames import Curves


def _sub_weights(curves: Curves, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights over the grid that integrate the broken line cut at low and high by Simpson's rule on the cut grid."""
    from curvelake.numerics import linear_matrix, simpson_weights

    x = curves.meta.points
    points = np.unique(np.r_[low, x[(x > low) & (x < high)], high])
    return simpson_weights(points) @ linear_matrix(x, points), points


def average_value(curves: Curves, function=None, domain: tuple[float, float] | None = None) -> DataFrame:
    """``(id, value)``: the mean over the domain of f, or of ``function`` (of a column) of f."""
    data = F.col("data") if function is None else F.transform("data", function)
    if domain is None:
        return curves.df.select("id", (dot(data, curves.weights()) / curves.length()).alias("value"))
    w, _ = _sub_weights(curves, *domain)
    return curves.df.select("id", (dot(data, w) / (domain[1] - domain[0])).alias("value"))


def moment(curves: Curves, n: int, domain: tuple[float, float] | None = None) -> DataFrame:
    return average_value(curves, lambda x: F.pow(x, F.lit(float(n))), domain)


def central_moment(curves: Curves, n: int) -> DataFrame:
    mean = dot(F.col("data"), curves.weights()) / curves.length()
    rows = curves.df.withColumn("_m", mean)
    data = F.transform("data", lambda x: F.pow(x - F.col("_m"), F.lit(float(n))))
    return rows.select("id", (dot(data, curves.weights()) / curves.length()).alias("value"))


def local_averages(curves: Curves, domains: int | list[tuple[float, float]]) -> DataFrame:
    """``(id, averages)``: mean value on each of several sub-domains, or on a number of equal ones."""
    low, high = curves.meta.domain[0]
    if isinstance(domains, int):
        edge = np.linspace(low, high, domains + 1)
        domains = list(zip(edge, edge[1:]))
    parts = [dot(F.col("data"), _sub_weights(curves, a, b)[0]) / (b - a) for a, b in domains]
    return curves.df.select("id", F.array(*parts).alias("averages"))


def occupation(curves: Curves, intervals: list[tuple[float, float]]) -> DataFrame:
    """``(id, occupation)``: the length of the domain whose right-end values lie in each closed interval."""
    if any(a > b for a, b in intervals):
        raise ValueError("the ends of an interval are in order")
    width = np.r_[0.0, np.diff(curves.meta.points)]
    inside = lambda a, b: lambda v, w: F.when((v >= a) & (v <= b), w).otherwise(0.0)
    parts = [total(F.zip_with("data", constant(width), inside(a, b))) for a, b in intervals]
    return curves.df.select("id", F.array(*parts).alias("occupation"))


def crossings(curves: Curves, level: float = 0.0, direction: str = "all") -> DataFrame:
    """``(id, crossings)``: sign changes about a level between neighbouring grid points.

    A point on the level counts with the side it goes on to: touching the level without passing is no crossing.
    """
    signs = F.filter(F.transform("data", lambda v: F.signum(v - level)), lambda s: s != 0)
    up, down = (lambda a, b: (a < 0) & (b > 0)), (lambda a, b: (a > 0) & (b < 0))
    test = {"all": lambda a, b: a != b, "up": up, "down": down}[direction]
    n = F.size("_s")
    pairs = F.zip_with(F.slice("_s", 1, F.greatest(n - 1, F.lit(0))), F.slice("_s", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: test(a, b).cast("int"))
    return curves.df.select("id", signs.alias("_s")).select("id", F.when(n > 1, F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).otherwise(0).alias("crossings"))


def values_at(curves: Curves, points=None) -> DataFrame:
    return (curves if points is None else curves.evaluate(points)).df.select("id", F.col("data").alias("values"))


def feature_union(*features: DataFrame) -> DataFrame:
    """Feature frames side by side, joined on id; array and scalar columns must have different names."""
    out = features[0]
    for f in features[1:]:
        out = out.join(f, "id")
    return out


def per_class(curves: Curves, label: str, build) -> DataFrame:
    """``build(curves of a class, all curves)`` for every class, joined on id; the class follows each column's name."""
    classes = [r[0] for r in curves.df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    frames = []
    for c in classes:
        made = build(curves.where(F.col(label) == F.lit(c)), curves)
        frames.append(made.select("id", *[F.col(x).alias(f"{x}_{c}") for x in made.columns if x != "id"]))
    return feature_union(*frames)


def local_maxima(column: Column, order: int = 1) -> Column:
    """Positions (from 0) that are not below any neighbour within ``order`` and not all equal to them."""
    n = F.size(column)

    def at(i):
        near = F.slice(column, F.greatest(F.lit(1), i + 1 - order), F.least(n, i + 1 + order) - F.greatest(F.lit(1), i + 1 - order) + 1)
        v = F.get(column, i)
        return F.forall(near, lambda x: x <= v) & F.exists(near, lambda x: x < v)

    return F.filter(F.sequence(F.lit(0), n - 1), at)
