"""Sets of functions as DataFrames: on a shared grid, at irregular points, or in a basis.

The wrappers hold a DataFrame and what the driver knows about it; they are lazy, and every method
returns a new one. Missing cells are null (NaN is turned into null when a set is made).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake import numerics as nm
from curvelake.basis import Basis
from curvelake.columns import apply_matrix, constant, dot, pairwise, stencil, total
from curvelake.meta import GridMeta


def _clean(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def _every(d: int, k: int):
    return lambda x, i: i % d == k


@dataclass(frozen=True)
class Curves:
    """``df``: ``id, data array<double>`` and any scalar columns; ``meta``: the shared grid."""

    df: DataFrame
    meta: GridMeta

    # -- construction -------------------------------------------------------------------------
    @staticmethod
    def from_arrays(df: DataFrame, id_column: str, data_column: str, meta: GridMeta, *carry: str) -> Curves:
        """Rows with a null id or array, or an array of another length than the grid, are left out."""
        data = F.transform(F.col(data_column).cast("array<double>"), _clean)
        rows = df.select(F.col(id_column).alias("id"), data.alias("data"), *carry).where(f"id is not null and size(data) = {meta.size}")
        return Curves(rows, meta)

    @staticmethod
    def from_long(df: DataFrame, meta: GridMeta, id_column: str = "id", pos_column: str = "pos", value_column: str = "v") -> Curves:
        """From one row a cell; cells that are not there are missing, of repeated cells the first in order counts."""
        rows = df.select(F.col(id_column).alias("id"), F.col(pos_column).cast("int").alias("pos"), _clean(F.col(value_column).cast("double")).alias("v")).where(f"id is not null and pos between 0 and {meta.size - 1}")
        grouped = rows.groupBy("id").agg(F.collect_list(F.struct("pos", "v")).alias("cells"))
        cells = F.map_from_entries(F.transform(F.filter(F.array_sort("cells"), lambda c, i: (i == 0) | (F.get(F.array_sort("cells"), i - 1)["pos"] != c["pos"])), lambda c: c))
        grouped = grouped.select("id", cells.alias("cells"))
        return Curves(grouped.select("id", F.transform(F.sequence(F.lit(0), F.lit(meta.size - 1)), lambda p: F.try_element_at("cells", p)).alias("data")), meta)

    @staticmethod
    def from_literals(spark: SparkSession, rows, meta: GridMeta) -> Curves:
        return Curves(spark.createDataFrame([(i, [None if v is None or v != v else float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, data array<double>"), meta)

    def with_df(self, df: DataFrame, **changes) -> Curves:
        return Curves(df, replace(self.meta, **changes) if changes else self.meta)

    def map(self, f) -> Curves:
        """Pointwise function of the values, as a column function."""
        return self.with_df(self.df.withColumn("data", F.transform("data", f)))

    def long(self, *carry: str) -> DataFrame:
        """``(id, pos, v, *carry)``: one row a cell."""
        return self.df.select("id", *carry, F.posexplode("data").alias("pos", "v"))

    # -- slicing ------------------------------------------------------------------------------
    def where(self, condition) -> Curves:
        return self.with_df(self.df.where(condition))

    def take(self, indices: DataFrame, column: str = "id") -> Curves:
        """The curves of ``indices``, in as many copies as there are rows; ids without a curve give a missing one."""
        asked = indices.select(F.col(column).alias("id"))
        return self.with_df(asked.join(self.df, "id", "left").withColumn("data", F.coalesce("data", F.array(*[F.lit(None).cast("double")] * self.meta.size))))

    def restrict(self, low: float, high: float, with_bounds: bool = False) -> Curves:
        """Cells whose grid point lies in [low, high]; ``with_bounds`` adds interpolated values at both ends."""
        x = self.meta.points
        if with_bounds:
            points = np.unique(np.r_[low, x[(x >= low) & (x <= high)], high])
            return Curves(self.evaluate(points).df, self.meta.with_points(points, domain=((low, high),)))
        keep = np.flatnonzero((x >= low) & (x <= high))
        if not len(keep):
            raise ValueError("no grid point lies in the restricted domain")
        d = self.meta.codomain
        return Curves(self.df.withColumn("data", F.slice("data", int(keep[0]) * d + 1, len(keep) * d)), self.meta.with_points(x[keep], domain=((low, high),)))

    def concatenate(self, *others: Curves) -> Curves:
        for o in others:
            self._same_grid(o)
        return self.with_df(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o.df for o in others], self.df))

    def stack_coordinates(self, other: Curves) -> Curves:
        """Coordinates of both sets side by side, joined on id."""
        if self.meta.axes != other.meta.axes:
            raise ValueError("sets on different grids cannot be stacked")
        a, b, n = self.meta.codomain, other.meta.codomain, self.meta.size // self.meta.codomain
        both = self.df.join(other.df.select("id", F.col("data").alias("_other")), "id")
        parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.slice("data", i * a + 1, F.lit(a)), F.slice("_other", i * b + 1, F.lit(b)))))
        return Curves(both.withColumn("data", parts).drop("_other"), replace(self.meta, codomain=a + b))

    def coordinate(self, k: int) -> Curves:
        d = self.meta.codomain
        if not 0 <= k < d:
            raise IndexError("no such coordinate")
        return Curves(self.df.withColumn("data", F.filter("data", lambda x, i: i % d == k)), replace(self.meta, codomain=1))

    def _same_grid(self, other: Curves) -> None:
        if self.meta.axes != other.meta.axes or self.meta.codomain != other.meta.codomain:
            raise ValueError("the sets have different grids")

    # -- comparison ---------------------------------------------------------------------------
    def isna(self) -> DataFrame:
        """``(id, missing)``: whether no cell of the curve has a value."""
        return self.df.select("id", F.forall("data", lambda x: x.isNull()).alias("missing"))

    def same_as(self, other: Curves) -> DataFrame:
        """``(id, equal)`` for each id in both sets; missing cells equal nothing."""
        self._same_grid(other)
        both = self.df.select("id", "data").join(other.df.select("id", F.col("data").alias("o")), "id")
        return both.select("id", F.forall(F.zip_with("data", "o", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x).alias("equal"))

    def equals(self, other: Curves) -> bool:
        """Same grid and the same ids with the same values (missing equals missing)."""
        if self.meta != other.meta:
            return False
        a, b = self.df.select("id", "data"), other.df.select("id", "data")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    # -- arithmetic ---------------------------------------------------------------------------
    def _combine(self, other, f) -> Curves:
        """With a number, a column of this set's frame (one value a curve), or a set on the same grid."""
        if isinstance(other, Curves):
            self._same_grid(other)
            both = self.df.join(other.df.select("id", F.col("data").alias("_other")), "id")
            return self.with_df(both.withColumn("data", pairwise(F.col("data"), F.col("_other"), f)).drop("_other"))
        value = other if isinstance(other, Column) else F.lit(float(other))
        return self.map(lambda x: f(x, value))

    def __add__(self, other):
        return self._combine(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._combine(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._combine(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._combine(other, F.try_divide)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return self._combine(other, lambda a, b: b - a)

    def __rtruediv__(self, other):
        return self._combine(other, lambda a, b: F.try_divide(b, a))

    def __neg__(self):
        return self.map(lambda x: -x)

    def round(self, decimals: int = 0) -> Curves:
        """Half to even, on the values."""
        return self.map(lambda x: F.bround(x, decimals))

    def sqrt(self):
        return self.map(lambda x: F.when(x >= 0, F.sqrt(x)))

    def absolute(self):
        return self.map(F.abs)

    def exp(self):
        return self.map(F.exp)

    def log(self):
        return self.map(F.ln)

    def log10(self):
        return self.map(F.log10)

    def log2(self):
        return self.map(F.log2)

    # -- evaluation ---------------------------------------------------------------------------
    def evaluate(self, points, extrapolation: str | float | None = None, degree: int | None = None) -> Curves:
        """Values at shared points: splines of a degree, with an extrapolation outside the domain.

        ``extrapolation``: None (the spline goes on), ``periodic``, ``bounds``, ``zeros``, ``nan``, ``exception``, or
        a number to fill with. One-argument sets of any number of coordinates; for several arguments see
        ``evaluate_grid``.
        """
        t = np.asarray(points, float)
        (low, high), x = self.meta.domain[0], self.meta.points
        outside = (t < low) | (t > high)
        extrapolation = self.meta.extrapolation if extrapolation is None else extrapolation
        if extrapolation == "exception" and outside.any():
            raise ValueError("points outside the domain")
        if extrapolation == "periodic":
            t_in = np.where(outside, low + np.mod(t - low, high - low), t)
        elif extrapolation == "bounds":
            t_in = np.clip(t, low, high)
        else:
            t_in = t
        d = self.meta.codomain
        out = apply_matrix(self.df, np.kron(nm.spline_matrix(x, t_in, degree or self.meta.interpolation), np.eye(d)))
        fill = {"zeros": 0.0, "nan": None}.get(extrapolation, extrapolation) if extrapolation in ("zeros", "nan") or isinstance(extrapolation, (int, float)) else ...
        if fill is not ... and outside.any():
            flags = F.array(*[F.lit(bool(o)) for o in np.repeat(outside, d)])
            out = out.withColumn("data", F.zip_with("data", flags, lambda v, o: F.when(o, F.lit(fill).cast("double")).otherwise(v)))
        order = np.argsort(t, kind="stable")
        if len(np.unique(t)) == len(t) and (order == np.arange(len(t))).all():
            return Curves(out, self.meta.with_points(t, domain=((min(low, t[0]), max(high, t[-1])),)))
        return Curves(out, replace(GridMeta.regular(len(t), 0.0, float(max(1, len(t) - 1))), codomain=d))

    to_grid = evaluate

    def evaluate_grid(self, axes, extrapolation: str | None = None, degree: int | tuple[int, ...] | None = None) -> Curves:
        """Tensor splines of sets of one or more arguments on the product of new ``axes``, an array of points for each argument.

        ``degree`` may differ by argument. ``extrapolation``: None (the spline goes on), ``periodic`` or ``bounds``.
        """
        if len(axes) != len(self.meta.axes):
            raise ValueError("one array of points is needed for each argument")
        degrees = degree if isinstance(degree, tuple) else (degree or self.meta.interpolation,) * len(axes)
        m = np.ones((1, 1))
        for old, new, (low, high), k in zip(self.meta.axes, axes, self.meta.domain, degrees):
            t = np.asarray(new, float)
            t = low + np.mod(t - low, high - low) if extrapolation == "periodic" else np.clip(t, low, high) if extrapolation == "bounds" else t
            m = np.kron(m, nm.spline_matrix(np.array(old), t, k))
        meta = GridMeta.of(tuple(np.asarray(a, float) for a in axes), tuple((min(lo, float(np.min(a))), max(hi, float(np.max(a)))) for (lo, hi), a in zip(self.meta.domain, axes)), self.meta.codomain)
        return Curves(apply_matrix(self.df, np.kron(m, np.eye(self.meta.codomain))), meta)

    def evaluate_each(self, at: str, out: str = "value", extrapolation: str | None = None) -> DataFrame:
        """The frame with ``out``: linear values of each curve at its own points, an ``array<double>`` column ``at``."""
        (low, high), x = self.meta.domain[0], self.meta.points
        points = F.array(*[F.lit(float(v)) for v in x])

        def value(t: Column) -> Column:
            inside = F.when(F.lit(extrapolation == "periodic") & ((t < low) | (t > high)), low + F.pmod(t - low, F.lit(high - low))) if extrapolation == "periodic" else F.least(F.greatest(t, F.lit(low)), F.lit(high)) if extrapolation == "bounds" else t
            inside = F.coalesce(inside, t)
            k = F.greatest(F.lit(0), F.least(F.lit(len(x) - 2), F.size(F.filter(points, lambda p: p <= inside)) - 1))
            a, b = F.get(points, k), F.get(points, k + 1)
            return F.get(F.col("data"), k) + (F.get(F.col("data"), k + 1) - F.get(F.col("data"), k)) * (inside - a) / (b - a)

        return self.df.withColumn(out, F.transform(at, value))

    def shift(self, delta: float | Column, extrapolation: str | None = None) -> Curves:
        """f(t + delta) on the same grid; ``delta`` may be a column of the frame."""
        if not isinstance(delta, Column):
            return Curves(self.evaluate(self.meta.points + delta, extrapolation).df, self.meta)
        grid = constant(self.meta.points)
        rows = self.with_df(self.df.withColumn("_at", F.transform(grid, lambda t: t + delta)))
        return self.with_df(rows.evaluate_each("_at", "data", extrapolation).drop("_at"))

    def shift_restricted(self, delta: Column, least: float, most: float) -> Curves:
        """As ``shift``, cut to the points that stay in the domain for every delta in [least, most]."""
        low, high = self.meta.domain[0]
        return self.shift(delta).restrict(low - min(least, 0.0), high - max(most, 0.0))

    def compose(self, inner: Curves) -> Curves:
        """f(g(t)) for each id, g on its own grid."""
        both = self.df.join(inner.df.select("id", F.col("data").alias("_at")), "id")
        return Curves(self.with_df(both).evaluate_each("_at", "data").drop("_at"), inner.meta)

    # -- calculus -----------------------------------------------------------------------------
    def derivative(self, order: int = 1) -> Curves:
        return self.with_df(apply_matrix(self.df, nm.difference_matrix(self.meta.points, order)))

    def weights(self) -> np.ndarray:
        return np.repeat(nm.tensor_weights(self.meta.axes), 1)

    def integrate(self) -> DataFrame:
        """``(id, integral)`` by Simpson's rule over all arguments; an array for several coordinates."""
        w = self.weights()
        if self.meta.codomain == 1:
            return self.df.select("id", dot(F.col("data"), w).alias("integral"))
        d = self.meta.codomain
        parts = [total(F.zip_with(F.filter("data", _every(d, k)), constant(w), lambda x, y: x * y)) for k in range(d)]
        return self.df.select("id", F.array(*parts).alias("integral"))

    def length(self) -> float:
        return float(np.prod([b - a for a, b in self.meta.domain]))

    # -- other encodings ----------------------------------------------------------------------
    def to_irregular(self) -> Irregular:
        points = constant(self.meta.points)
        return Irregular(self.long().where("v is not null").select("id", F.get(points, F.col("pos")).alias("t"), "v"), self.meta.domain[0])

    def to_basis(self, basis: Basis, smoothing: float = 0.0, order: int = 2) -> BasisCurves:
        """Least squares on a basis, with an optional roughness penalty."""
        return BasisCurves(apply_matrix(self.df, basis.fit_matrix(self.meta.points, smoothing, order)).withColumnRenamed("data", "coef"), basis)


@dataclass(frozen=True)
class Irregular:
    """``df``: ``id, t, v``, one row a measurement; ``domain`` may be None for the hull of the points."""

    df: DataFrame
    domain: tuple[float, float] | None = None

    @staticmethod
    def from_frame(df: DataFrame, id_column: str, argument: str, value: str) -> Irregular:
        """Rows with a null id or argument are left out; null and NaN values stay as missing."""
        rows = df.select(F.col(id_column).alias("id"), F.col(argument).cast("double").alias("t"), _clean(F.col(value).cast("double")).alias("v"))
        return Irregular(rows.where("id is not null and t is not null"))

    def restrict(self, low: float, high: float) -> Irregular:
        return Irregular(self.df.where(F.col("t").between(low, high)), (low, high))

    def round(self, decimals: int = 0) -> Irregular:
        return Irregular(self.df.withColumn("v", F.bround("v", decimals)), self.domain)

    def map(self, f) -> Irregular:
        return Irregular(self.df.withColumn("v", f(F.col("v"))), self.domain)

    def concatenate(self, other: Irregular) -> Irregular:
        return Irregular(self.df.unionByName(other.df, allowMissingColumns=True))

    def combine(self, other: Irregular, f) -> Irregular:
        """Pointwise on measurements of the same id and point."""
        both = self.df.join(other.df.select("id", "t", F.col("v").alias("_o")), ["id", "t"])
        return Irregular(both.withColumn("v", f(F.col("v"), F.col("_o"))).drop("_o"), self.domain)

    def _with(self, other, f) -> Irregular:
        """With a number or a column of the frame, or with another set at the same ids and points."""
        if isinstance(other, Irregular):
            return self.combine(other, f)
        value = other if isinstance(other, Column) else F.lit(float(other))
        return self.map(lambda v: f(v, value))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._with(other, F.try_divide)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return self._with(other, lambda a, b: b - a)

    def __rtruediv__(self, other):
        return self._with(other, lambda a, b: F.try_divide(b, a))

    def __neg__(self):
        return self.map(lambda v: -v)

    def ranges(self) -> DataFrame:
        """``(id, low, high)``: first and last point of each curve."""
        return self.df.groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high"))

    def hull(self) -> tuple[float, float]:
        r = self.df.agg(F.min("t"), F.max("t")).first()
        return r[0], r[1]

    def isna(self) -> DataFrame:
        return self.df.groupBy("id").agg((F.count("v") == 0).alias("missing"))

    def common_points(self, statistic) -> DataFrame:
        """``(t, value)``: a statistic of ``v`` at the points that all curves share."""
        n = self.df.agg(F.count_distinct("id").alias("n"))
        by = self.df.groupBy("t").agg(F.count_distinct("id").alias("m"), statistic(F.col("v")).alias("value"))
        return by.join(F.broadcast(n), F.col("m") == F.col("n")).select("t", "value")

    def sum(self) -> DataFrame:
        return self.common_points(F.sum)

    def mean(self) -> DataFrame:
        return self.common_points(F.avg)

    def var(self, correction: int = 0) -> DataFrame:
        return self.common_points(F.var_samp if correction else F.var_pop)

    def to_curves(self, most_points: int = 10_000) -> Curves:
        """On the grid of all points that occur, missing where a curve has no measurement; of repeated points the smallest value counts.

        The grid is known to the driver, so more than ``most_points`` points are refused.
        """
        points = sorted(r["t"] for r in self.df.select("t").distinct().limit(most_points + 1).collect())
        if len(points) > most_points:
            raise ValueError(f"a grid of more than {most_points} points; evaluate at chosen points instead")
        meta = GridMeta.of(points, self.domain)
        at = F.broadcast(self.df.sparkSession.createDataFrame([(k, t) for k, t in enumerate(points)], "pos int, t double"))
        cells = self.df.join(at, "t").groupBy("id", "pos").agg(F.min("v").alias("v"))
        return Curves.from_long(cells, meta)

    def to_grid(self) -> DataFrame:
        """``(id, t, v)``: every id at every point that occurs, missing where it has no measurement."""
        curves = self.to_curves()
        return curves.long().select("id", F.get(constant(curves.meta.points), F.col("pos")).alias("t"), "v")

    def shift(self, delta: float | Column) -> Irregular:
        """f(t + delta): every point moves by -delta; ``delta`` may be a column of the frame."""
        return Irregular(self.df.withColumn("t", F.col("t") - (delta if isinstance(delta, Column) else F.lit(float(delta)))))

    def compose(self, inverse: Callable[[Column], Column]) -> Irregular:
        """f(g(t)) for a monotone g: points move to where g takes them from, which ``inverse`` gives as a column function."""
        return Irregular(self.df.withColumn("t", inverse(F.col("t"))))

    def where(self, condition) -> Irregular:
        return Irregular(self.df.where(condition), self.domain)

    def trapezoid(self) -> DataFrame:
        """``(id, integral)`` of the broken line through each curve's own points."""
        w = Window.partitionBy("id").orderBy("t")
        area = (F.lead("t").over(w) - F.col("t")) * (F.lead("v").over(w) + F.col("v")) / 2
        return self.df.withColumn("area", area).groupBy("id").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("integral"))

    def integrate(self) -> DataFrame:
        """``(id, integral)`` by Simpson's rule on each curve's own points, with three-point windows.

        For an even number of points the last interval is corrected by the parabola through the last three.
        """
        w = Window.partitionBy("id").orderBy("t")
        whole = Window.partitionBy("id")
        r = self.df.select("id", "t", "v", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
        for j in (1, 2):
            r = r.withColumn(f"t{j}", F.lead("t", j).over(w)).withColumn(f"v{j}", F.lead("v", j).over(w))
        a, b = F.col("t1") - F.col("t"), F.col("t2") - F.col("t1")
        s = a + b
        pair = s / 6 * (F.col("v") * (2 - F.try_divide(b, a)) + F.col("v1") * F.try_divide(s * s, a * b) + F.col("v2") * (2 - F.try_divide(a, b)))
        last = F.col("v2") * F.try_divide(2 * b * b + 3 * a * b, 6 * s) + F.col("v1") * F.try_divide(b * b + 3 * a * b, 6 * a) - F.col("v") * F.try_divide(F.pow(b, F.lit(3)), 6 * a * s)
        odd = F.col("n") % 2 == 1
        part = (
            F.when((F.col("n") == 2) & (F.col("k") == 0), a * (F.col("v") + F.col("v1")) / 2)
            .when(F.col("n") < 3, 0.0)
            .otherwise(F.when((F.col("k") % 2 == 0) & (F.col("k") + 2 < F.when(odd, F.col("n")).otherwise(F.col("n") - 1)), pair).otherwise(0.0) + F.when(~odd & (F.col("k") == F.col("n") - 3), last).otherwise(0.0))
        )
        return r.withColumn("part", part).groupBy("id").agg(F.sum("part").alias("integral"))

    def evaluate(self, points, extrapolation: str | None = None) -> DataFrame:
        """``(id, t, v)``: the broken line of each curve at shared points; null outside its own range.

        Points and measurements are merged in order and each point is bracketed by window functions, so no row is
        compared with all others. ``bounds`` gives the end values outside.
        """
        spark = self.df.sparkSession
        asked = spark.createDataFrame([(float(p),) for p in points], "t double")
        marks = self.df.select("id").distinct().crossJoin(F.broadcast(asked)).select("id", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("ask"))
        every = self.df.where("v is not null").select("id", "t", "v", F.lit(0).alias("ask")).unionByName(marks)
        here = F.when(F.col("ask") == 0, F.struct("t", "v"))
        w = Window.partitionBy("id").orderBy("t", "ask")
        left = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        right = F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        every = every.withColumn("l", left).withColumn("r", right).where("ask = 1")
        line = F.col("l.v") + F.try_divide((F.col("r.v") - F.col("l.v")) * (F.col("t") - F.col("l.t")), F.col("r.t") - F.col("l.t"))
        value = F.when(F.col("l.t") == F.col("t"), F.col("l.v")).otherwise(line)
        if extrapolation == "bounds":
            value = F.coalesce(value, F.col("l.v"), F.col("r.v"))
        return every.select("id", "t", value.alias("v"))

    def to_basis(self, basis: Basis, ridge: float = 0.0) -> BasisCurves:
        """Least squares of each curve on a basis: normal equations per id by one aggregation."""
        n = basis.n_basis
        values = basis.columns(F.col("t"))
        rows = self.df.where("v is not null").select("id", "v", *[c.alias(f"b{i}") for i, c in enumerate(values)])
        sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col(f"b{i}") * F.col("v")).alias(f"r{i}") for i in range(n)]
        grouped = rows.groupBy("id").agg(*sums)
        kind = f"id {grouped.schema['id'].dataType.simpleString()}, coef array<double>"

        def solve(batches):
            for b in batches:
                gram = np.zeros((len(b), n, n))
                for i in range(n):
                    for j in range(i, n):
                        gram[:, i, j] = gram[:, j, i] = b[f"g{i}_{j}"]
                right = np.stack([b[f"r{i}"] for i in range(n)], 1) if len(b) else np.zeros((0, n))
                coef = [np.linalg.pinv(g + ridge * np.eye(n), hermitian=True) @ r for g, r in zip(gram, right)]
                yield b[["id"]].assign(coef=coef)

        return BasisCurves(grouped.mapInPandas(solve, kind), basis)


@dataclass(frozen=True)
class BasisCurves:
    """``df``: ``id, coef array<double>``; ``basis``: the shared basis."""

    df: DataFrame
    basis: Basis

    def to_grid(self, points=None) -> Curves:
        points = np.linspace(*self.basis.domain, 501) if points is None else np.asarray(points, float)
        return Curves(apply_matrix(self.df.withColumnRenamed("coef", "data"), self.basis(points)), GridMeta.of(points, self.basis.domain))

    def derivative(self, order: int = 1) -> BasisCurves:
        basis, matrix = self.basis.derivative(order)
        return BasisCurves(apply_matrix(self.df, matrix, "coef", "coef"), basis)

    def integrate(self) -> DataFrame:
        return self.df.select("id", dot(F.col("coef"), self.basis.integrals()).alias("integral"))

    def _combine(self, other, f) -> BasisCurves:
        if isinstance(other, BasisCurves):
            if other.basis != self.basis:
                raise ValueError("the sets have different bases")
            both = self.df.join(other.df.select("id", F.col("coef").alias("_o")), "id")
            return BasisCurves(both.withColumn("coef", pairwise(F.col("coef"), F.col("_o"), f)).drop("_o"), self.basis)
        value = other if isinstance(other, Column) else F.lit(float(other))
        return BasisCurves(self.df.withColumn("coef", F.transform("coef", lambda x: f(x, value))), self.basis)

    def __add__(self, other):
        return self._combine(other, lambda a, b: a + b) if isinstance(other, BasisCurves) else NotImplemented

    def __sub__(self, other):
        return self._combine(other, lambda a, b: a - b) if isinstance(other, BasisCurves) else NotImplemented

    def __mul__(self, other):
        """By a number or a column with one value a curve; products of functions leave the basis."""
        return NotImplemented if isinstance(other, BasisCurves) else self._combine(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        """By a number or a column; division of functions leaves the basis."""
        return NotImplemented if isinstance(other, BasisCurves) else self._combine(other, F.try_divide)

    def __neg__(self):
        return self * -1.0

    def concatenate(self, *others: BasisCurves) -> BasisCurves:
        if any(o.basis != self.basis for o in others):
            raise ValueError("the sets have different bases")
        return BasisCurves(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o.df for o in others], self.df), self.basis)

    def where(self, condition) -> BasisCurves:
        return BasisCurves(self.df.where(condition), self.basis)

    def shift(self, delta: float, points=None) -> BasisCurves:
        """f(t + delta) where that lies in the domain, the nearest end elsewhere, projected onto the basis from a fine grid."""
        t = np.linspace(*self.basis.domain, 501) if points is None else np.asarray(points, float)
        matrix = self.basis.fit_matrix(t) @ self.basis(np.clip(t + delta, *self.basis.domain))
        return BasisCurves(apply_matrix(self.df, matrix, "coef", "coef"), self.basis)

    def compose(self, inner: Curves) -> Curves:
        """f(g(t)) for each id on the grid of g, from a fine grid of f."""
        return self.to_grid().compose(inner)

    def sum(self) -> DataFrame:
        """``(k, value)``: summed coefficients."""
        return self.df.select(F.posexplode("coef").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("value"))

    def mean(self) -> DataFrame:
        """``(k, value)``: mean coefficients."""
        return self.df.select(F.posexplode("coef").alias("k", "c")).groupBy("k").agg(F.avg("c").alias("value"))

    def coefficient_covariance(self, correction: int = 0) -> np.ndarray:
        """Covariance of the coefficients; with values B(s), B(t) it is that of the functions."""
        from curvelake.operators.stats import covariance

        n = self.basis.n_basis
        return covariance(Curves(self.df.withColumnRenamed("coef", "data"), GridMeta.regular(n, 0, max(1, n - 1))), correction)

    def inner_product(self, other: BasisCurves) -> DataFrame:
        """``(id, inner)``: the inner product of the functions of the same id."""
        gram = self.basis.inner(other.basis)
        left = apply_matrix(self.df, gram.T, "coef", "coef")
        both = left.join(other.df.select("id", F.col("coef").alias("_o")), "id")
        return both.select("id", total(F.zip_with("coef", "_o", lambda a, b: a * b)).alias("inner"))

    def coefficients(self, n: int | None = None) -> DataFrame:
        return self.df.select("id", (F.col("coef") if n is None else F.slice("coef", 1, n)).alias("coef"))

    def to_basis(self, basis: Basis) -> BasisCurves:
        """Projection onto another basis: exact when that basis spans this one."""
        gram = basis.gram()
        return self if basis == self.basis else BasisCurves(apply_matrix(self.df, np.linalg.pinv(gram) @ basis.inner(self.basis), "coef", "coef"), basis)

    def isna(self) -> DataFrame:
        return self.df.select("id", F.forall("coef", lambda x: x.isNull() | F.isnan(x)).alias("missing"))


__all__ = ["BasisCurves", "Curves", "Irregular", "stencil"]
