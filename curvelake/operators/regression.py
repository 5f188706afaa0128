"""Regression on and of curves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.basis import Basis
from curvelake.columns import apply_matrix, constant
from curvelake.frames import Curves
from curvelake.functions.kernels import ARRAYS
from curvelake.meta import GridMeta
from curvelake.operators.classification import _weight
from curvelake.operators.metrics import block_distances, in_blocks, k_neighbours, radius_neighbours
from curvelake.operators.reduction import fpca, fpls
from curvelake.operators.stats import added, moments


@dataclass(frozen=True)
class LinearModel:
    """y = intercept + sum over scalars + integral of curve times coefficient function."""

    intercept: float
    scalars: dict[str, float]
    function: np.ndarray  # coefficients in the basis
    basis: Basis | None
    design: np.ndarray | None  # grid x basis, quadrature weights included

    def predict(self, curves: Curves) -> DataFrame:
        """``(id, predicted)``"""
        value = F.lit(self.intercept)
        for name, c in self.scalars.items():
            value = value + F.col(name) * c
        if self.design is not None:
            value = value + F.aggregate(F.zip_with("data", constant(self.design @ self.function), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return curves.df.select("id", value.alias("predicted"))


def linear_regression(
    curves: Curves, y: str, basis: Basis | None = None, scalars: list[str] | None = None, smoothing: float = 0.0, order: int = 2, weight: str | None = None, fit_intercept: bool = True
) -> LinearModel:
    """Scalar response on a curve and scalar columns, the coefficient function in a basis, with a roughness penalty.

    One aggregation makes the normal equations; they have the size of basis and columns.
    """
    scalars = scalars or []
    x = curves.meta.points
    design = curves.weights()[:, None] * basis(x) if basis is not None else None
    df = curves.df
    if design is not None:
        df = apply_matrix(df, design.T, out="_z")
    parts = ([F.array(F.lit(1.0))] if fit_intercept else []) + [F.array(F.col(s).cast("double")) for s in scalars] + ([F.col("_z")] if design is not None else [])
    n_z = basis.n_basis if basis is not None else 0
    p = int(fit_intercept) + len(scalars) + n_z
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.concat(*parts).alias("z"), F.col(y).cast("double").alias("y"), w.alias("w")).where("y is not null and w >= 0")

    def part(batches):
        gram, right = np.zeros((p, p)), np.zeros(p)
        for b in batches:
            if len(b):
                z = np.stack(b["z"]).astype(float)
                ok = np.isfinite(z).all(1)
                z, yy, ww = z[ok], b["y"].to_numpy()[ok], b["w"].to_numpy()[ok]
                gram += z.T @ (z * ww[:, None])
                right += z.T @ (yy * ww)
        yield pd.DataFrame({"s": [np.r_[gram.ravel(), right]]})

    sums = added(rows.mapInPandas(part, "s array<double>"), "s")
    sums = np.zeros(p * p + p) if sums is None else sums
    gram, right = sums[: p * p].reshape(p, p), sums[p * p :]
    if smoothing and basis is not None:
        gram[p - n_z :, p - n_z :] += smoothing * basis.penalty(order)
    c = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
    k = int(fit_intercept)
    return LinearModel(float(c[0]) if fit_intercept else 0.0, dict(zip(scalars, map(float, c[k:]))), c[k + len(scalars) :], basis, design)


@dataclass(frozen=True)
class Term:
    """A functional covariate, the basis of its coefficient function, and that function's roughness penalty."""

    curves: Curves
    basis: Basis
    smoothing: float = 0.0
    order: int = 2


def linear_regression_terms(terms: list[Term], y: str, scalars: list[str] | None = None, fit_intercept: bool = True):
    """(intercept, scalar coefficients, coefficient functions, predict) of a scalar response on several functional covariates.

    The sets are joined on id; ``y`` and ``scalars`` are columns of the first one. Each term has a penalty of its
    own. ``predict`` takes sets like the covariates, in their order, and gives ``(id, predicted)``.
    """
    scalars = scalars or []
    designs = [t.curves.weights()[:, None] * t.basis(t.curves.meta.points) for t in terms]

    def joined(sets: list[Curves], carry: list[str]) -> DataFrame:
        out = None
        for k, (c, design) in enumerate(zip(sets, designs)):
            one = apply_matrix(c.df.select("id", "data", *(carry if k == 0 else [])), design.T, out=f"_z{k}").drop("data")
            out = one if out is None else out.join(one, "id")
        return out

    first = [F.array(F.lit(1.0))] if fit_intercept else []
    cells = lambda: F.concat(*first, *[F.array(F.col(s).cast("double")) for s in scalars], *[F.col(f"_z{k}") for k in range(len(terms))])
    size = len(first) + len(scalars) + sum(t.basis.n_basis for t in terms)
    df = joined([t.curves for t in terms], [y, *scalars])
    rows = df.select(F.concat(cells(), F.array(F.col(y).cast("double"))).alias("data"))

    def part(batches):
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if len(b):
                z = np.stack([np.full(size + 1, np.nan) if v is None else np.asarray(v, float) for v in b["data"]])
                z = z[np.isfinite(z).all(1)]
                total += z.T @ z
        yield pd.DataFrame({"s": [total.ravel()]})

    sums = added(rows.mapInPandas(part, "s array<double>"), "s")
    sums = np.zeros((size + 1, size + 1)) if sums is None else sums.reshape(size + 1, size + 1)
    gram, at = sums[:size, :size].copy(), len(first) + len(scalars)
    spans = []
    for t in terms:
        n = t.basis.n_basis
        if t.smoothing:
            gram[at : at + n, at : at + n] += t.smoothing * t.basis.penalty(t.order)
        spans.append((at, at + n))
        at += n
    c = np.linalg.lstsq(gram, sums[:size, size], rcond=1e-12)[0]

    def predict(sets: list[Curves]) -> DataFrame:
        return joined(sets, scalars).select("id", F.aggregate(F.zip_with(cells(), constant(c), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x).alias("predicted"))

    return (float(c[0]) if fit_intercept else 0.0), dict(zip(scalars, map(float, c[len(first) :]))), [c[a:b] for a, b in spans], predict


def function_on_function(response: Curves, predictor: Curves, basis: Basis, response_basis: Basis, ridge: float = 0.0):
    """(intercept, surface, predict) of y(t) = a(t) + integral of x(s) b(s, t) ds, b in the product of two bases.

    ``intercept`` has coefficients in ``response_basis``; ``surface`` is (basis, response basis). The sets are joined
    on id; ``predict`` gives curves on the response's grid.
    """
    design = predictor.weights()[:, None] * basis(predictor.meta.points)
    z = apply_matrix(predictor.df.select("id", "data"), design.T)
    coef = apply_matrix(response.df.select("id", "data"), response_basis.fit_matrix(response.meta.points)).withColumnRenamed("data", "_y")
    n, m = basis.n_basis, response_basis.n_basis
    both = z.join(coef, "id").select("id", F.concat("data", "_y").alias("data"))
    _, mean, scatter = moments(Curves(both, GridMeta.regular(n + m, 0, n + m - 1)))
    surface = np.linalg.lstsq(scatter[:n, :n] + ridge * np.eye(n), scatter[:n, n:], rcond=1e-12)[0]
    intercept = mean[n:] - mean[:n] @ surface
    values = response_basis(response.meta.points)

    def predict(curves: Curves) -> Curves:
        moved = Curves(apply_matrix(curves.df, values @ surface.T @ design.T), response.meta)
        return moved.with_df(moved.df.withColumn("data", F.zip_with("data", constant(values @ intercept), lambda a, b: a + b)))

    return intercept, surface, predict


def function_on_scalar(curves: Curves, scalars: list[str], fit_intercept: bool = True) -> np.ndarray:
    """(terms, grid): the coefficient functions of curves on scalar columns, pointwise least squares."""
    d = curves.meta.size
    joined = curves.df.withColumn("data", F.concat(F.array(*[F.col(s).cast("double") for s in scalars]), "data"))
    size = len(scalars) + d
    n, mean, scatter = moments(Curves(joined, GridMeta.regular(size, 0, size - 1)))
    k = len(scalars)
    if not fit_intercept:
        full = scatter + n * np.outer(mean, mean)
        return np.linalg.lstsq(full[:k, :k], full[:k, k:], rcond=None)[0]
    slope = np.linalg.lstsq(scatter[:k, :k], scatter[:k, k:], rcond=None)[0]
    return np.vstack([mean[k:] - mean[:k] @ slope, slope])


def historical_regression(response: Curves, predictor: Curves, n_intervals: int = 4, ridge: float = 1e-8) -> np.ndarray:
    """(grid s, grid t) coefficient surface of y(t) = integral over s <= t of x(s) b(s, t), piecewise linear in both.

    The products are hat functions on a triangle; their normal equations come from the joint moments.
    """
    x, y = predictor.meta.points, response.meta.points
    both = response.df.join(predictor.df.select("id", F.col("data").alias("_x")), "id").withColumn("data", F.concat("_x", "data"))
    n_x = len(x)
    size = n_x + len(y)
    _, _, scatter = moments(Curves(both, GridMeta.regular(size, 0, size - 1)))
    xx, xy = scatter[:n_x, :n_x], scatter[:n_x, n_x:]
    from curvelake.basis import BSplineBasis

    low, high = predictor.meta.domain[0]
    hats = BSplineBasis((low, high), n_intervals + 1, 2)
    bs, bt = hats(x), hats(np.clip(y, low, high))
    w = predictor.weights()
    pairs = [(i, j) for i in range(n_intervals + 1) for j in range(i, n_intervals + 1)]
    past = (x[:, None] <= y[None] + 1e-12).astype(float)
    maps = np.stack([w[:, None] * bs[:, i][:, None] * past * bt[:, j][None] for i, j in pairs])  # terms x s x t
    gram = np.einsum("ast,su,but->ab", maps, xx, maps)
    right = np.einsum("ast,st->a", maps, xy)
    c = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), right)
    return sum(v * bs[:, i][:, None] * past * bt[:, j][None] for v, (i, j) in zip(c, pairs))


def kernel_regression(queries: Curves, train: Curves, y: str, bandwidth: float, kernel: str = "normal") -> DataFrame:
    """``(id, predicted)``: Nadaraya-Watson over L2 distances; null where no training curve has a weight."""
    w = queries.weights()

    def summed(frame, q, b, x):
        k = ARRAYS[kernel](block_distances(q, x, w, "l2") / bandwidth)
        target = b[y].to_numpy(float)
        ok = np.isfinite(target)
        k = np.where(np.isnan(k), 0, k)[:, ok]
        return pd.DataFrame({"id": frame["id"].to_numpy(), "top": k @ target[ok], "bottom": k.sum(1)})

    sums = in_blocks(queries, train, summed, f"id {dict(queries.df.dtypes)['id']}, top double, bottom double", row_columns=[y])
    return sums.groupBy("id").agg(F.try_divide(F.sum("top"), F.sum("bottom")).alias("predicted"))


def knn_regress(queries: Curves, train: Curves, y: str, k: int = 5, metric: str = "l2", weights: str = "uniform") -> DataFrame:
    near = k_neighbours(queries, train, k, metric, carry=[y]).withColumn("w", _weight(weights))
    return near.groupBy(F.col("query").alias("id")).agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("predicted"))


def radius_regress(queries: Curves, train: Curves, y: str, radius: float, metric: str = "l2", weights: str = "uniform") -> DataFrame:
    """Queries without a neighbour get null."""
    near = radius_neighbours(queries, train, radius, metric, carry=[y]).withColumn("w", _weight(weights))
    found = near.groupBy(F.col("query").alias("id")).agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("predicted"))
    return queries.df.select("id").join(found, "id", "left")


def knn_regress_curves(queries: Curves, train: Curves, responses: Curves, k: int = 5, metric: str = "l2", weights: str = "uniform") -> Curves:
    """A functional response: the weighted mean of the neighbours' response curves."""
    near = k_neighbours(queries, train, k, metric).withColumn("w", _weight(weights))
    cells = near.join(responses.df.select(F.col("id").alias("neighbour"), "data"), "neighbour").select("query", "w", F.posexplode("data").alias("pos", "v"))
    points = cells.groupBy("query", "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return Curves.from_long(points, responses.meta, "query")


def fpca_regression(train: Curves, y: str, k: int = 5):
    """(components, model): linear regression on principal component scores."""
    pcs = fpca(train, k)
    scores = pcs.transform(train).join(train.df.select("id", y), "id")
    names = [f"s{i}" for i in range(k)]
    frame = scores.select("id", F.col("scores").alias("data"), y, *[F.get("scores", F.lit(i)).alias(n) for i, n in enumerate(names)])
    model = linear_regression(Curves(frame, GridMeta.regular(k, 0, max(1, k - 1))), y, scalars=names)

    def predict(curves: Curves) -> DataFrame:
        s = pcs.transform(curves)
        value = F.lit(model.intercept)
        for i, n in enumerate(names):
            value = value + F.get("scores", F.lit(i)) * model.scalars[n]
        return s.select("id", value.alias("predicted"))

    return pcs, predict


def fpls_regression(train: Curves, y: str, k: int = 3):
    model = fpls(train, [y], k)
    return model, lambda curves: model.predict(curves).select("id", F.get("predicted", F.lit(0)).alias("predicted"))


def distance_weights(near: DataFrame) -> DataFrame:
    return near.withColumn("w", _weight("distance")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("query")))
