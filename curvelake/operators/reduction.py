"""Dimension reduction: sums of the size of the grid from Spark, eigenvectors on the driver, scores back in Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.basis import Basis
from curvelake.columns import apply_matrix, constant
from curvelake.frames import BasisCurves, Curves
from curvelake.numerics import difference_matrix, fix_signs, report_unfinished, simpson_weights
from curvelake.operators.stats import moments


@dataclass(frozen=True)
class PrincipalComponents:
    """``components`` (k, grid) with unit norm under the weights, ``variances``, ``mean``."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    curves: Curves

    def transform(self, curves: Curves) -> DataFrame:
        """``(id, scores)``: inner products of the centred curves with the components."""
        out = apply_matrix(curves.df.select("id", "data"), self.components * self.weights, centre=self.mean)
        return out.withColumnRenamed("data", "scores")

    def inverse_transform(self, scores: DataFrame) -> Curves:
        back = apply_matrix(scores.select("id", F.concat("scores", F.array(F.lit(1.0))).alias("data")), np.column_stack([self.components.T, self.mean]))
        return Curves(back, self.curves.meta)


def fpca(curves: Curves, k: int, centering: bool = True, smoothing: float = 0.0, order: int = 2) -> PrincipalComponents:
    """Principal components on a grid under Simpson weights, with an optional roughness penalty."""
    n, mean, scatter = moments(curves)
    if k > n or k > len(mean):
        raise AttributeError("more components than curves or grid points")
    if not centering:
        scatter, mean = scatter + n * np.outer(mean, mean), np.zeros_like(mean)
    x, w = curves.meta.points, curves.weights()
    metric = np.diag(w)
    if smoothing:
        d = difference_matrix(x, order)
        metric = metric + smoothing * d.T @ (simpson_weights(x)[:, None] * d)
    low = np.linalg.cholesky(metric)
    z = np.linalg.solve(low, np.diag(w))
    values, vectors = np.linalg.eigh(z @ (scatter / (n - 1)) @ z.T)
    pick = np.argsort(values)[::-1][:k]
    components = fix_signs(np.linalg.solve(low.T, vectors[:, pick]).T)
    return PrincipalComponents(mean, components, values[pick], values[pick] / max(values.sum(), 1e-300), w, curves)


def fpca_basis(curves: BasisCurves, k: int, smoothing: float = 0.0, order: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean coefficients, component coefficients (k, n_basis), variances) under the Gram matrix of the basis."""
    from curvelake.meta import GridMeta

    n_basis = curves.basis.n_basis
    as_grid = Curves(curves.df.withColumnRenamed("coef", "data"), GridMeta.regular(n_basis, 0, max(1, n_basis - 1)))
    n, mean, scatter = moments(as_grid)
    gram = curves.basis.gram()
    metric = gram + (smoothing * curves.basis.penalty(order) if smoothing else 0)
    low = np.linalg.cholesky(metric)
    z = np.linalg.solve(low, gram)
    values, vectors = np.linalg.eigh(z @ (scatter / (n - 1)) @ z.T)
    pick = np.argsort(values)[::-1][:k]
    return mean, fix_signs(np.linalg.solve(low.T, vectors[:, pick]).T), values[pick]


@dataclass(frozen=True)
class PartialLeastSquares:
    mean_x: np.ndarray
    mean_y: np.ndarray
    rotations: np.ndarray  # grid x k, to be used with the weights
    coefficients: np.ndarray  # grid x responses

    def transform(self, curves: Curves) -> DataFrame:
        return apply_matrix(curves.df.select("id", "data"), self.rotations.T, centre=self.mean_x).withColumnRenamed("data", "scores")

    def predict(self, curves: Curves) -> DataFrame:
        out = apply_matrix(curves.df.select("id", "data"), self.coefficients.T, centre=self.mean_x)
        return out.select("id", F.transform(F.arrays_zip("data", F.array(*[F.lit(float(m)) for m in self.mean_y]).alias("m")), lambda p: p["data"] + p["m"]).alias("predicted"))


def joint_moments(curves: Curves, responses: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the curve's cells followed by scalar columns."""
    from curvelake.meta import GridMeta

    joined = curves.df.withColumn("data", F.concat("data", F.array(*[F.col(r).cast("double") for r in responses])))
    size = curves.meta.size + len(responses)
    return moments(Curves(joined, GridMeta.regular(size, 0, size - 1)))


def fpls(curves: Curves, responses: list[str], k: int) -> PartialLeastSquares:
    """Partial least squares of scalar responses, from the summed products alone (no pass a component)."""
    n, mean, scatter = joint_moments(curves, responses)
    t = curves.meta.size
    w = curves.weights()
    root = np.sqrt(np.maximum(w, 0))
    xx = scatter[:t, :t] * root[:, None] * root[None]
    xy = scatter[:t, t:] * root[:, None]
    if k > min(n, t):
        raise ValueError("more components than curves or grid points")
    weights, loadings_x, loadings_y = [], [], []
    a, b = xx.copy(), xy.copy()
    for _ in range(k):
        u = np.linalg.svd(b, full_matrices=False)[0][:, 0]
        s = u @ a @ u
        if s <= 1e-12 * max(1.0, np.trace(xx)):
            break
        p, q = a @ u / s, b.T @ u / s
        weights.append(u), loadings_x.append(p), loadings_y.append(q)
        a, b = a - s * np.outer(p, p), b - s * np.outer(p, q)
    u, p, q = np.array(weights).T, np.array(loadings_x).T, np.array(loadings_y).T
    rotation = u @ np.linalg.pinv(p.T @ u)
    return PartialLeastSquares(mean[:t], mean[t:], rotation * root[:, None], (rotation @ q.T) * root[:, None])


class _Distances:
    """L2 distances of all pairs, made block by block in the tasks; every task gets the curves, none the pairs."""

    def __init__(self, spark: SparkSession, x: np.ndarray, cells: int = 4_000_000):
        self.spark, self.n = spark, len(x)
        self.rows = max(1, min(self.n, cells // max(1, self.n)))
        self.columns = spark.sparkContext.broadcast(np.ascontiguousarray(x.T))

    def each(self, work, **sent) -> list:
        """``work(start, distances of some rows to all, **sent)`` for every block of rows, in their order."""
        columns, rows, n = self.columns, self.rows, self.n
        held = self.spark.sparkContext.broadcast(sent)

        def run(start: int):
            x = columns.value
            square = np.zeros((min(rows, n - start), n))
            for c in x:  # the same in the last digit whatever the block
                off = c[start : start + rows, None] - c[None]
                off *= off
                square += off
            return work(start, np.sqrt(square, out=square), **held.value)

        starts = range(0, n, rows)
        out = self.spark.sparkContext.parallelize(starts, min(len(starts), 200)).map(run).collect()  # what a block leaves is bounded by the rows
        held.destroy()
        return out

    def median(self, bins: int = 4096, most: int = 2_000_000) -> float:
        """The median of the positive distances, exactly: counts in ever narrower ranges, then the values of the last."""
        def count(start, d, low, high):
            at = d[(d > 0) & (d >= low) & (d < high)]
            return np.histogram(at, np.linspace(low, high, bins + 1))[0], int(((d > 0) & (d < low)).sum())

        def pick(start, d, low, high):
            return np.unique(d[(d > 0) & (d >= low) & (d < high)], return_counts=True), int(((d > 0) & (d < low)).sum())

        low, high = 0.0, float(np.nextafter(max(self.each(lambda start, d: float(d.max()))), np.inf))
        total = None
        while True:
            got = self.each(count, low=low, high=high)
            counts, below = np.sum([g[0] for g in got], axis=0), sum(g[1] for g in got)
            total = int(counts.sum()) if total is None else total
            if not total:
                raise ValueError("no two curves differ")
            upto, edges = below + np.cumsum(counts), np.linspace(low, high, bins + 1)
            first, last = np.searchsorted(upto, [(total - 1) // 2, total // 2], side="right")
            few = int(counts[first : last + 1].sum())
            # a margin of an edge's rounding, since the ranges of histogram and of the next count may differ by it
            new = (float(np.nextafter(edges[first], -np.inf)), float(np.nextafter(edges[last + 1], np.inf)))
            narrower = new[1] - new[0] < (high - low) / 2
            low, high = new
            if few <= most or not narrower:
                got = self.each(pick, low=low, high=high)
                values, times = (np.concatenate([g[0][k] for g in got]) for k in (0, 1))
                order, below = np.argsort(values, kind="stable"), sum(g[1] for g in got)
                middle = values[order[np.searchsorted(below + np.cumsum(times[order]), [(total - 1) // 2, total // 2], side="right")]]
                return float(middle.sum() / 2)

    def times(self, kernel, scale: float, v: np.ndarray) -> np.ndarray:
        """The matrix of the kernel times v."""
        return np.concatenate(self.each(lambda start, d, v: kernel(d / scale) @ v, v=v))


def _leading(times, first: np.ndarray, k: int, extra: int = 16, rounds: int = 40, tol: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors of a symmetric matrix given by its products, by block Krylov spaces from ``first``."""
    n = len(first)
    width = min(n, k + extra)
    new = np.linalg.qr(np.column_stack([first, np.random.default_rng(seed).normal(size=(n, width - 1))]))[0]
    space, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(rounds):
        made = times(new)
        space, image = np.column_stack([space, new]), np.column_stack([image, made])
        inner = space.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        vectors = space @ turns
        left = float(np.sqrt(((image @ turns - vectors * values) ** 2).sum(0)).max()) / max(1e-300, float(np.abs(values).max()))
        if left <= tol or space.shape[1] >= n:
            break
        for _ in range(2):
            made = made - space @ (space.T @ made)
        q, size, _ = np.linalg.svd(made, full_matrices=False)
        q = q[:, size > 1e-14][:, : n - space.shape[1]]
        q = q - space @ (space.T @ q)
        if not q.shape[1]:
            break
        new = np.linalg.qr(q)[0]
    else:
        report_unfinished("the diffusion map", rounds, left, tol)
    return values, vectors


def diffusion_map(curves: Curves, kernel, n_components: int = 2, alpha: float = 0.0, n_steps: int = 1, scale: str | float = 1.0, dense_rows: int = 2_000) -> DataFrame:
    """``(id, embedding)``: eigenvectors of the Markov matrix of a kernel over the L2 distances of all curves.

    ``kernel`` maps an array of distances to their weights, one by one; distances are first divided by ``scale``, which
    may be ``"median"``, that of all positive ones. Up to ``dense_rows`` curves the matrix is made at once; of more its blocks are
    made in tasks, for every product with it, and the leading vectors are found from such products.
    """
    if n_components < 1 or not 0 <= alpha <= 1 or n_steps < 0:
        raise ValueError("wrong parameters of a diffusion map")
    spark = curves.df.sparkSession
    got = curves.df.select("id", "data").orderBy("id").toPandas()
    if n_components >= len(got):
        raise ValueError(f"a diffusion map takes at least {n_components + 1} curves")
    x = np.stack(got["data"])
    if len(x) <= dense_rows:
        from curvelake.operators.metrics import block_distances

        off = block_distances(x, x, curves.weights(), "l2")
        k = kernel(off / (np.median(off[off > 0]) if scale == "median" else scale))
        d = k.sum(1) ** alpha
        k = k / d[:, None] / d[None]
        d = k.sum(1)
        values, vectors = np.linalg.eigh(k / np.sqrt(d[:, None] * d[None]))
        pick = np.argsort(values)[::-1][1 : n_components + 1]
        values, vectors = values[pick], vectors[:, pick]
    else:
        pairs = _Distances(spark, x * np.sqrt(np.maximum(curves.weights(), 0)))
        by = pairs.median() if scale == "median" else scale
        times = lambda v: pairs.times(kernel, by, v)
        ones = np.ones(len(x))
        share = times(ones) ** -alpha if alpha else ones
        d = share * times(share)
        root = share / np.sqrt(d)
        values, vectors = _leading(lambda v: root[:, None] * times(root[:, None] * v), np.sqrt(d), n_components + 1)
        values, vectors = values[1:], vectors[:, 1:]
        pairs.columns.destroy()
    right = fix_signs((vectors / np.sqrt(d / d.sum())[:, None]).T).T * values**n_steps
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(got["id"].tolist(), right)], f"id {dict(curves.df.dtypes)['id']}, embedding array<double>")


def rkhs_selection(curves: Curves, label: str, k: int) -> list[int]:
    """Greedy grid positions that separate the means of two classes best under the pooled covariance."""
    names = [r[0] for r in curves.df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    if len(names) != 2:
        raise ValueError("two classes are needed")
    (n0, m0, s0), (n1, m1, s1) = [moments(curves, F.col(label) == F.lit(g)) for g in names]
    off, cov = m1 - m0, (s0 / n0) * (n0 / (n0 + n1)) + (s1 / n1) * (n1 / (n0 + n1))
    chosen: list[int] = []
    for _ in range(k):
        best = None
        for i in range(len(off)):
            if i in chosen:
                continue
            pick = [*chosen, i]
            gain = float(off[pick] @ np.linalg.pinv(cov[np.ix_(pick, pick)]) @ off[pick])
            if best is None or gain > best[0] + 1e-12:
                best = (gain, i)
        chosen.append(best[1])
    return chosen


def _distance_sums(x: np.ndarray) -> np.ndarray:
    """Sum of the distances of each number to all others, from prefix sums in order."""
    order, n = np.argsort(x, kind="stable"), len(x)
    v = x[order]
    before = np.cumsum(v) - v
    out = np.empty(n)
    out[order] = (2 * np.arange(n) - n) * v + v.sum() - 2 * before
    return out


def _distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |x_i - x_j| |y_i - y_j| over all i, j: pairs in order of x, and those also in order of y by merging halves."""
    order, n = np.argsort(x, kind="stable"), len(x)
    x, y = x[order], y[order]
    values = np.stack([np.ones(n), x, y, x * y])
    less, by_y, width = np.zeros((4, n)), np.argsort(y, kind="stable"), 1
    while width < n:
        o = by_y[np.argsort(by_y // (2 * width), kind="stable")]
        left = o // width % 2 == 0
        sums = np.concatenate([np.zeros((4, 1)), np.cumsum(values[:, o] * left, axis=1)], axis=1)
        right = np.flatnonzero(~left)
        less[:, o[right]] += sums[:, right] - sums[:, o[right] // (2 * width) * (2 * width)]
        width *= 2
    before = np.cumsum(values, axis=1) - values
    signed = lambda s: float((x * y * s[0] - x * s[2] - y * s[1] + s[3]).sum())
    return 2 * (2 * signed(less) - signed(before))


def _distance_correlation_of_numbers(x: np.ndarray, y: np.ndarray) -> float:
    n = len(x)
    if n < 4:
        return 0.0
    x, y = x - x[0], y - y[0]
    x, y = x - x.mean(), y - y.mean()
    a, b = _distance_sums(x), _distance_sums(y)
    inner = lambda s, p, q: s - 2 / (n - 2) * float(p @ q) + p.sum() * q.sum() / ((n - 1) * (n - 2))
    square = lambda v: 2 * n * float(v @ v) - 2 * float(v.sum()) ** 2
    xx, yy = inner(square(x), a, a), inner(square(y), b, b)
    if xx <= 1e-12 * square(x) or yy <= 1e-12 * square(y):
        return 0.0
    return float(inner(_distance_products(x, y), a, b) / np.sqrt(xx * yy))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased squared distance correlation of two samples of numbers (n log n) or rows (quadratic)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim == y.ndim == 1:
        return _distance_correlation_of_numbers(x, y)

    def centred(v):
        v = v.reshape(len(v), -1)
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        n = len(d)
        u = d - d.sum(0) / (n - 2) - d.sum(1)[:, None] / (n - 2) + d.sum() / ((n - 1) * (n - 2))
        np.fill_diagonal(u, 0)
        return u

    a, b = centred(x), centred(y)
    top, low = (a * b).sum(), np.sqrt((a * a).sum() * (b * b).sum())
    return float(top / low) if low > 0 else 0.0


def independence_statistic(x: np.ndarray, y: np.ndarray) -> float:
    """Squared distance covariance over the product of the mean distances, in n log n steps but for their means."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)

    def mean_distance(v: np.ndarray) -> float:
        s = np.sort(v)
        return float(2 * ((2 * np.arange(n) - n + 1) * s).sum() / n**2)

    product = mean_distance(x) * mean_distance(y)
    if not product > 0:
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    a, b = _distance_sums(x), _distance_sums(y)
    squared = _distance_products(x, y) / n**2 - 2 * float(a @ b) / n**3 + a.sum() * b.sum() / n**4
    return float(squared / product)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Nearest-neighbour estimate of the mutual information of a number and a class, from sorted values."""
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, float), np.asarray(y)
    order = np.lexsort((y, x))  # the same noise in whatever order the rows come
    x, y = x[order], y[order]
    x = x / (x.std() or 1) + 1e-10 * max(1.0, np.abs(x).mean()) * rng.standard_normal(len(x))
    every = np.sort(x)
    n, total, used = len(x), 0.0, 0
    for c in np.unique(y):
        own = np.sort(x[y == c])
        if len(own) < 2:
            continue
        near = min(k, len(own) - 1)
        pad = np.concatenate([np.full(near, -np.inf), own, np.full(near, np.inf)])
        # the nearest own values are a stretch of near + 1 that holds the value itself
        reach = [np.maximum(own - pad[s : s + len(own)], pad[s + near : s + near + len(own)] - own) for s in range(near + 1)]
        radius = np.nextafter(np.min(reach, axis=0), 0)
        m = _upto(every, own, radius) + _upto(-every[::-1], -own, radius) - n
        total += (_digamma(near) - _digamma(m)).sum() + len(own) * _digamma(len(own))
        used += len(own)
    return max(0.0, float(total / used + _digamma(used))) if used and n else 0.0


def _upto(every: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted values exceed each own value by the radius at most, compared as differences."""
    at = np.searchsorted(every, own + radius, "right")
    while len(far := np.flatnonzero((at > 0) & (every[at - 1] - own > radius))):
        at[far] -= 1
    while len(near := np.flatnonzero((at < len(every)) & (every[np.minimum(at, len(every) - 1)] - own <= radius))):
        at[near] += 1
    return at


def _digamma(v):
    v = np.asarray(v, float)
    shift = np.zeros_like(v)
    for _ in range(6):
        low = v < 6
        shift = np.where(low, shift - 1 / np.where(low, v, 1), shift)
        v = np.where(low, v + 1, v)
    return shift + np.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6)


def dependence(curves: Curves, label: str, measure=distance_correlation) -> np.ndarray:
    """The dependence of the value at each grid point on the label, over all labelled curves; a task a grid point.

    A task holds one value and one label a curve; the measures take n log n steps.
    """
    cells = curves.df.where(F.col(label).isNotNull()).select(label, F.posexplode("data").alias("pos", "v")).where("v is not null")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        y = pd.factorize(frame[label], sort=True)[0] if frame[label].dtype == object else frame[label].to_numpy(float)
        return pd.DataFrame({"pos": [int(frame["pos"].iloc[0])], "d": [measure(frame["v"].to_numpy(float), y)]})

    rows = cells.groupBy("pos").applyInPandas(work, "pos int, d double").collect()
    out = np.zeros(curves.meta.size)
    for r in rows:
        out[r["pos"]] = r["d"]
    return out


def maxima_hunting(curves: Curves, label: str, order: int = 1, max_points: int | None = None, **options) -> list[int]:
    """Positions of the local maxima of the dependence curve, the strongest first."""
    d = dependence(curves, label, **options)
    keep = [i for i in range(len(d)) if d[i] >= d[max(0, i - order) : i + order + 1].max() and d[i] > d[max(0, i - order) : i + order + 1].min()]
    return sorted(keep, key=lambda i: (-d[i], i))[:max_points]


def uniform_correction(best: int, scatter: np.ndarray) -> np.ndarray:
    """Weights by which the value at the chosen point is taken from every point: 1 everywhere."""
    return np.ones(len(scatter))


def sample_correction(best: int, scatter: np.ndarray) -> np.ndarray:
    """Of a Gaussian process with the covariance of the sample: the regression of each point on the chosen one."""
    return scatter[:, best] / max(scatter[best, best], 1e-300)


def gaussian_correction(covariance: np.ndarray):
    """As ``sample_correction``, of a process with a given covariance on the grid, conditioned on the points chosen so far."""
    now = np.array(covariance, float)

    def correct(best: int, scatter: np.ndarray) -> np.ndarray:
        share = now[:, best] / max(now[best, best], 1e-300)
        now[:] = now - np.outer(share, now[best])
        return share

    return correct


def independence_stop(n: int, significance: float = 0.05):
    """Stop where the distance covariance passes a test of independence: n V^2 / S against the squared normal quantile."""
    from statistics import NormalDist

    limit = NormalDist().inv_cdf(1 - significance / 2) ** 2
    return lambda strongest, statistic: n * statistic <= limit


def recursive_maxima_hunting(
    curves: Curves, label: str, max_features: int = 5, threshold: float = 0.2, redundancy: float = 0.9, correction=uniform_correction, stop=None, similarity=None, **options
) -> list[int]:
    """Repeatedly take the most dependent point, take its value from the curves, and drop points redundant with it.

    ``correction(point, centred products)`` gives the share of the chosen value that each point loses (uniform, of the
    sample, or of a given Gaussian process). ``stop(strongest, statistic)`` ends the search, by default below
    ``threshold``; the statistic is the squared distance covariance over the product of the mean distances.
    ``similarity(products, point)`` tells how redundant points are, by default their squared correlation.
    """
    chosen, masked, now = [], set(), curves
    for _ in range(max_features):
        d = dependence(now, label, **options)
        d[list(masked)] = -np.inf
        best = int(d.argmax())
        if not np.isfinite(d[best]):
            break
        if stop is None:
            if not d[best] > threshold:
                break
        elif stop(d[best], dependence(now.with_df(now.df.withColumn("data", F.array(F.get("data", F.lit(best)))), axes=((0.0,),), domain=((0.0, 0.0),)), label, independence_statistic)[0]):
            break
        chosen.append(best)
        _, _, scatter = moments(now)
        size = np.sqrt(np.maximum(np.diag(scatter), 1e-300))
        alike = (scatter[best] / size / size[best]) ** 2 if similarity is None else similarity(scatter, best)
        close = np.asarray(alike) > redundancy
        for step in (1, -1):
            i = best
            while 0 <= i < len(d) and (close[i] or i == best):
                masked.add(i)
                i += step
        share = correction(best, scatter)
        held = now.df.withColumn("_held", F.get("data", F.lit(best)))
        now = now.with_df(held.withColumn("data", F.zip_with("data", constant(share), lambda x, s: x - s * F.col("_held"))).drop("_held"))
    return chosen


def minimum_redundancy(curves: Curves, label: str, k: int, method: str = "difference", measure=mutual_information) -> list[int]:
    """Greedy positions of the largest relevance less (or over) the mean redundancy with those chosen."""
    relevance = dependence(curves, label, measure)
    _, _, scatter = moments(curves)
    size = np.sqrt(np.maximum(np.diag(scatter), 1e-300))
    corr = scatter / size[:, None] / size[None]
    shared = -0.5 * np.log(np.maximum(1 - np.clip(corr, -1, 1) ** 2, 1e-12))
    chosen: list[int] = []
    for _ in range(k):
        mean = shared[:, chosen].mean(1) if chosen else np.zeros(len(relevance))
        score = relevance - mean if method == "difference" else relevance / np.maximum(mean, 1e-12) if chosen else relevance
        score = np.array([-np.inf if i in chosen else s for i, s in enumerate(score)])
        chosen.append(int(score.argmax()))
    return chosen


def project(curves: Curves, basis: Basis) -> BasisCurves:
    return curves.to_basis(basis)
