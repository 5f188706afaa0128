"""Classifiers over curves."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves
from curvelake.operators.depth import DEPTH_DIGITS, _simplicial, deepest, modified_band_depth
from curvelake.operators.metrics import block_distances, k_neighbours, matrix_of, radius_neighbours
from curvelake.operators.ranks import rank_counts
from curvelake.operators.stats import moments_by


def _weight(kind: str) -> Column:
    """Uniform, or the inverse of the distance; neighbours at distance 0 then count alone."""
    if kind == "uniform":
        return F.lit(1.0)
    zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query"))
    return F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))


def vote(neighbours: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """``(id, predicted)``: the label of the largest weight; ties go to the smallest label."""
    votes = neighbours.withColumn("w", _weight(weights)).groupBy("query", label).agg(F.round(F.sum("w"), 9).alias("w"))
    return votes.groupBy(F.col("query").alias("id")).agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("predicted"))


def vote_shares(neighbours: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """``(id, label, share)``"""
    votes = neighbours.withColumn("w", _weight(weights)).groupBy("query", label).agg(F.sum("w").alias("w"))
    return votes.select(F.col("query").alias("id"), label, (F.col("w") / F.sum("w").over(Window.partitionBy("query"))).alias("share"))


def knn_classify(queries: Curves, train: Curves, label: str, k: int = 5, metric: str = "l2", weights: str = "uniform") -> DataFrame:
    return vote(k_neighbours(queries, train, k, metric, carry=[label]), label, weights)


def radius_classify(queries: Curves, train: Curves, label: str, radius: float, metric: str = "l2", weights: str = "uniform", outlier_label=None) -> DataFrame:
    """Queries without a neighbour get ``outlier_label``."""
    found = vote(radius_neighbours(queries, train, radius, metric, carry=[label]), label, weights)
    return queries.df.select("id").join(found, "id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(outlier_label)))


def class_means(train: Curves, label: str) -> tuple[list, np.ndarray]:
    """Classes in order and their mean curves: one row a class and grid point."""
    rows = train.long(label).where(F.col(label).isNotNull()).groupBy(label, "pos").agg(F.avg("v").alias("m")).orderBy(label, "pos").collect()
    names = list(dict.fromkeys(r[label] for r in rows))
    return names, np.array([r["m"] for r in rows]).reshape(len(names), -1)


def nearest_of(curves: Curves, names: list, centres: np.ndarray, p: float = 2, digits: int = 10) -> DataFrame:
    """``(id, predicted, distance)`` of the nearest of a few known functions."""
    w, size = curves.weights(), curves.meta.size
    centres = np.asarray(centres, float)

    def nearest(batches):
        for b in batches:
            d = np.round(block_distances(matrix_of(b["data"], size), centres, w, "lp" if p not in (1, 2, math.inf) else {1: "l1", 2: "l2"}.get(p, "linf"), p), digits)
            k = np.where(np.isnan(d), np.inf, d).argmin(1) if len(b) else np.zeros(0, int)
            yield pd.DataFrame({"id": b["id"], "k": k.astype("int32"), "distance": d[np.arange(len(b)), k]})

    found = curves.df.select("id", "data").mapInPandas(nearest, f"id {dict(curves.df.dtypes)['id']}, k int, distance double")
    known = F.array(*[F.lit(n) for n in names])
    gone = F.isnan("distance")  # a curve with missing cells is nearest to nothing
    return found.select("id", F.when(~gone, F.get(known, F.col("k"))).alias("predicted"), F.when(~gone, F.col("distance")).alias("distance"))


def nearest_centroid(queries: Curves, train: Curves, label: str, p: float = 2) -> DataFrame:
    return nearest_of(queries, *class_means(train, label), p)


def trimmed_means(train: Curves, label: str, share: float) -> tuple[list, np.ndarray]:
    names = [r[0] for r in train.df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    out = []
    for g in names:
        own = train.where(F.col(label) == F.lit(g))
        n = own.df.count()
        keep = deepest(modified_band_depth(own), n - int(n * share)).select("id")
        rows = own.with_df(own.df.join(keep, "id", "left_semi")).long().groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()
        out.append([r["m"] for r in rows])
    return names, np.array(out)


def dtm_classify(queries: Curves, train: Curves, label: str, share: float, p: float = 2) -> DataFrame:
    return nearest_of(queries, *trimmed_means(train, label, share), p)


def class_depths(queries: Curves, train: Curves, label: str) -> DataFrame:
    """``(id, class, depth)``: modified band depth of every query in every class."""
    queries._same_grid(train)
    names = [r[0] for r in train.df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    size = train.meta.size
    known = F.array(*[F.lit(g) for g in names])
    # a grid point of a class is a group of its own, so all classes are counted in one pass
    own = train.df.where(F.col(label).isNotNull()).select("id", (F.array_position(known, F.col(label)) - 1).cast("int").alias("k"), F.posexplode("data").alias("p", "v"))
    asked = queries.long().select("id", F.col("pos").alias("p"), "v", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("k"))
    cells = own.withColumn("ref", F.lit(1)).unionByName(asked.withColumn("ref", F.lit(0))).select("id", "k", (F.col("k") * size + F.col("p")).alias("pos"), "v", "ref")
    counted = rank_counts(cells, train.df.count() + queries.df.count()).where("ref = 0")
    w = F.get(constant(queries.weights() / queries.length()), F.col("pos") % size)
    depth = F.sum(_simplicial(F.col("below"), F.col("upto"), F.col("n")) * w)
    return counted.groupBy("id", "k").agg(depth.alias("depth")).select("id", F.get(known, F.col("k")).alias("class"), "depth")


def maximum_depth(queries: Curves, train: Curves, label: str) -> DataFrame:
    found = class_depths(queries, train, label)
    return found.groupBy("id").agg(F.min_by("class", F.struct(-F.round("depth", DEPTH_DIGITS), F.col("class"))).alias("predicted"))


def dd_points(queries: Curves, train: Curves, label: str) -> DataFrame:
    """``(id, depths)``: depths in the classes, in the order of their labels."""
    pairs = class_depths(queries, train, label).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("class", "depth"))).alias("p"))
    return pairs.select("id", F.transform("p", lambda x: x["depth"]).alias("depths"))


def ddg_classify(queries: Curves, train: Curves, label: str, k: int = 5) -> DataFrame:
    """Nearest neighbours in the plane of class depths."""
    from curvelake.meta import GridMeta

    fit = dd_points(train, train, label).join(train.df.select("id", label), "id")
    n = len(class_means(train, label)[0])
    meta = GridMeta.regular(n, 0, max(1, n - 1))
    as_curves = lambda df, *c: Curves(df.select("id", F.col("depths").alias("data"), *c), meta)
    return knn_classify(as_curves(dd_points(queries, train, label)), as_curves(fit, label), label, k)


def dd_classify(queries: Curves, train: Curves, label: str, degree: int = 1, sample: int = 400, seed: int = 0) -> DataFrame:
    """Two classes: the polynomial through the origin in the depth plane that separates a bounded sample best.

    Polynomials through every choice of ``degree`` sampled points are tried on at most ``sample`` training points.
    """
    from itertools import combinations

    points = dd_points(train, train, label).join(train.df.select("id", label), "id")
    got = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toPandas()
    names = sorted(got[label].unique())
    if len(names) != 2:
        raise ValueError("the depth-depth classifier separates two classes")
    d, y = np.stack(got["depths"]), (got[label] == names[1]).to_numpy()
    powers, best = np.arange(1, degree + 1), None
    for pick in combinations(range(min(len(d), 400 if degree == 1 else 40)), degree):
        m = d[list(pick), 0][:, None] ** powers
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        c = np.linalg.solve(m, d[list(pick), 1])
        above = d[:, 1] > d[:, :1] ** powers @ c
        for flip in (False, True):
            hit = np.mean((above ^ flip) == y)
            if best is None or hit > best[0]:
                best = (hit, c, flip)
    _, c, flip = best
    curve = sum((F.pow(F.get("depths", F.lit(0)), F.lit(float(k))) * float(v) for k, v in zip(powers, c)), F.lit(0.0))
    above = F.get("depths", F.lit(1)) > curve
    return dd_points(queries, train, label).select("id", F.when(above != F.lit(flip), F.lit(names[1])).otherwise(F.lit(names[0])).alias("predicted"))


def quadratic_discriminant(queries: Curves, train: Curves, label: str, regularizer: float = 0.0, covariance=None) -> DataFrame:
    """``(id, predicted)``: the Gaussian class of the largest score; the moments of all classes come from one pass.

    ``covariance`` may turn the sample covariance of a class into another matrix (for example of a kernel family).
    """
    fits = moments_by(train, label)
    names, fits = list(fits), list(fits.values())
    n = sum(f[0] for f in fits)
    parts = []
    for count, mean, scatter in fits:
        c = scatter / max(1, count - 1)
        c = (covariance(c) if covariance else c) + regularizer * np.eye(len(c))
        sign, logdet = np.linalg.slogdet(c)
        if sign <= 0:
            raise ValueError("a class covariance is singular; use a regularizer")
        parts.append((mean, np.linalg.inv(c), -0.5 * logdet + math.log(count / n)))
    size = queries.meta.size

    def score(batches):
        for b in batches:
            x = np.stack(b["data"]).astype(float) if len(b) else np.zeros((0, size))
            s = np.stack([k - 0.5 * np.einsum("ij,jk,ik->i", x - m, p, x - m) for m, p, k in parts], 1)
            yield pd.DataFrame({"id": b["id"], "k": s.argmax(1).astype("int32") if len(b) else []})

    found = queries.df.select("id", "data").mapInPandas(score, f"id {dict(queries.df.dtypes)['id']}, k int")
    return found.select("id", F.get(F.array(*[F.lit(g) for g in names]), F.col("k")).alias("predicted"))


def logistic(queries: Curves, train: Curves, label: str, max_features: int = 5, ridge: float = 1e-4, rounds: int = 25) -> DataFrame:
    """Two classes: grid points are added greedily by likelihood; each fit is Newton's method on summed moments.

    Every Newton step of all candidate points of a round is one pass over the curves: the tasks return gradients and
    Hessians of the size of the model, never rows.
    """
    names = [r[0] for r in train.df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    if len(names) != 2:
        raise ValueError("logistic regression separates two classes")
    size = train.meta.size
    rows = train.df.select("data", (F.col(label) == F.lit(names[1])).cast("double").alias("y")).cache()

    def newton(models: list[tuple[list[int], np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        d = len(models[0][1])

        def part(batches):
            total = np.zeros((len(models), 1 + d + d * d))
            for b in batches:
                if not len(b):
                    continue
                x, y = np.stack(b["data"]).astype(float), b["y"].to_numpy()
                for k, (points, beta) in enumerate(models):
                    z = np.column_stack([np.ones(len(x)), x[:, points]])
                    eta = np.clip(z @ beta, -30, 30)
                    p = 1 / (1 + np.exp(-eta))
                    total[k, 0] += (y * eta - np.log1p(np.exp(eta))).sum()
                    total[k, 1 : 1 + d] += z.T @ (y - p)
                    total[k, 1 + d :] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
            yield pd.DataFrame({"k": np.arange(len(models)), "s": list(total)})

        sums = rows.mapInPandas(part, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((len(models), 1 + d + d * d))
        out[sums["k"], sums["i"]] = sums["v"]
        return [(r[0], r[1 : 1 + d], r[1 + d :].reshape(d, d)) for r in out]

    chosen: list[int] = []
    beta = np.zeros(1)
    for _ in range(max_features):
        free = [i for i in range(size) if i not in chosen]
        models = [([*chosen, i], np.r_[beta, 0.0]) for i in free]
        for _ in range(2):
            got = newton(models)
            models = [(p, b + np.linalg.solve(h + ridge * np.eye(len(b)), g - ridge * b)) for (p, b), (_, g, h) in zip(models, got)]
        got = newton(models)
        best = max(range(len(models)), key=lambda k: got[k][0])
        chosen, beta = models[best]
    for _ in range(rounds):
        (_, g, h) = newton([(chosen, beta)])[0]
        step = np.linalg.solve(h + ridge * np.eye(len(beta)), g - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    rows.unpersist()
    line = sum((F.get("data", F.lit(int(i))) * float(b) for i, b in zip(chosen, beta[1:])), F.lit(float(beta[0])))
    return queries.df.select("id", F.when(line > 0, F.lit(names[1])).otherwise(F.lit(names[0])).alias("predicted"))

