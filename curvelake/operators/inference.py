"""Tests of hypotheses about groups of curves."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.frames import Curves
from curvelake.operators.stats import moments, moments_by


def _groups(curves: Curves, label: str) -> dict:
    """(n, mean, scatter) of every group: one row a task of grid-sized sums each."""
    groups = moments_by(curves, label)
    if len(groups) < 2:
        raise ValueError("at least two groups are needed")
    return groups


def v_statistic(means: list[np.ndarray], sizes, weights, p: float = 2) -> float:
    """Sum over pairs i < j of n_i ||m_i - m_j||^p"""
    if len(means) != len(sizes):
        raise ValueError("one size is needed for each mean")
    norm = lambda f: (np.abs(f) ** p @ weights) ** (1 / p) if p != 2 else np.sqrt(max(0.0, f * f @ weights))
    return float(sum(sizes[i] * norm(means[i] - means[j]) ** p for i in range(len(means)) for j in range(i + 1, len(means))))


def v_asymptotic(means: list[np.ndarray], sizes, weights, p: float = 2) -> float:
    """Sum over pairs i < j of ||m_i - m_j sqrt(n_i / n_j)||^p"""
    if len(means) != len(sizes) or 0 in list(sizes):
        raise ValueError("one non-zero size is needed for each mean")
    norm = lambda f: (np.abs(f) ** p @ weights) ** (1 / p)
    return float(sum(norm(means[i] - means[j] * np.sqrt(sizes[i] / sizes[j])) ** p for i in range(len(means)) for j in range(i + 1, len(means))))


def group_statistic(curves: Curves, label: str) -> DataFrame:
    """``statistic``: V of the group means, as joins of one row a group and grid point."""
    sizes = curves.df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    means = curves.long(label).groupBy(label, "pos").agg(F.avg("v").alias("m")).join(sizes, label)
    other = means.select(F.col(label).alias("_other"), "pos", F.col("m").alias("m2"))
    from curvelake.columns import constant

    w = F.get(constant(curves.weights()), F.col("pos"))
    d = F.col("m") - F.col("m2")
    return means.join(other, "pos").where(F.col(label) < F.col("_other")).agg(F.sum(F.col("n") * d * d * w).alias("statistic"))


def oneway_anova(curves: Curves, label: str, n_reps: int = 2000, equal_var: bool = True, p: float = 2, seed: int = 0) -> tuple[float, float]:
    """(statistic, p-value) by the parametric bootstrap of Gaussian group means; repetitions run on the tasks."""
    if n_reps < 1:
        raise ValueError("at least one repetition is needed")
    groups = list(_groups(curves, label).values())
    sizes, w = [g[0] for g in groups], curves.weights()
    statistic = v_statistic([g[1] for g in groups], sizes, w, p)
    if equal_var:
        pooled = sum(g[2] for g in groups) / (sum(sizes) - len(groups))
        covs = [pooled] * len(groups)
    else:
        covs = [g[2] / (n - 1) for g, n in zip(groups, sizes)]
    roots = []
    for c in covs:
        values, vectors = np.linalg.eigh(c)
        roots.append(vectors * np.sqrt(np.maximum(values, 0)))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                out.append(v_asymptotic([r @ rng.standard_normal(r.shape[1]) for r in roots], sizes, w, p))
            yield pd.DataFrame({"s": out})

    share = curves.df.sparkSession.range(n_reps).mapInPandas(simulate, "s double").agg(F.avg((F.col("s") > statistic).cast("double"))).first()[0]
    return statistic, float(share)


def _t2(n1, m1, s1, n2, m2, s2, weights) -> float:
    n = n1 + n2
    root = np.sqrt(np.maximum(weights, 0))
    pooled = (s1 + s2) / (n - 2) * root[:, None] * root[None]
    m = (m1 - m2) * root
    return float(n1 * n2 / n * m @ np.linalg.pinv(pooled, rcond=1e-10, hermitian=True) @ m)


def hotelling_t2(first: Curves, second: Curves) -> float:
    """n1 n2 / n of the squared Mahalanobis distance of the means under the pooled covariance operator."""
    first._same_grid(second)
    return _t2(*moments(first), *moments(second), np.ones(first.meta.size))


def hotelling_test(first: Curves, second: Curves, n_reps: int | None = None, seed: int = 0, limit: int = 20_000) -> tuple[float, float]:
    """(statistic, p-value): share of relabellings with a greater statistic, all of them if ``n_reps`` is None.

    The relabelled samples go to every task, so both together may hold at most ``limit`` curves.
    """
    if n_reps is not None and n_reps < 1:
        raise ValueError("at least one repetition is needed")
    a, b = [np.stack(c.df.orderBy("id").limit(limit + 1).toPandas()["data"]) for c in (first, second)]
    if len(a) + len(b) > limit:
        raise ValueError(f"a permutation test takes at most {limit} curves")
    x, n1 = np.vstack([a, b]), len(a)
    one = np.ones(x.shape[1])

    def statistic(pick: np.ndarray) -> float:
        rest = np.setdiff1d(np.arange(len(x)), pick)
        p, q = x[pick], x[rest]
        return _t2(len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0)), len(q), q.mean(0), (q - q.mean(0)).T @ (q - q.mean(0)), one)

    base = statistic(np.arange(n1))
    if n_reps is None:
        if comb(len(x), n1) > 1_000_000:
            raise ValueError("too many relabellings; give n_reps")
        all_picks = list(combinations(range(len(x)), n1))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                pick = np.array(all_picks[i]) if n_reps is None else np.sort(np.random.default_rng([seed, int(i)]).permutation(len(x))[:n1])
                out.append(statistic(pick))
            yield pd.DataFrame({"s": out})

    reps = len(all_picks) if n_reps is None else n_reps
    share = first.df.sparkSession.range(reps).mapInPandas(simulate, "s double").agg(F.avg((F.col("s") > base + 1e-9).cast("double"))).first()[0]
    return base, float(share)
