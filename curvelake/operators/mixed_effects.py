"""Sparse irregular curves in a basis by a linear mixed-effects model, fitted by expectation maximisation.

    v_i = B_i (beta + gamma_i) + noise,   gamma_i ~ N(0, G),   noise ~ N(0, s2)

A round is one pass: every curve's basis values are grouped once, and the tasks return sums of the size of the
basis. Curves are grouped whole, so one curve must fit a task; measurements of a curve are few in this setting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.basis import Basis
from curvelake.frames import BasisCurves, Irregular
from curvelake.numerics import report_unfinished
from curvelake.operators.stats import added
from curvelake.session import checkpoint


@dataclass(frozen=True)
class MixedEffects:
    basis: Basis
    beta: np.ndarray
    cov: np.ndarray
    noise: float
    rounds: int

    def transform(self, curves: Irregular) -> BasisCurves:
        """Best linear unbiased coefficients of each curve; a curve without values gets the mean."""
        grouped = _grouped(curves)
        kind = f"id {dict(grouped.dtypes)['id']}, coef array<double>"

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "coef": [self.beta + _posterior(self, np.asarray(t, float), np.asarray(v, float))[0] for t, v in zip(b["t"], b["v"])]})

        return BasisCurves(grouped.mapInPandas(run, kind), self.basis)


def _grouped(curves: Irregular) -> DataFrame:
    points = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("t", "v"))))
    return curves.df.groupBy("id").agg(points.alias("p")).select("id", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def _posterior(m: MixedEffects, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance) of gamma given a curve, and its summed expected squared noise."""
    if not len(t):
        return np.zeros(len(m.beta)), m.cov, 0.0
    b = m.basis(t)
    r = v - b @ m.beta
    s = b @ m.cov @ b.T + m.noise * np.eye(len(t))
    gain = np.linalg.solve(s, b @ m.cov).T
    mean, cov = gain @ r, m.cov - gain @ b @ m.cov
    off = r - b @ mean
    return mean, cov, float(off @ off + np.trace(b @ cov @ b.T))


def fit_mixed_effects(curves: Irregular, basis: Basis, max_iter: int = 100, tol: float = 1e-4) -> MixedEffects:
    p = basis.n_basis
    grouped = checkpoint(_grouped(curves).where(F.size("t") > 0))
    start = curves.df.agg(F.var_pop("v").alias("s")).first()["s"] or 1.0
    model = MixedEffects(basis, np.zeros(p), np.eye(p) * start, start, 0)
    for k in range(1, max_iter + 1):

        def part(batches, model=model):
            sums = np.zeros(3 + 2 * p * p + p)
            for b in batches:
                for t, v in zip(b["t"], b["v"]):
                    t, v = np.asarray(t, float), np.asarray(v, float)
                    mean, cov, noise = _posterior(model, t, v)
                    x = basis(t)
                    # generalised least squares for beta: much faster than a step of its own expectation
                    w = np.linalg.solve(x @ model.cov @ x.T + model.noise * np.eye(len(t)), np.column_stack([x, v]))
                    sums += np.r_[1, len(t), (cov + np.outer(mean, mean)).ravel(), (x.T @ w[:, :-1]).ravel(), x.T @ w[:, -1], noise]
            yield pd.DataFrame({"s": [sums]})

        total = added(grouped.mapInPandas(part, "s array<double>"), "s")
        total = np.zeros(3 + 2 * p * p + p) if total is None else total
        n, m = total[0], total[1]
        if not n:
            raise ValueError("no curve has a value")
        cov = total[2 : 2 + p * p].reshape(p, p) / n
        gram = total[2 + p * p : 2 + 2 * p * p].reshape(p, p)
        beta = np.linalg.lstsq(gram, total[2 + 2 * p * p : -1], rcond=None)[0]
        new = MixedEffects(basis, beta, (cov + cov.T) / 2, max(total[-1] / m, 1e-12), k)
        moved = max(np.abs(new.beta - model.beta).max() / max(1e-12, np.abs(new.beta).max()), abs(new.noise - model.noise) / model.noise)
        model = new
        if moved < tol:
            break
    else:
        report_unfinished("the mixed-effects model", max_iter, moved, tol)
    return model
