"""Alignment of curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant, dot
from curvelake.frames import Curves
from curvelake.numerics import difference_matrix, linear_matrix, pchip, report_unfinished, simpson_weights
from curvelake.operators.metrics import matrix_of
from curvelake.operators.stats import moments
from curvelake.session import checkpoint


def landmark_deltas(curves: Curves, landmark: str, location: float | None = None) -> DataFrame:
    """``(id, delta)``: landmark less location (by default the mean landmark)."""
    rows = curves.df.select("id", F.col(landmark).cast("double").alias("m"))
    if location is not None:
        return rows.select("id", (F.col("m") - location).alias("delta"))
    return rows.join(F.broadcast(rows.agg(F.avg("m").alias("c")))).select("id", (F.col("m") - F.col("c")).alias("delta"))


def landmark_shift(curves: Curves, landmark: str, location: float | None = None, extrapolation: str | None = None) -> Curves:
    both = curves.df.join(landmark_deltas(curves, landmark, location), "id")
    return curves.with_df(curves.with_df(both).shift(F.col("delta"), extrapolation).df.drop("delta"))


def _per_curve(curves: Curves, columns: list[str], work, out: str = "data") -> DataFrame:
    """Each batch of curves through ``work(frame, matrix) -> matrix``."""
    kind = f"id {dict(curves.df.dtypes)['id']}, {out} array<double>"
    size = curves.meta.size

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], out: list(work(b, matrix_of(b["data"], size))) if len(b) else []})

    return curves.df.select("id", "data", *columns).mapInPandas(run, kind)


def landmark_warping(curves: Curves, landmarks: str, location: list[float] | None = None) -> Curves:
    """Monotone warpings through (location, landmark) with fixed ends; ``landmarks`` is an array column."""
    if location is None:
        location = [r[0] for r in curves.df.select(F.posexplode(landmarks).alias("k", "m")).groupBy("k").agg(F.avg("m").alias("m")).orderBy("k").select("m").collect()]
    (low, high), t = curves.meta.domain[0], curves.meta.points
    knots = np.r_[low, location, high]

    def work(b, x):
        return [pchip(knots, np.r_[low, np.asarray(m, float), high], t) for m in b[landmarks]]

    return Curves(_per_curve(curves, [landmarks], work), curves.meta)


def landmark_registration(curves: Curves, landmarks: str, location: list[float] | None = None) -> Curves:
    return curves.compose(landmark_warping(curves, landmarks, location))


def invert_warping(warping: Curves) -> Curves:
    """The monotone cubic through the swapped points, on the same grid."""
    t = warping.meta.points
    return Curves(_per_curve(warping, [], lambda b, x: [pchip(r, t, np.clip(t, r[0], r[-1])) for r in x]), warping.meta)


def undo_warping(registered: Curves, warping: Curves) -> Curves:
    """The curves before registration: registered ones composed with the inverse of their warpings, by id."""
    return registered.compose(invert_warping(warping))


def undo_shift(registered: Curves, deltas: DataFrame, extrapolation: str | None = None) -> Curves:
    """The curves before a registration by shifts ``deltas (id, delta)``."""
    both = registered.with_df(registered.df.join(deltas.select("id", F.col("delta").alias("_delta")), "id"))
    return registered.with_df(both.shift(-F.col("_delta"), extrapolation).df.drop("_delta"))


def normalise_warping(warping: Curves, low: float = 0.0, high: float = 1.0) -> Curves:
    """Values and arguments rescaled to [low, high], ends exact."""
    first, last = F.get("data", F.lit(0)), F.element_at("data", F.lit(-1))
    a, b = warping.meta.domain[0]
    points = low + (warping.meta.points - a) / (b - a) * (high - low)
    rows = warping.df.withColumn("_a", first).withColumn("_b", last)
    data = F.transform("data", lambda v: F.when(v == F.col("_b"), F.lit(high)).otherwise(low + (v - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low)))
    return Curves(rows.withColumn("data", data).drop("_a", "_b"), warping.meta.with_points(points, domain=((low, high),)))


def least_squares_shift(curves: Curves, max_iter: int = 5, tol: float = 1e-2, step: float = 1.0, template: np.ndarray | None = None) -> DataFrame:
    """``(id, delta)``: Newton steps of each curve's shift towards the template (by default the mean of the shifted curves).

    Deltas stay in the frame; a round is one pass that shifts, compares and updates. ``tol`` is in units of the argument.
    """
    x, w = curves.meta.points, curves.weights()
    slope = difference_matrix(x)
    now = curves.df.select("id", "data", F.lit(0.0).alias("delta"))
    kind = f"id {dict(curves.df.dtypes)['id']}, data array<double>, delta double, moved double"
    for _ in range(max_iter):
        shifted = Curves(now, curves.meta).shift(F.col("delta"))
        goal = moments(shifted)[1] if template is None else np.asarray(template, float)

        def update(batches, goal=goal):
            for b in batches:
                data, delta = matrix_of(b["data"], len(x)), b["delta"].to_numpy()
                at = np.stack([linear_matrix(x, x + d) @ r for d, r in zip(delta, data)]) if len(b) else data
                deriv = data @ slope.T
                move = step * ((at - goal) * deriv) @ w / np.maximum(deriv**2 @ w, 1e-300)
                yield pd.DataFrame({"id": b["id"], "data": list(data), "delta": delta - move, "moved": np.abs(move)})

        done = checkpoint(now.mapInPandas(update, kind))
        most = done.agg(F.max("moved")).first()[0] or 0.0
        now = done.select("id", "data", "delta")
        if most <= tol:
            break
    else:
        report_unfinished("shift registration", max_iter, most, tol)
    return now.select("id", "delta")


def align_to_template(f: np.ndarray, template: np.ndarray, t: np.ndarray, penalty: float = 0.0, grid: int = 7) -> np.ndarray:
    """The warping that brings the square-root slopes of f closest to the template's, by dynamic programming.

    Slopes between neighbouring grid points are ratios of steps up to ``grid``.
    """
    return align_rows(np.asarray(f, float)[None], template, t, penalty, grid)[0]


def align_rows(f: np.ndarray, template: np.ndarray, t: np.ndarray, penalty: float = 0.0, grid: int = 7) -> np.ndarray:
    """``align_to_template`` of every row of f; a step of the recursion takes all rows of a slice of bounded memory."""
    n = len(t)
    steps = [(a, b) for a in range(1, grid + 1) for b in range(1, grid + 1) if np.gcd(a, b) == 1]
    rows = max(1, 4_000_000 // (n * sum(a for a, _ in steps)))
    return np.concatenate([_align(f[k : k + rows], template, t, penalty, steps) for k in range(0, len(f), rows)]) if len(f) else np.zeros((0, n))


def _align(f: np.ndarray, template: np.ndarray, t: np.ndarray, penalty: float, steps: list[tuple[int, int]]) -> np.ndarray:
    n, rows = len(t), len(f)
    slope = difference_matrix(t)
    root = lambda v: np.sign(v) * np.sqrt(np.abs(v))
    q1, q2 = root(slope @ template), root(slope @ f.T)  # grid points before rows
    moved = []  # of each step, the slopes of f at its parts, scaled by it
    for a, b in steps:
        parts = []
        for m in range(a):
            at = np.arange(n - b) + m * (b / a)
            low = np.minimum(at.astype(int), n - 2)
            parts.append(np.sqrt(b / a) * (q2[low] + (q2[low + 1] - q2[low]) * (at - low)[:, None]))
        moved.append(parts)
    cost, back = np.full((n, n, rows), np.inf), np.zeros((n, n, rows), np.int32)
    cost[0, 0] = 0
    step = (t[-1] - t[0]) / (n - 1)
    for i in range(1, n):
        for k, (a, b) in enumerate(steps):
            if i - a < 0 or b >= n:
                continue
            total = np.zeros((n - b, rows))
            for m in range(a):
                total += (q1[i - a + m] - moved[k][m]) ** 2 + penalty * (1 - np.sqrt(b / a)) ** 2
            new = cost[i - a, : n - b] + total * step
            better = new < cost[i, b:]
            cost[i, b:][better], back[i, b:][better] = new[better], k
    out = np.empty((rows, n))
    for r in range(rows):
        i, j, path = n - 1, n - 1, [(n - 1, n - 1)]
        while i > 0 or j > 0:
            a, b = steps[back[i, j, r]] if np.isfinite(cost[i, j, r]) else (min(1, i), min(1, j))
            i, j = max(0, i - a), max(0, j - b)
            path.append((i, j))
        path = np.array(path[::-1])
        out[r] = np.interp(t, t[path[:, 0]], t[path[:, 1]])
    return out


def elastic_warpings(curves: Curves, template: np.ndarray, penalty: float = 0.0, grid: int = 7) -> Curves:
    t = curves.meta.points
    return Curves(_per_curve(curves, [], lambda b, x: align_rows(x, template, t, penalty, grid)), curves.meta)


def elastic_registration(curves: Curves, template: np.ndarray | None = None, penalty: float = 0.0, grid: int = 7) -> Curves:
    if template is None:  # its rounds read the curves again and again
        curves = curves.with_df(checkpoint(curves.df))
        template = karcher_mean(curves, penalty, grid=grid)
    return curves.compose(elastic_warpings(curves, template, penalty, grid))


def karcher_mean(curves: Curves, penalty: float = 0.0, max_iter: int = 20, tol: float = 1e-3, grid: int = 7) -> np.ndarray:
    """The elastic mean: align to the mean of the slopes, average, until it stays."""
    t = curves.meta.points
    mean = moments(curves)[1]
    for _ in range(max_iter):
        aligned = curves.compose(elastic_warpings(curves, mean, penalty, grid))
        new = moments(aligned)[1]
        moved = np.sqrt(np.dot(curves.weights(), (new - mean) ** 2)) / max(1e-300, np.sqrt(np.dot(curves.weights(), mean**2)))
        mean = new
        if moved < tol:
            break
    else:
        report_unfinished("the elastic mean", max_iter, moved, tol)
    return mean


def amplitude_phase(original: Curves, registered: Curves) -> dict[str, float]:
    """Amplitude and phase parts of the mean squared error, and the share of the phase."""
    w = original.weights()
    sq = lambda c: c.df.select(dot(F.transform("data", lambda x: x * x), w).alias("s")).agg(F.sum("s")).first()[0]
    (n, m_x, _), (_, m_y, s_y) = moments(original), moments(registered)
    total_x, total_y = sq(original), sq(registered)
    ratio = total_x / total_y
    amplitude = ratio * float(np.diag(s_y) @ w) / n
    phase = ratio * float(m_y**2 @ w) - float(m_x**2 @ w)
    return {"ratio": ratio, "amplitude": amplitude, "phase": phase, "r2": phase / (phase + amplitude)}


def least_squares_score(original: Curves, registered: Curves) -> float:
    """One less the mean ratio of squared distances to leave-one-out means."""
    w = constant(original.weights())
    (n, m_x, _), (_, m_y, _) = moments(original), moments(registered)

    def off(mean):
        return lambda d: F.aggregate(F.zip_with(F.zip_with(d, constant(mean), lambda x, m: x - m), w, lambda x, v: x * x * v), F.lit(0.0), lambda a, x: a + x)

    both = original.df.select("id", off(m_x)("data").alias("a")).join(registered.df.select("id", off(m_y)("data").alias("b")), "id")
    return 1 - both.agg(F.avg(F.try_divide("b", "a"))).first()[0]


def sobolev_score(original: Curves, registered: Curves) -> float:
    """One less the ratio of the summed squared distances of the slopes to their means."""
    w = original.weights()
    part = lambda c: float(np.diag(moments(c.derivative())[2]) @ w)
    return 1 - part(registered) / part(original)


def pairwise_correlation(original: Curves, registered: Curves) -> float:
    """Ratio of the summed correlations of all pairs, from sums over standardised curves (no pair is formed)."""
    def summed(c: Curves) -> float:
        n = c.meta.size
        mean = F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / n
        rows = c.df.withColumn("_m", mean).withColumn("_c", F.transform("data", lambda x: x - F.col("_m")))
        size = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
        unit = rows.select("id", F.transform("_c", lambda x: x / size).alias("data"))
        count = unit.count()
        sums = unit.select(F.posexplode("data").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
        return sums - count

    return summed(registered) / summed(original)


def warping_distance(a: Curves, b: Curves) -> DataFrame:
    """``(id, distance)``: arc between the square roots of the slopes of two warpings of [0, 1]."""
    root = lambda c: normalise_warping(c).derivative().map(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))
    inner = (root(a) * root(b)).integrate()
    return inner.select("id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("integral")))).alias("distance"))


def phase_distance(warping: Curves) -> DataFrame:
    """``(id, distance)``: arc between a warping and the identity."""
    root = normalise_warping(warping).derivative().map(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))
    return root.integrate().select("id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("integral")))).alias("distance"))


def amplitude_distance(a: Curves, b: Curves, penalty: float = 0.0, grid: int = 7) -> DataFrame:
    """``(id, distance)``: distance of the square-root slopes of the curves of one id, b aligned to a, the domain scaled to [0, 1]."""
    a._same_grid(b)
    low, high = a.meta.domain[0]
    t = (a.meta.points - low) / (high - low)
    w, slope, size = simpson_weights(t), difference_matrix(t), a.meta.size
    root = lambda v: np.sign(v) * np.sqrt(np.abs(v))
    kind = f"id {dict(a.df.dtypes)['id']}, distance double"

    def run(batches):
        for batch in batches:
            out = []
            for f, g in zip(matrix_of(batch["data"], size), matrix_of(batch["_other"], size)):
                moved = np.interp(align_to_template(g, f, t, penalty, grid), t, g)
                out.append(float(np.sqrt(np.dot(w, (root(slope @ f) - root(slope @ moved)) ** 2))))
            yield pd.DataFrame({"id": batch["id"], "distance": np.array(out, float)})

    return a.df.select("id", "data").join(b.df.select("id", F.col("data").alias("_other")), "id").mapInPandas(run, kind)


def warping_mean(warpings: Curves, tol: float = 1e-6, max_iter: int = 50) -> np.ndarray:
    """The mean of warpings on the sphere of their square-root slopes, on their grid.

    Each round is one aggregation of the tangent vectors; it ends when their mean is shorter than ``tol``.
    """
    t, (low, high) = warpings.meta.points, warpings.meta.domain[0]
    unit = normalise_warping(warpings)
    w = unit.weights()
    slopes = unit.derivative().map(lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))
    slopes = slopes.with_df(checkpoint(slopes.df.where(F.forall("data", lambda x: x.isNotNull())).select("id", "data")))
    mean = np.ones(len(t))
    for _ in range(max_iter):
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("data"), w * mean))))
        rows = slopes.df.withColumn("_a", angle).withColumn("_s", F.when(F.col("_a") > 1e-9, F.col("_a") / F.sin("_a")).otherwise(F.lit(1.0)))
        tangent = rows.select(F.posexplode(F.zip_with("data", constant(mean), lambda x, m: F.col("_s") * (x - F.cos("_a") * m))).alias("pos", "v"))
        v = np.array([r["v"] for r in tangent.groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos").collect()])
        if not len(v):
            raise ValueError("no warping is complete")
        length = float(np.sqrt(np.dot(w, v * v)))
        if length < tol:
            break
        mean = np.cos(length) * mean + np.sin(length) * v / length
    else:
        report_unfinished("the mean warping", max_iter, length, tol)
    step = np.diff(t) / (t[-1] - t[0])
    made = np.r_[0, np.cumsum((mean[1:] ** 2 + mean[:-1] ** 2) / 2 * step)]
    return low + (high - low) * made / made[-1]
