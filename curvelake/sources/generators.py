"""Random sets of curves, made in the tasks from seeds of the ids; any number of curves in any order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta


def _made(spark: SparkSession, n: int, meta: GridMeta, seed: int, one) -> Curves:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "data": [one(np.random.default_rng([seed, int(i)])) for i in b["id"]]})

    return Curves(spark.range(n).mapInPandas(run, "id bigint, data array<double>"), meta)


def gaussian(spark: SparkSession, n: int, points, mean=0.0, cov=None, noise: float = 0.0, seed: int = 0) -> Curves:
    """Curves of a mean function and a covariance function on a grid."""
    meta = GridMeta.of(points)
    x = meta.points
    c = np.eye(len(x)) if cov is None else cov(x)
    values, vectors = np.linalg.eigh(c + noise * np.eye(len(x)))
    root = vectors * np.sqrt(np.maximum(values, 0))
    m = np.broadcast_to(mean(x) if callable(mean) else np.asarray(mean, float), x.shape)
    return _made(spark, n, meta, seed, lambda rng: m + root @ rng.standard_normal(len(x)))


def gaussian_process(spark: SparkSession, n: int, n_points: int = 100, low: float = 0.0, high: float = 1.0, **options) -> Curves:
    return gaussian(spark, n, np.linspace(low, high, n_points), **options)


def sinusoids(spark: SparkSession, n: int = 15, n_points: int = 100, low: float = 0.0, high: float = 1.0, period: float = 1.0, phase_mean: float = 0.0, phase_std: float = 0.6, amplitude_mean: float = 1.0, amplitude_std: float = 0.05, error_std: float = 0.2, seed: int = 0) -> Curves:
    """a sin(2 pi t / T + phase) + error, with random amplitude and phase; built-in functions only."""
    meta = GridMeta.regular(n_points, low, high)
    rows = spark.range(n).withColumn("a", F.randn(seed) * amplitude_std + amplitude_mean).withColumn("p", F.randn(seed + 1) * phase_std + phase_mean)
    noise = F.array(*[F.randn(seed + 2 + k) * error_std for k in range(n_points)])
    rows = rows.withColumn("e", noise)
    data = F.zip_with(constant(meta.points), "e", lambda t, e: F.col("a") * F.sin(t * (2 * math.pi / period) + F.col("p")) + e)
    return Curves(rows.select("id", data.alias("data")), meta)


def modes(spark: SparkSession, n: int = 15, n_modes: int = 1, low: float = -1.0, high: float = 1.0, std: float = 0.05, seed: int = 0) -> DataFrame:
    """``(id, landmarks)``: jittered equally spaced places."""
    at = np.linspace(low, high, n_modes + 2)[1:-1]
    return _made(spark, n, GridMeta.regular(max(2, n_modes)), seed, lambda rng: at + std * rng.standard_normal(n_modes)).df.withColumnRenamed("data", "landmarks")


def multimodal(spark: SparkSession, n: int = 15, n_modes: int = 1, n_points: int = 100, low: float = -1.0, high: float = 1.0, std: float = 0.05, mode_std: float = 0.02, noise: float = 0.0, seed: int = 0) -> Curves:
    """Sums of Gaussian bumps at jittered places."""
    meta = GridMeta.regular(n_points, low, high)
    x, at = meta.points, np.linspace(low, high, n_modes + 2)[1:-1]

    def one(rng):
        places = at + std * rng.standard_normal(n_modes)
        return np.exp(-((x[:, None] - places) ** 2) / (2 * mode_std)).sum(1) + noise * rng.standard_normal(len(x))

    return _made(spark, n, meta, seed, one)


def warpings(spark: SparkSession, n: int = 15, n_points: int = 100, low: float = 0.0, high: float = 1.0, sigma: float = 1.0, shape: float = 50.0, n_random: int = 4, seed: int = 0) -> Curves:
    """Random increasing maps of the domain onto itself: exponentials of random tangents of the unit sphere."""
    meta = GridMeta.regular(n_points, low, high)
    u = np.linspace(0, 1, n_points)
    size = 1 / math.sqrt(shape)

    def one(rng):
        tangent = sum(size * sigma * rng.standard_normal() * math.sqrt(2) * f(2 * math.pi * k * u) for k in range(1, n_random // 2 + 1) for f in (np.sin, np.cos))
        norm = math.sqrt(float(np.trapezoid(tangent**2, u))) or 1e-12
        psi = np.cos(norm) + np.sin(norm) / norm * tangent
        total = np.r_[0.0, np.cumsum((psi[1:] ** 2 + psi[:-1] ** 2) / 2)]
        return low + (high - low) * total / total[-1]

    return _made(spark, n, meta, seed, one)


def sde_paths(spark: SparkSession, n: int, initial, drift=None, diffusion=None, derivative=None, method: str = "euler-maruyama", n_points: int = 100, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Curves:
    """Paths of dX = drift(t, X) dt + diffusion(t, X) dW by Euler-Maruyama or, with the diffusion's derivative, Milstein."""
    if method not in ("euler-maruyama", "milstein"):
        raise ValueError("unknown method")
    if method == "milstein" and derivative is None:
        raise ValueError("Milstein's method needs the derivative of the diffusion")
    meta = GridMeta.regular(n_points, low, high)
    t = meta.points
    h = np.diff(t)
    mu = drift if callable(drift) else lambda s, x: 0.0 if drift is None else drift
    sd = diffusion if callable(diffusion) else lambda s, x: 1.0 if diffusion is None else diffusion

    def one(rng):
        x = np.empty(len(t))
        x[0] = initial(rng) if callable(initial) else initial
        for k in range(len(h)):
            w = math.sqrt(h[k]) * rng.standard_normal()
            x[k + 1] = x[k] + mu(t[k], x[k]) * h[k] + sd(t[k], x[k]) * w
            if method == "milstein":
                x[k + 1] += 0.5 * sd(t[k], x[k]) * derivative(t[k], x[k]) * (w * w - h[k])
        return x

    return _made(spark, n, meta, seed, one)


def irregular_sample(curves: Curves, k: int, seed: int = 0) -> Irregular:
    """k points of each curve, drawn by a hash of id and position."""
    points = constant(curves.meta.points)
    cells = F.transform("data", lambda c, i: F.struct(F.xxhash64(F.col("id"), i, F.lit(seed)).alias("h"), i.alias("i"), c.alias("v")))
    drawn = curves.df.select("id", F.explode(F.slice(F.array_sort(cells), 1, k)).alias("c"))
    return Irregular(drawn.select("id", F.get(points, F.col("c.i")).alias("t"), F.col("c.v").alias("v")), curves.meta.domain[0])

