"""Statistics across curves: one aggregation by grid point, combined in every task before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves
from curvelake.numerics import report_unfinished
from curvelake.operators.metrics import distances_to
from curvelake.operators.ranks import running_total


#: tasks that add up the parts of the others before the driver does, round by round
MERGE_TASKS = (64, 8)


def pointwise(curves: Curves, by: list[str] | None = None, **statistics: Column) -> DataFrame:
    """``(*by, pos, t, ...)``: aggregates of ``v`` at each grid point."""
    by = by or []
    out = curves.long(*by).groupBy(*by, "pos").agg(*[c.alias(k) for k, c in statistics.items()])
    return out.withColumn("t", F.get(constant(np.repeat(curves.meta.points, curves.meta.codomain)), F.col("pos"))) if len(curves.meta.axes) == 1 else out


def _strict(value: Column, skipna: bool, least: int = 0) -> Column:
    value = value if skipna else F.when(F.count("v") == F.count(F.lit(1)), value)
    return F.when(F.count("v") >= least, value) if least else value


def pointwise_sum(curves: Curves, skipna: bool = False, min_count: int = 0) -> DataFrame:
    """A missing value makes the sum missing unless ``skipna``; fewer than ``min_count`` values do too."""
    value = F.coalesce(F.sum("v"), F.lit(0.0)) if skipna else F.sum("v")
    return pointwise(curves, value=_strict(value, skipna, min_count))


def pointwise_mean(curves: Curves, skipna: bool = False) -> DataFrame:
    """The sum over the number of all curves, also with ``skipna``."""
    return pointwise(curves, value=_strict(F.coalesce(F.sum("v"), F.lit(0.0)) if skipna else F.sum("v"), skipna) / F.count(F.lit(1)))


def weighted_mean(curves: Curves, weight: str) -> DataFrame:
    """Sum of weight times value over the sum of the weights."""
    return curves.long(weight).groupBy("pos").agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("value"))


def pointwise_var(curves: Curves, correction: int = 0) -> DataFrame:
    return pointwise(curves, value=F.var_samp("v") if correction else F.var_pop("v"))


def pointwise_std(curves: Curves, correction: int = 0) -> DataFrame:
    return pointwise(curves, value=F.stddev_samp("v") if correction else F.stddev_pop("v"))


def geometric_mean(curves: Curves) -> DataFrame:
    """Values of 0 give 0; a negative value makes the mean missing."""
    value = F.when(F.min("v") > 0, F.exp(F.avg(F.when(F.col("v") > 0, F.ln("v"))))).when(F.min("v") == 0, F.lit(0.0))
    return pointwise(curves, value=value)


def moments(curves: Curves, condition: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred sum of products): one matrix a task, added up in pairs; curves with missing cells are left out.

    Only the sums, of the size of the grid squared, leave the tasks.
    """
    size = curves.meta.size
    df = curves.df.where(F.forall("data", lambda x: x.isNotNull()))
    df = df if condition is None else df.where(condition)
    rows = df.select("data")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, scatter = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["data"])
            m, c = x.mean(0), x - x.mean(0)
            shift, total = m - mean, n + len(x)
            scatter += c.T @ c + np.outer(shift, shift) * (n * len(x) / total)
            mean, n = mean + shift * len(x) / total, total
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean], "scatter": [scatter.ravel()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = add_moments(((r.n, r.mean, r.scatter) for b in batches for r in b.itertuples(index=False)), size)
        if done[0]:
            yield pd.DataFrame({"n": [done[0]], "mean": [done[1]], "scatter": [done[2].ravel()]})

    schema = "n bigint, mean array<double>, scatter array<double>"
    few = rows.mapInPandas(part, schema)
    for n in MERGE_TASKS:
        few = few.repartition(n).mapInPandas(merge, schema)
    few = few.collect()  # a row a merging task
    return add_moments(((r["n"], r["mean"], r["scatter"]) for r in few), size)


def moments_by(curves: Curves, label: str) -> dict:
    """``moments`` of every class, by its name in order: one pass, one matrix a task and class; curves without a class are left out."""
    size = curves.meta.size
    df = curves.df.where(F.col(label).isNotNull() & F.forall("data", lambda x: x.isNotNull()))
    schema = f"g {dict(df.select(label).dtypes)[label]}, n bigint, mean array<double>, scatter array<double>"

    def rows(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({"g": list(sums), "n": [s[0] for s in sums.values()], "mean": [s[1] for s in sums.values()], "scatter": [s[2].ravel() for s in sums.values()]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for g, own in b.groupby("g", sort=False):
                x = np.stack(own["data"])
                c = x - x.mean(0)
                one = (len(x), x.mean(0), c.T @ c)
                sums[g] = add_moments([sums[g], one], size) if g in sums else one
        if sums:
            yield rows(sums)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for r in b.itertuples(index=False):
                one = (r.n, np.asarray(r.mean, float), np.asarray(r.scatter, float))
                sums[r.g] = add_moments([sums[r.g], one], size) if r.g in sums else one
        if sums:
            yield rows(sums)

    few = df.select(F.col(label).alias("g"), "data").mapInPandas(part, schema)
    for n in MERGE_TASKS:
        few = few.repartition(n).mapInPandas(merge, schema)
    found: dict = {}
    for r in few.collect():  # a row a class and merging task
        found.setdefault(r["g"], []).append((r["n"], r["mean"], r["scatter"]))
    return {g: add_moments(found[g], size) for g in sorted(found)}


def add_moments(parts, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred sums of products of several parts, added up."""
    n, mean, scatter = 0, np.zeros(size), np.zeros((size, size))
    for k, m, s in parts:
        total = n + int(k)
        shift = np.asarray(m, float) - mean
        scatter = scatter + np.asarray(s, float).reshape(size, size) + np.outer(shift, shift) * (n * int(k) / total)
        mean, n = mean + shift * int(k) / total, total
    return n, mean, scatter


def added(parts: DataFrame, column: str) -> np.ndarray | None:
    """Sum of an ``array<double>`` column, one row a task, cell by cell; None without rows."""
    cells = parts.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # a row a cell
    return np.array([r["v"] for r in cells], float) if cells else None


def covariance(curves: Curves, correction: int = 0) -> np.ndarray:
    n, _, scatter = moments(curves)
    return scatter / max(1, n - correction)


def covariance_frame(curves: Curves, correction: int = 0) -> DataFrame:
    """``(s, t, value)``: covariance of the values at positions s and t, from the summed products."""
    c = covariance(curves, correction)
    i, j = np.indices(c.shape)
    return curves.df.sparkSession.createDataFrame(pd.DataFrame({"s": i.ravel(), "t": j.ravel(), "value": c.ravel()}))


def cumulative_sum(curves: Curves) -> DataFrame:
    """``(id, pos, value)``: sums over the curves up to each id, in the order of ids.

    Cells are range-partitioned by point and id; a range is summed by itself and moved by the totals of those before it.
    """
    return running_total(curves.long().select("id", "pos", "v"), "pos", "id", "v").select("id", "pos", F.col("upto").alias("value"))


def spread(curves: Curves) -> float:
    """Root of the integrated variance: the root mean squared L2 distance to the mean."""
    rows = curves.long().groupBy("pos").agg(F.var_pop("v").alias("s")).where("s is not null").collect()
    return float(np.sqrt(max(0.0, sum(curves.weights()[r["pos"]] * r["s"] for r in rows))))


def geometric_median(curves: Curves, tolerance: float = 1e-8, max_iter: int = 100) -> np.ndarray:
    """Weiszfeld iteration from the mean; each round is one aggregation of the weighted curves.

    It ends when the median moves less than ``tolerance`` of the curves' spread.
    """
    least = tolerance * spread(curves)
    at = np.array([r["value"] for r in pointwise_mean(curves, skipna=True).orderBy("pos").collect()])
    for _ in range(max_iter):
        near = distances_to(curves, at, "d").where("d is not null")
        w = 1 / F.greatest(F.col("d"), F.lit(1e-12))
        rows = near.select(w.alias("w"), F.posexplode("data").alias("pos", "v")).groupBy("pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).orderBy("pos").collect()
        new = np.array([r["m"] for r in rows])
        moved = np.sqrt(np.dot(curves.weights(), (new - at) ** 2))
        at = new
        if moved <= least:
            break
    else:
        report_unfinished("the geometric median", max_iter, moved, least)
    return at
