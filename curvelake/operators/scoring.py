"""Scores of predicted curves and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import BasisCurves, Curves, Irregular

TINY = 2.220446049250313e-16


def _cells(true: Curves, pred: Curves, weight: str | None) -> DataFrame:
    true._same_grid(pred)
    a = true.long(*([weight] if weight else [])).withColumnRenamed("v", "y")
    b = pred.long().withColumnRenamed("v", "p")
    both = a.join(b, ["id", "pos"])
    return both.withColumn("w", F.col(weight).cast("double") if weight else F.lit(1.0))


def _mean(x: Column) -> Column:
    return F.sum(x * F.col("w")) / F.sum("w")


def _finish(points: DataFrame, curves: Curves, raw: bool) -> DataFrame:
    if raw:
        return points
    w = F.get(constant(curves.weights() / curves.length()), F.col("pos"))
    return points.agg(F.sum(F.col("score") * w).alias("score"))


def pointwise_error(true: Curves, pred: Curves, kind: str = "squared", weight: str | None = None, root: bool = False, raw: bool = False) -> DataFrame:
    """``score``: mean over curves at each point, averaged over the domain; ``raw`` gives ``(pos, score)``.

    kind: absolute, percentage, squared, squared_log. The root is taken point by point, before averaging.
    """
    y, p = F.col("y"), F.col("p")
    if kind == "squared_log":
        check = lambda c: F.when(c < 0, F.raise_error(F.lit("squared log error takes no negative values"))).otherwise(c)
        y, p = check(y), check(p)
    error = {
        "absolute": lambda: F.abs(y - p), "percentage": lambda: F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY)),
        "squared": lambda: (y - p) * (y - p), "squared_log": lambda: F.pow(F.log1p(y) - F.log1p(p), F.lit(2.0)),
    }[kind]()
    value = _mean(error)
    return _finish(_cells(true, pred, weight).groupBy("pos").agg((F.sqrt(value) if root else value).alias("score")), true, raw)


def _ratio(part: Column, whole: Column) -> Column:
    """1 - part / whole; 1 for 0 / 0 and minus infinity for a positive part of nothing."""
    return F.when((part == 0) & (whole == 0), 1.0).when(whole == 0, float("-inf")).otherwise(1 - F.try_divide(part, whole))


def _second(x: Column) -> Column:
    return F.greatest(F.lit(0.0), _mean(x * x) - _mean(x) * _mean(x))


def explained_variance(true: Curves, pred: Curves, weight: str | None = None, raw: bool = False) -> DataFrame:
    cells = _cells(true, pred, weight)
    e, y = F.col("y") - F.col("p"), F.col("y")
    return _finish(cells.groupBy("pos").agg(_second(e).alias("a"), _second(y).alias("b")).select("pos", _ratio(F.col("a"), F.col("b")).alias("score")), true, raw)


def r2(true: Curves, pred: Curves, weight: str | None = None, raw: bool = False) -> DataFrame:
    cells = _cells(true, pred, weight)
    e, y = F.col("y") - F.col("p"), F.col("y")
    return _finish(cells.groupBy("pos").agg(_mean(e * e).alias("a"), _second(y).alias("b")).select("pos", _ratio(F.col("a"), F.col("b")).alias("score")), true, raw)


def basis_score(true: BasisCurves, pred: BasisCurves, kind: str = "squared", points: int = 501) -> DataFrame:
    """``score`` of curves in bases, on a fine grid of their domain: a kind of ``pointwise_error``, ``r2`` or ``explained``."""
    at = np.linspace(*true.basis.domain, points)
    a, b = true.to_grid(at), pred.to_grid(at)
    return {"r2": r2, "explained": explained_variance}[kind](a, b) if kind in ("r2", "explained") else pointwise_error(a, b, kind)


def irregular_error(true: Irregular, pred: Irregular, kind: str = "squared") -> DataFrame:
    """``score``: the average over each curve's own range by the trapezoid rule, then over curves.

    kind: as of ``pointwise_error``.
    """
    error = {
        "squared": lambda y, p: (y - p) * (y - p), "absolute": lambda y, p: F.abs(y - p),
        "percentage": lambda y, p: F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY)), "squared_log": lambda y, p: F.pow(F.log1p(y) - F.log1p(p), F.lit(2.0)),
    }[kind]
    off = true.combine(pred, error)
    span = off.df.groupBy("id").agg((F.max("t") - F.min("t")).alias("span"), F.avg("v").alias("flat"))
    each = off.trapezoid().join(span, "id").select(F.when(F.col("span") > 0, F.col("integral") / F.col("span")).otherwise(F.col("flat")).alias("e"))
    return each.agg(F.avg("e").alias("score"))


def accuracy(df: DataFrame, label: str, predicted: str, weight: str | None = None) -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return df.agg((F.sum(hit * F.col(weight)) / F.sum(weight) if weight else F.avg(hit)).alias("accuracy"))


def scalar_r2(df: DataFrame, label: str, predicted: str) -> DataFrame:
    e = F.col(label) - F.col(predicted)
    return df.agg((1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"))
