"""Irregular readings onto a regular grid (problem 4).

For every source a harmonic seasonal regression with trend is fitted to its observed steps:

    v(t) = a + b t + sum_k  c_k cos(2 pi k t / P) + d_k sin(2 pi k t / P)

Its normal equations are sums over readings, so they are one ``groupBy`` with partial
aggregation in every task, whatever the length of a history; only the solved coefficients (a
handful a source) return to the rows. A missing step gets the prediction plus the residuals of
the observed steps around it, interpolated linearly between them: the filled series meets the
observed values at both ends of a gap and follows the season inside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeasonSettings:
    period: float = 1440.0  # minutes
    harmonics: int = 2
    #: added to the diagonal of the scaled normal equations, so that short histories can be solved
    ridge: float = 1e-6
    #: with fewer observed steps the model is the mean alone
    least_steps: int = 24
    #: slots of one source that one window task holds at most
    block_slots: int = 4096


def usable_readings(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, slot, value)`` of the readings that count.

    A reading counts if its ``args`` is not null, NaN or infinite and lies in the service time, and its
    ``vals`` is not null, NaN, infinite or the source's ``missing_code``.
    """
    r = readings.select("source_id", F.col("args").cast("double").alias("arg"), F.col("vals").cast("double").alias("value"))
    far = F.lit(float("inf"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < far)
    s = sources.select("source_id", F.col("step_min").alias("step"), F.col("missing_code").alias("code"), "active_from", "active_to")
    return (
        r.where(finite(F.col("arg")) & finite(F.col("value")))
        .join(s, "source_id")
        .where("arg >= active_from and arg < active_to and (code is null or value != code)")
        .select("source_id", F.floor(F.col("arg") / F.col("step")).cast("long").alias("slot"), "value")
    )


def _features(t: Column, s: SeasonSettings) -> list[Column]:
    angle = t * F.lit(2 * math.pi / s.period)
    waves = [f(angle * k) for k in range(1, s.harmonics + 1) for f in (F.cos, F.sin)]
    return [F.lit(1.0), t / F.lit(s.period), *waves]


def _solve(batches: Iterator[pd.DataFrame], p: int, s: SeasonSettings) -> Iterator[pd.DataFrame]:
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    for batch in batches:
        m = len(batch)
        if not m:
            continue
        gram = np.zeros((m, p, p))
        for i, j in upper:
            gram[:, i, j] = gram[:, j, i] = batch[f"g{i}_{j}"].to_numpy(float)
        right = np.stack([batch[f"r{i}"].to_numpy(float) for i in range(p)], 1)
        size = np.sqrt(np.maximum(np.einsum("mii->mi", gram), 1e-300))
        scaled = gram / size[:, :, None] / size[:, None, :]
        scaled += s.ridge * np.eye(p)
        coef = np.linalg.solve(scaled, (right / size)[:, :, None])[:, :, 0] / size
        few = gram[:, 0, 0] < s.least_steps
        coef[few] = 0
        coef[few, 0] = right[few, 0] / gram[few, 0, 0]
        yield pd.DataFrame({"source_id": batch["source_id"], "coef": list(coef)})


def fit_seasons(observed: DataFrame, sources: DataFrame, settings: SeasonSettings | None = None) -> DataFrame:
    """``(source_id, coef array<double>)`` from ``observed (source_id, slot, value)``."""
    s = settings or SeasonSettings()
    steps = sources.select("source_id", F.col("step_min").alias("step"), "active_from")
    rows = observed.join(steps, "source_id").withColumn("t", (F.col("slot") + 0.5) * F.col("step") - F.col("active_from"))
    x = _features(F.col("t"), s)
    p = len(x)
    rows = rows.select("source_id", "value", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col(f"x{i}") * F.col("value")).alias(f"r{i}") for i in range(p)]
    return rows.groupBy("source_id").agg(*sums).mapInPandas(
        lambda it: _solve(it, p, s), "source_id bigint, coef array<double>"
    )


def regular_grid(readings: DataFrame, sources: DataFrame, settings: SeasonSettings | None = None) -> DataFrame:
    """``(source_id, slot, at, value, n_readings, is_missing, model)``: every step of every irregular source.

    ``readings``: ``source_id, args, vals``; ``sources``: ``source_id, encoding, step_min, missing_code,
    active_from, active_to``; other columns are ignored. ``at`` is the minute at which the step starts,
    ``value`` the mean of its usable readings or, where ``is_missing``, the bridged prediction; it is null
    only for a source without any usable reading. ``model`` is the regression alone. Sources with a null
    ``source_id``, step or service time, or a step of 0 or less, have no grid; an empty service time gives
    no rows. A source repeated in ``sources`` counts once. Repeated readings all enter the mean.
    """
    s = settings or SeasonSettings()
    own = (
        sources.where("encoding = 'irregular' and step_min > 0 and active_from is not null and active_to is not null and source_id is not null")
        .select(F.col("source_id").cast("long").alias("source_id"), "step_min", F.col("missing_code").cast("double").alias("missing_code"), "active_from", "active_to")
        .dropDuplicates(["source_id"])
    )
    size = s.block_slots
    observed = usable_readings(readings, own).groupBy("source_id", "slot").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_readings"))
    fits = fit_seasons(observed, own, s)
    low = F.floor(F.col("active_from") / F.col("step_min"))
    high = F.ceil(F.col("active_to") / F.col("step_min")) - 1
    grid = (
        own.where("active_to > active_from")
        .select("source_id", low.alias("low"), high.alias("high"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
        .repartition("source_id", "block")
        .select("source_id", F.explode(F.sequence(F.greatest("low", F.col("block") * size), F.least("high", F.col("block") * size + size - 1))).alias("slot"))
        .select("source_id", "slot", F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n_readings"))
    )
    every = (
        grid.unionByName(observed)
        .withColumn("block", F.floor(F.col("slot") / size))
        .repartition("source_id", "block")
        .groupBy("source_id", "block", "slot")
        .agg(F.max("value").alias("seen"), F.max("n_readings").alias("n_readings"))
    )
    t = (F.col("slot") + 0.5) * F.col("step_min") - F.col("active_from")
    model = sum((F.get("coef", F.lit(i)) * x for i, x in enumerate(_features(t, s)[1:], 1)), F.get("coef", F.lit(0)))
    every = (
        every.join(own.select("source_id", "step_min", "active_from"), "source_id")
        .join(fits, "source_id", "left")
        .withColumn("model", model)
        .select("source_id", "block", "slot", "seen", "n_readings", "model", (F.col("slot") * F.col("step_min")).alias("at"))
        .withColumn("mark", F.when(F.col("seen").isNotNull(), F.struct("slot", (F.col("seen") - F.col("model")).alias("off"))))
    )
    # between blocks: the last mark before and the first after each block, from one row a block
    ends = every.groupBy("source_id", "block").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    w = Window.partitionBy("source_id").orderBy("block")
    ends = ends.select(
        "source_id", "block",
        F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("left_out"),
        F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("right_out"),
    )
    inside = Window.partitionBy("source_id", "block").orderBy("slot")
    every = (
        every.withColumn("left", F.last("mark", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("right", F.first("mark", True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
        .join(ends, ["source_id", "block"])
        .withColumn("left", F.coalesce("left", "left_out"))
        .withColumn("right", F.coalesce("right", "right_out"))
    )
    bridge = (
        F.when(F.col("left").isNull(), F.col("right.off"))
        .when(F.col("right").isNull(), F.col("left.off"))
        .when(F.col("left.slot") == F.col("right.slot"), F.col("left.off"))
        .otherwise(F.col("left.off") + F.try_divide(F.col("right.off") - F.col("left.off"), F.col("right.slot") - F.col("left.slot")) * (F.col("slot") - F.col("left.slot")))
    )
    return every.select(
        "source_id", "slot", "at",
        F.coalesce("seen", F.col("model") + bridge).alias("value"),
        "n_readings", F.col("seen").isNull().alias("is_missing"), "model",
    )
