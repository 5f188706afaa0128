"""Column expressions over one curve: arrays of doubles against constant arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: entries up to which a matrix is written out as expressions
STENCIL_TERMS = 256


def constant(values) -> Column:
    """A literal array of doubles; it belongs to the plan, so its length must be that of a grid."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def total(array: Column) -> Column:
    """Sum of an array; null if any element is."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(data: Column, weights) -> Column:
    """Weighted sum of an array against constants; null if an element is missing."""
    return total(F.zip_with(data, constant(weights), lambda x, w: x * w))


def each(data: Column, f) -> Column:
    return F.transform(data, f)


def pairwise(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def stencil(data: Column, matrix: np.ndarray) -> Column:
    """Matrix times curve where the matrix has few non-zero entries: plain expressions that are compiled with the stage."""
    rows = []
    for row in np.asarray(matrix, float):
        terms = [F.get(data, F.lit(int(j))) * float(row[j]) for j in np.flatnonzero(row)]
        rows.append(reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0))
    return F.array(*rows)


def apply_matrix(df: DataFrame, matrix: np.ndarray, data: str = "data", out: str = "data", centre=None) -> DataFrame:
    """Replace ``data`` by ``matrix @ (data - centre)`` for each row.

    Matrices with few entries stay in the JVM; others run as one product per Arrow batch.
    A missing cell makes every result null that it enters (all of them, for a dense matrix).
    """
    matrix = np.atleast_2d(np.asarray(matrix, float))
    if centre is None and np.count_nonzero(matrix) <= STENCIL_TERMS:
        return df.withColumn(out, stencil(F.col(data), matrix))
    shift = np.zeros(matrix.shape[1]) if centre is None else np.asarray(centre, float)
    keep = [c for c in df.columns if c != out]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), f"`{out}` array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.full(matrix.shape[1], np.nan) if v is None else np.asarray(v, float) for v in b[data]]) if len(b) else np.zeros((0, matrix.shape[1]))
            y = (x - shift) @ matrix.T
            yield b[keep].assign(**{out: [[None if np.isnan(v) else v for v in r] if np.isnan(r).any() else r for r in y]})

    return df.mapInPandas(run, kind)
