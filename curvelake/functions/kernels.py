"""Kernel functions as columns (for rows of distances) and as arrays (for driver matrices)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(u: Column, value: Column) -> Column:
    return F.when(F.abs(u) <= 1, value).otherwise(F.lit(0.0))


def normal(u: Column) -> Column:
    return F.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def cosine(u: Column) -> Column:
    return _inside(u, F.cos(u * (math.pi / 2)) * (math.pi / 4))


def epanechnikov(u: Column) -> Column:
    return _inside(u, (1 - u * u) * 0.75)


def tri_weight(u: Column) -> Column:
    return _inside(u, F.pow(1 - u * u, F.lit(3)) * (35 / 32))


def quartic(u: Column) -> Column:
    return _inside(u, F.pow(1 - u * u, F.lit(2)) * (15 / 16))


def uniform(u: Column) -> Column:
    return _inside(u, F.lit(0.5))


ARRAYS = {
    "normal": lambda u: np.exp(-u * u / 2) / math.sqrt(2 * math.pi),
    "cosine": lambda u: np.where(np.abs(u) <= 1, math.pi / 4 * np.cos(math.pi / 2 * u), 0),
    "epanechnikov": lambda u: np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0),
    "tri_weight": lambda u: np.where(np.abs(u) <= 1, 35 / 32 * (1 - u * u) ** 3, 0),
    "quartic": lambda u: np.where(np.abs(u) <= 1, 15 / 16 * (1 - u * u) ** 2, 0),
    "uniform": lambda u: np.where(np.abs(u) <= 1, 0.5, 0),
}
COLUMNS = {"normal": normal, "cosine": cosine, "epanechnikov": epanechnikov, "tri_weight": tri_weight, "quartic": quartic, "uniform": uniform}
