"""Sets of curves from and to files; any format and folder that Spark reads."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta


def read_wide(spark: SparkSession, path: str, columns: list[str], meta: GridMeta, id_column: str, format: str = "parquet", **options) -> Curves:
    """One column for each grid point; only the named columns are read."""
    df = spark.read.format(format).options(**options).load(path)
    return Curves.from_arrays(df.select(F.col(id_column).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("data")), "id", "data", meta)


def read_arrays(spark: SparkSession, path: str, id_column: str, data_column: str, meta: GridMeta, format: str = "parquet", **options) -> Curves:
    return Curves.from_arrays(spark.read.format(format).options(**options).load(path), id_column, data_column, meta)


def read_long(spark: SparkSession, path: str, id_column: str, argument: str, value: str, format: str = "parquet", **options) -> Irregular:
    return Irregular.from_frame(spark.read.format(format).options(**options).load(path), id_column, argument, value)


def ragged(df: DataFrame, id_column: str, data_column: str, fill: float = 0.0) -> Curves:
    """Arrays of different lengths on the grid 0, 1, 2, ... of the longest; missing ends are filled."""
    rows = df.select(F.col(id_column).alias("id"), F.col(data_column).cast("array<double>").alias("data")).where("id is not null and data is not null")
    n = rows.agg(F.max(F.size("data"))).first()[0] or 1
    whole = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get("data", i), F.lit(float(fill))))
    return Curves(rows.select("id", whole.alias("data")), GridMeta.of(np.arange(n)))


def write(curves: Curves, path: str, mode: str = "errorifexists") -> None:
    """Parquet with the grid in a small table beside the curves."""
    curves.df.write.mode(mode).parquet(f"{path}/curves")
    spark = curves.df.sparkSession
    meta = {"axes": curves.meta.axes, "domain": curves.meta.domain, "codomain": curves.meta.codomain}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).json(f"{path}/grid")


def read(spark: SparkSession, path: str) -> Curves:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/grid").first()["meta"])
    return Curves(spark.read.parquet(f"{path}/curves"), GridMeta(tuple(map(tuple, meta["axes"])), tuple(map(tuple, meta["domain"])), meta["codomain"]))
