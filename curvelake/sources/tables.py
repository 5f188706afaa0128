"""Sets of curves from the data folder's tables; each reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta
from curvelake.session import table

E_GRID = GridMeta.regular(64)
S_GRID = GridMeta.of(range(1, 13))
U_GRID = GridMeta.of(range(24))
DAY_GRID = GridMeta.of([h + 0.5 for h in range(24)], (0.0, 24.0))


def embeddings(spark: SparkSession, d: str) -> Curves:
    """E: 64 values on [0, 1] and a class."""
    return Curves.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", E_GRID, "label")


def supplier_months(spark: SparkSession, d: str) -> Curves:
    """S: revenue of each supplier by month of the year; months without sales count 0."""
    items = table(spark, d, "lineitem").select("l_suppkey", (F.month("l_shipdate") - 1).alias("pos"), "l_extendedprice")
    sums = items.groupBy("l_suppkey").agg(*[F.round(F.sum(F.when(F.col("pos") == k, F.col("l_extendedprice")).otherwise(0.0)), 2).alias(f"m{k}") for k in range(12)])
    return Curves(sums.select(F.col("l_suppkey").alias("id"), F.array(*[f"m{k}" for k in range(12)]).alias("data")), S_GRID)


def user_hours(spark: SparkSession, d: str) -> Curves:
    """U: mean value of each user's events by hour of the day; hours without events are missing."""
    hours = table(spark, d, "events").select("user_id", F.hour("ts").alias("pos"), "value")
    means = hours.groupBy("user_id").agg(*[F.round(F.avg(F.when(F.col("pos") == k, F.col("value"))), 6).alias(f"m{k}") for k in range(24)])
    return Curves(means.select(F.col("user_id").alias("id"), F.array(*[f"m{k}" for k in range(24)]).alias("data")), U_GRID)


def user_stream(spark: SparkSession, d: str) -> Irregular:
    """I: values of each user's events at days since 2024-01-01; several at one moment are averaged."""
    days = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(86400e6)
    rows = table(spark, d, "events").select("user_id", days.alias("t"), "value")
    return Irregular.from_frame(rows.groupBy("user_id", "t").agg(F.avg("value").alias("value")), "user_id", "t", "value")


def customer_orders(spark: SparkSession, d: str) -> Irregular:
    """O: order totals of each customer at whole days since 1990-01-01."""
    rows = table(spark, d, "orders").select("o_custkey", F.date_diff(F.col("o_orderdate"), F.lit("1990-01-01")).cast("double").alias("t"), "o_totalprice")
    return Irregular.from_frame(rows.groupBy("o_custkey", "t").agg(F.round(F.avg("o_totalprice"), 4).alias("v")), "o_custkey", "t", "v")


def station_days(spark: SparkSession, d: str) -> Curves:
    """Daily curves of the stations' sources, with missing cells."""
    return Curves.from_arrays(table(spark, d, "station_days"), "id", "data_matrix", DAY_GRID, "source_id")


def long_frame(df: DataFrame, id_column: str, argument: str, value: str) -> Irregular:
    return Irregular.from_frame(df, id_column, argument, value)
