"""Curves from streams of readings.

Readings of a source in a time window become one gridded curve when the watermark closes the window, with late
readings within the watermark included. The closed curves are batches of the same shape as ``Curves.df``, so every
operator applies to them through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from curvelake.frames import Curves
from curvelake.meta import GridMeta


def windowed_curves(stream: DataFrame, id_column: str, time_column: str, value_column: str, length: str, cells: int, late: str = "10 minutes") -> DataFrame:
    """``(id, window_start, window_end, data)``: mean value in each of ``cells`` equal parts of every tumbling window.

    Parts without a reading are null. Works on static frames as well, where the watermark has no effect. Rows with a
    null id, time or value, and NaN values, do not count.
    """
    value = F.col(value_column).cast("double")
    rows = (
        stream.select(F.col(id_column).alias("id"), F.col(time_column).cast("timestamp").alias("at"), value.alias("v"))
        .where("id is not null and at is not null and v is not null and not isnan(v)")
        .withWatermark("at", late)
        .withColumn("w", F.window("at", length))
    )
    micros = F.unix_micros(F.col("at")) - F.unix_micros(F.col("w.start"))
    span = F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("w.start"))
    rows = rows.withColumn("pos", F.least(F.lit(cells - 1), F.floor(micros * cells / span)).cast("int"))
    means = rows.groupBy("id", "w").agg(*[F.avg(F.when(F.col("pos") == k, F.col("v"))).alias(f"m{k}") for k in range(cells)])
    return means.select("id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.array(*[f"m{k}" for k in range(cells)]).alias("data"))


def session_statistics(stream: DataFrame, id_column: str, time_column: str, value_column: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """``(id, session_start, session_end, n, mean, low, high)`` of bursts of readings separated by at least ``gap``."""
    rows = stream.select(F.col(id_column).alias("id"), F.col(time_column).cast("timestamp").alias("at"), F.col(value_column).cast("double").alias("v")).withWatermark("at", late)
    made = rows.groupBy(F.session_window("at", gap).alias("w"), "id").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return made.select("id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "mean", "low", "high")


def on_closed_curves(curves: DataFrame, meta: GridMeta, work: Callable[[Curves, int], None]) -> DataStreamWriter:
    """A writer that hands every batch of closed curves to ``work(curves, batch number)``."""
    return curves.writeStream.outputMode("append").foreachBatch(lambda df, n: work(Curves(df, meta), n))
