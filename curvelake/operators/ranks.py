"""Counts of values below and up to each value, point by point.

A window over a grid point holds all curves in one task, so it is used for up to ``window_rows`` curves.
Beyond that, the distinct values of a point are range-partitioned, numbered inside their ranges, and moved
by the ranges' totals; both ways give the same counts. Quantiles, running sums and the first k rows of an
order are found over ranges in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import checkpoint

WINDOW_ROWS = 1_000_000


def rank_counts(cells: DataFrame, rows: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``cells (pos, v, ref, ...)`` with ``below``, ``upto`` and ``n``: counts of the rows whose ``ref`` is 1.

    ``rows`` is the number of rows a point may have. Rows with a null ``v`` are left out.
    """
    cells = cells.where("v is not null")
    if rows <= window_rows:
        at = Window.partitionBy("pos").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            cells.withColumn("upto", F.sum("ref").over(at))
            .withColumn("below", F.col("upto") - F.sum("ref").over(Window.partitionBy("pos", "v")))
            .withColumn("n", F.sum("ref").over(Window.partitionBy("pos")))
        )
    return cells.join(_ranged(cells.groupBy("pos", "v").agg(F.sum("ref").alias("m"))), ["pos", "v"])


def running_total(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``upto`` and ``whole``: the sum of ``value`` up to each row of its group in the order, and of the group.

    Rows are range-partitioned by group and order, summed inside their ranges and moved by the ranges' totals, so
    a group is the work of many tasks.
    """
    rows = checkpoint(rows.repartitionByRange(group, order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy(group, "part").agg(F.sum(value).alias("t"))  # a row a group and partition
    by = Window.partitionBy(group).orderBy("part")
    totals = totals.withColumn("before", F.coalesce(F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("whole", F.sum("t").over(Window.partitionBy(group)))
    inside = Window.partitionBy(group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumn("run", F.sum(value).over(inside)).join(totals.drop("t"), [group, "part"])
    return made.withColumn("upto", F.col("before") + F.col("run")).drop("part", "run", "before")


def _ranged(values: DataFrame) -> DataFrame:
    """``(pos, v, upto, below, n)`` from the different values ``(pos, v, m)``."""
    made = running_total(values, "pos", "v", "m")
    return made.select("pos", "v", "upto", (F.col("upto") - F.col("m")).alias("below"), F.col("whole").alias("n"))


def quantiles(cells: DataFrame, shares: list[float], rows: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``(pos, q)``: exact quantiles of ``v`` at each ``pos``, interpolated between neighbouring ranks.

    ``rows`` is the number of rows a point may have: beyond ``window_rows`` no task holds the values of a point.
    """
    cells = cells.where("v is not null")
    if rows <= window_rows:
        return cells.groupBy("pos").agg(F.percentile("v", F.array(*[F.lit(float(x)) for x in shares])).alias("q"))
    values = _ranged(cells.groupBy("pos", "v").agg(F.count(F.lit(1)).alias("m")))
    at = [(F.col("n") - 1) * float(x) for x in shares]
    here = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("upto")), F.col("v")))
    found = values.groupBy("pos").agg(*[here(F.floor(r)).alias(f"l{k}") for k, r in enumerate(at)], *[here(F.ceil(r)).alias(f"h{k}") for k, r in enumerate(at)], F.max("n").alias("n"))
    part = lambda k, r: F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * (r - F.floor(r))
    return found.select("pos", F.array(*[part(k, r) for k, r in enumerate(at)]).alias("q"))


def first_rows(rows: DataFrame, order: list, k: int, few: int = 1000) -> DataFrame:
    """The first k rows in an order (columns; the last one should be unique), however many they are.

    Few are a top-k. Otherwise rows are range-partitioned in that order: whole ranges are taken, and of the one
    where k falls its first rows.
    """
    if k <= few:
        return rows.orderBy(*order).limit(max(0, k))
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row a partition
    left, at = k, -1
    for part, n in counts:
        at = part
        if n >= left:
            break
        left -= n
    else:
        return ranged.drop("_part")
    edge = ranged.where(F.col("_part") == at).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).where(F.col("_n") <= left).drop("_n")
    return ranged.where(F.col("_part") < at).unionByName(edge).drop("_part")
