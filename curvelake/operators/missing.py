"""Missing cells of gridded curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves


def fill_missing(curves: Curves) -> Curves:
    """Linear interpolation inside each curve, the end values held constant; a curve without values stays as it is.

    One pass over each curve's own cells from either side finds the neighbours of every cell; no rows move.
    """
    x = constant(curves.meta.points)
    cells = F.zip_with("data", x, lambda v, t: F.struct(v.alias("v"), t.alias("t")))
    none = F.lit(None).cast("struct<v:double,t:double>")

    def carry(array):
        start = F.struct(none.alias("last"), F.array().cast("array<struct<v:double,t:double>>").alias("seen"))

        def step(state, cell):
            last = F.when(cell["v"].isNotNull(), cell).otherwise(state["last"])
            return F.struct(last.alias("last"), F.concat(state["seen"], F.array(last)).alias("seen"))

        return F.aggregate(array, start, step, lambda s: s["seen"])

    filled = curves.df.withColumn("_cells", cells).withColumn("_left", carry(F.col("_cells"))).withColumn("_right", F.reverse(carry(F.reverse(F.col("_cells")))))

    def value(pair, t):
        left, right = pair["l"], pair["r"]
        line = left["v"] + F.coalesce(F.try_divide((right["v"] - left["v"]) * (t - left["t"]), right["t"] - left["t"]), F.lit(0.0))
        return F.when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(line)

    pairs = F.zip_with("_left", "_right", lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    out = filled.withColumn("data", F.when(F.exists("data", lambda v: v.isNull()), F.zip_with(pairs, x, value)).otherwise(F.col("data")))
    return curves.with_df(out.drop("_cells", "_left", "_right"))
