"""Queries of the core problems over the data folder's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.core.regular import regular_grid
from curvelake.core.spikes import implausible_cells
from curvelake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_cells(table(spark, d, "station_days"), table(spark, d, "sources")).select("id", "pos")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "dataf"), table(spark, d, "sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).where("is_missing").select("source_id", "slot")


def p4_slots(spark: SparkSession, d: str) -> DataFrame:
    """How many usable readings each slot of the grid has."""
    return p4_grid(spark, d).select("source_id", "slot", F.coalesce("n_readings", F.lit(0)).cast("bigint").alias("n_readings"), "is_missing")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_grid": p4_grid, "p4_slots": p4_slots}

ORACLE = {
    "p4_slots": """
        with s as (select * from sources where encoding = 'irregular'),
        grid as (select source_id, unnest(range(active_from // step_min, (active_to + step_min - 1) // step_min)) as slot from s),
        seen as (
            select s.source_id, cast(floor(args / step_min) as bigint) as slot, count(*) as n
            from dataf r join s on r.source_id = s.source_id
            where args is not null and isfinite(args) and vals is not null and isfinite(vals)
              and (missing_code is null or vals <> missing_code)
              and args >= active_from and args < active_to group by 1, 2)
        select grid.source_id, grid.slot, coalesce(n, 0) as n_readings, n is null as is_missing from grid left join seen on grid.source_id = seen.source_id and grid.slot = seen.slot
    """,
    "p4_found": """
        with s as (select * from sources where encoding = 'irregular'),
        grid as (select source_id, unnest(range(active_from // step_min, (active_to + step_min - 1) // step_min)) as slot from s),
        seen as (
            select distinct s.source_id, cast(floor(args / step_min) as bigint) as slot
            from dataf r join s on r.source_id = s.source_id
            where args is not null and isfinite(args) and vals is not null and isfinite(vals)
              and (missing_code is null or vals <> missing_code)
              and args >= active_from and args < active_to)
        select grid.source_id, grid.slot from grid anti join seen on grid.source_id = seen.source_id and grid.slot = seen.slot
    """,
}
