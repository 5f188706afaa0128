"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset (a single machine, as in tests) is a folder of our own used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            master = context.master
            if not (master.startswith("local[") or master == "local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            named = tempfile.mkdtemp(prefix="curvelake-checkpoint-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no frame refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The frame marked for broadcast if it has at most ``rows`` rows, else as it is.

    It is counted, so it should be cheap to read (checkpointed, or a small table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
