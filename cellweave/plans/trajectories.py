"""Trajectories as stored tables, a folder a generation, and measures of them by analytic windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.metrics import transition_counts
from cellweave.operators import simulate
from cellweave.sources.shared import fresh_path, remove_at_exit


def store(grids: DataFrame, steps: int, dims: int = 2, path: str | None = None, record_every: int = 1) -> str:
    """Write the trajectory of packed grids (with ``rule_id``) partitioned by generation; its path.

    Runs without a shuffle; a file holds a task's grids of one generation.  Without a path it lies in the shared folder and goes with the session.
    """
    spark, target = grids.sparkSession, path or fresh_path(grids.sparkSession, "trajectory")
    simulate.trajectory(grids, steps, dims, record_every).write.partitionBy("generation").parquet(target)
    if path is None:
        remove_at_exit(spark, target)
    return target


def generation(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The grids at one generation: only its folder is read."""
    return spark.read.parquet(path).where(F.col("generation") == number)


def metrics(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (the grid's id by default), ``generation, alive, changed, births, deaths`` between each stored generation and the one stored before."""
    keys = keys or ["grid_id"]
    before = F.lag("cells").over(Window.partitionBy(*keys).orderBy("generation"))
    pairs = spark.read.parquet(path).select(*keys, "generation", "cells", before.alias("before")).where("before IS NOT NULL")
    return pairs.select(*keys, "generation", transition_counts(F.col("before"), F.col("cells")).alias("t")).select(*keys, "generation", "t.*")
