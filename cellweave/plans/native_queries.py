"""Registered queries on bit planes, from SQL text, with all generations kept, and over stored trajectories; with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE
from cellweave.operators import grids, planes, simulate
from cellweave.plans import oracles as sql
from cellweave.plans import trajectories
from cellweave.sources import archives
from cellweave.sources.shared import fresh_path, remove_at_exit

RULE = {2: CONWAY, 3: DEFAULT_3D_RULE}
STEPS, RECURSIVE_STEPS = 10, 150

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, oracle: str):
    def add(query):
        QUERIES[name] = query
        ORACLE_SQL[name] = oracle
        return query

    return add


def _ruled(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    vectors = grids.grids_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", F.slice("embedding", 1, 64), sql.DIMS[dims])
    return simulate.with_rule(vectors, RULE[dims])


def _text(cells: str = "cells"):
    return F.array_join(F.transform(cells, lambda c: c.cast("string")), "").alias("cells")


@_register("bit_planes_2d", f"{sql.run(sql.vectors(2), CONWAY, 2, (8, 8), STEPS)} SELECT grid_id, {sql.grid_text(2)} FROM t WHERE gen = {STEPS} GROUP BY grid_id")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten generations of every embedding grid on bit planes, without Python."""
    return planes.run_steps(_ruled(spark, sf_dir, 2), STEPS).select("grid_id", _text())


@_register("recursive_planes_2d", f"{sql.run(sql.vectors(2), CONWAY, 2, (8, 8), RECURSIVE_STEPS)} SELECT grid_id, gen AS generation, sum(alive)::BIGINT AS alive FROM t GROUP BY grid_id, gen")
def recursive_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live cells of every embedding grid in 150 generations, each made of the one before."""
    every = planes.recursive_run(_ruled(spark, sf_dir, 2), RECURSIVE_STEPS)
    return every.select("grid_id", F.col("generation").cast("long").alias("generation"), F.expr(planes.alive_sql("planes")).alias("alive"))


_code = "((p_partkey * 1234567891011) % 262144)"


@_register(
    "sql_text_2d",
    f"{sql.run(f'SELECT v.*, {_code} AS code, p_partkey FROM ({sql.vectors(2)}) v JOIN part ON p_partkey = v.grid_id + 1', None, 2, (8, 8), 5, ', code, p_partkey')} SELECT p_partkey, {sql.rule_text('code', 2)} AS rule, y::BIGINT AS y, sum(alive)::BIGINT AS alive FROM t WHERE gen = 5 GROUP BY p_partkey, code, y",
)
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five generations of a grid under each part's rule, and its live cells by line, in SQL text alone."""
    planes.register(spark)
    # A row is much work: a small file goes to all cores.  Both tables may be large: neither is broadcast.
    spread = 3 * spark.sparkContext.defaultParallelism
    return spark.sql(f"""
      WITH signs AS (
        SELECT vec_id + 1 AS key, transform(sequence(0, 63), i -> CAST(coalesce(get(embedding, i) > 0, false) AS TINYINT)) AS cells FROM parquet.`{sf_dir}/embeddings.parquet`
      ), met AS (
        SELECT /*+ MERGE(signs), REPARTITION({spread}, p_partkey) */ p_partkey, cells FROM parquet.`{sf_dir}/part.parquet` JOIN signs ON p_partkey = key
      ), ruled AS (
        SELECT p_partkey, ca_rule_text(pmod(p_partkey * 1234567891011, 262144)) AS rule, ca_pack(cells, 8, 8) AS grid FROM met
      ), ended AS (
        SELECT p_partkey, rule, ca_run(grid, 8, ca_rule_code(rule), 5) AS grid FROM ruled
      )
      SELECT p_partkey, rule, CAST(c.y AS BIGINT) AS y, sum(c.alive) AS alive FROM ended, LATERAL ca_cells(grid, 8) c GROUP BY p_partkey, rule, c.y
    """)


def _archived(dims: int) -> None:
    @_register(f"grid_archive_{dims}d", f"SELECT grid_id, {sql.grid_text(dims)} FROM ({sql.vectors(dims)}) GROUP BY grid_id")
    def archived(spark, sf_dir):
        """Every embedding grid written into archives by the data source and read back by range."""
        archives.register(spark)
        path = fresh_path(spark, "archives")
        _ruled(spark, sf_dir, dims).drop("rule_id").write.format("grid-archive").mode("append").save(path)
        remove_at_exit(spark, path)
        return spark.read.format("grid-archive").option("cells", 4096).load(path).select("grid_id", _text())


def _stored(dims: int) -> None:
    shape = sql.DIMS[dims]
    run = sql.run(sql.vectors(dims), RULE[dims], dims, shape, STEPS)

    @_register(f"stored_trajectory_metrics_{dims}d", f"{run}, {sql.transitions(dims)} SELECT grid_id, gen AS generation, alive, changed, births, deaths FROM m")
    def metrics(spark, sf_dir):
        """Transition counts by a window over a stored trajectory."""
        found = trajectories.metrics(spark, trajectories.store(_ruled(spark, sf_dir, dims), STEPS, dims))
        return found.select("grid_id", *[F.col(c).cast("long").alias(c) for c in ("generation", "alive", "changed", "births", "deaths")])

    @_register(f"stored_trajectory_generation_{dims}d", f"{run} SELECT grid_id, {sql.grid_text(dims)} FROM t WHERE gen = 7 GROUP BY grid_id")
    def one_generation(spark, sf_dir):
        """One generation of a stored trajectory: one folder is read."""
        return trajectories.generation(spark, trajectories.store(_ruled(spark, sf_dir, dims), STEPS, dims), 7).select("grid_id", _text())


for _dims in (2, 3):
    _stored(_dims)
    _archived(_dims)
