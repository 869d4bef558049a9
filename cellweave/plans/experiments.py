"""Rule sweeps: random rules over shared random grids, comparisons of dimensions, and summaries by rule.

Each sweep is one plan: grids x rules (an explode), a run without a shuffle that keeps metrics only, and one aggregation
to a row per rule and initial condition.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import threefry
from cellweave.functions.rules import Rule, int_to_rule, let, parse_rule, parse_rule_3d, rule_text
from cellweave.functions.seeds import check_density, check_seed, rule_bits
from cellweave.functions.workload import whole
from cellweave.operators import keyed as keyed_operators
from cellweave.operators import simulate
from cellweave.operators.grids import random_grids
from cellweave.sources.shared import fresh_path, remove_at_exit


#: Columns of a sweep's rows.
SWEPT = [
    "dimensions", "rule", "rule_index", "rule_id", "initial_condition", "steps_executed", "initial_alive_fraction", "final_alive_fraction", "final_changed_fraction",
    "mean_changed_fraction", "mean_birth_fraction", "mean_death_fraction", "fixed_point",
]


def random_rules(spark: SparkSession, seed: int, count: int, dims: int = 2, stream: str = "rule") -> DataFrame:
    """``rule_index, rule_id, rule``: independent rules of fair bits."""
    if count < 0:
        raise ValueError("count cannot be negative")
    ids = spark.range(count).select(F.col("id").cast("int").alias("rule_index"))
    coded = ids.withColumn("rule_id", rule_bits(seed, f"{stream}{dims}", F.col("rule_index"), dims))
    return coded.withColumn("rule", rule_text(F.col("rule_id"), dims))


def sample_rules(spark: SparkSession, seed: int, count: int, dims: int = 2, stream: str = "rule") -> list[Rule]:
    return [int_to_rule(r["rule_id"], dims) for r in random_rules(spark, seed, count, dims, stream).orderBy("rule_index").collect()]


def sweep(grids: DataFrame, rules: list[Rule], steps: int, dims: int) -> DataFrame:
    """A row per rule and grid: ``rule_index, rule_id, rule, initial_condition`` and run statistics."""
    crossed = simulate.with_rules(grids, rules, dims)
    # A sweep has few rows and much work in each: every (rule, grid) may go to a core of its own.
    cores = grids.sparkSession.sparkContext.defaultParallelism
    spread = crossed.repartition(3 * cores, "grid_id", "rule_index")
    return _statistics(spread, ["rule_index", "rule_id", "grid_id"], steps, dims).withColumn("initial_condition", F.col("grid_id").cast("int")).select(*SWEPT)


def _statistics(runs: DataFrame, keys: list[str], steps: int, dims: int) -> DataFrame:
    """A row of run statistics for each grid under its rule; ``keys`` tell the rows apart and stay."""
    runs = simulate.run_metrics(runs, steps, dims, include_first=True)
    size = (F.col("depth") * F.col("height") * F.col("width")).alias("total")
    per = runs.select(*keys, size, "generation", "alive", "changed", "births", "deaths").groupBy(*keys, "total")
    first = F.max(F.when(F.col("generation") == 0, F.col("alive"))).alias("first")
    sums = per.agg(first, F.max_by("alive", "generation").alias("alive"), F.max_by("changed", "generation").alias("last"), *[F.sum(c).alias(c) for c in ("changed", "births", "deaths")])
    total = F.col("total").cast("double")
    mean = lambda c: (F.col(c) / (total * F.lit(float(steps))) if steps else F.lit(0.0))
    return sums.select(
        *keys,
        F.lit(dims).alias("dimensions"),
        rule_text(F.col("rule_id"), dims).alias("rule"),
        F.lit(steps).alias("steps_executed"),
        (F.col("first") / total).alias("initial_alive_fraction"),
        (F.col("alive") / total).alias("final_alive_fraction"),
        (F.col("last") / total).alias("final_changed_fraction"),
        mean("changed").alias("mean_changed_fraction"),
        mean("births").alias("mean_birth_fraction"),
        mean("deaths").alias("mean_death_fraction"),
        (F.col("last") == 0).alias("fixed_point"),
    )


def sweep_requests(requests: DataFrame, dims: int, *, rules: int, initial_conditions: int, size: int, steps: int, density: float = 0.10) -> DataFrame:
    """A sweep for each row (``request``, ``seed``) of a table: random rules over that request's random grids.

    The seed's key is split into one for rules and one for grids, and those into one for each rule and each grid, so requests
    do not share numbers and any of them can be made again alone.  ``request`` and the columns of ``sweep``; a row without a seed
    has no result.
    """
    _check(density, steps, rules=rules, initial_conditions=initial_conditions, size=size)
    # A request is few bytes and much work: a small file of them goes to all cores.
    spread = requests.where("seed IS NOT NULL").repartition(3 * requests.sparkSession.sparkContext.defaultParallelism, "request")
    keyed = spread.select("request", threefry.key_from_seed(F.col("seed")).alias("key"))
    numbers = F.sequence(F.lit(0), F.lit(rules - 1))
    chosen = let(threefry.split(F.col("key"), F.lit(0)), lambda own: F.transform(numbers, lambda i: threefry.rule_bits(threefry.split(own, i), dims)))
    parts = keyed.select("request", chosen.alias("chosen"), threefry.split(F.col("key"), F.lit(1)).alias("grid_key"))
    drawn = keyed_operators.split_keys(parts, "grid_key", initial_conditions, "initial_condition", "own_key").drop("grid_key")
    drawn = keyed_operators.random_grids(drawn, "own_key", (size,) * dims, density)
    crossed = drawn.select("request", "initial_condition", "depth", "height", "width", "cells", F.posexplode("chosen").alias("rule_index", "rule_id"))
    # Statistics are grouped before anything else is: a run's generations leave its task as one row.
    return _statistics(crossed, ["request", "rule_index", "rule_id", "initial_condition"], steps, dims).select("request", *SWEPT)


def compare_requests(requests: DataFrame, *, rules: int = 1, initial_conditions: int = 20, size_2d: int = 64, size_3d: int = 32, steps: int = 100, density: float = 0.10) -> DataFrame:
    """Sweeps in both dimensions for each row (``request``, ``seed``) of a table, side by side."""
    out = None
    for dims, size in ((2, size_2d), (3, size_3d)):
        rows = sweep_requests(requests, dims, rules=rules, initial_conditions=initial_conditions, size=size, steps=steps, density=density)
        rows = rows.select("dimensions", "request", "rule", "rule_index", "initial_condition", F.lit("x".join([str(size)] * dims)).alias("grid_shape"), "initial_alive_fraction", "final_alive_fraction", "mean_changed_fraction")
        out = rows if out is None else out.unionByName(rows)
    return out


def _check(density: float, steps: int, **positive: int) -> None:
    whole(steps, "steps", 0)
    for name, value in positive.items():
        whole(value, name)
    check_density(density)


def random_experiment(spark: SparkSession, dims: int, *, rules: int, initial_conditions: int, size: int, steps: int, density: float = 0.10, seed: int = 42, progress: Callable[[int, int], None] | None = None) -> tuple[DataFrame, dict]:
    """Random rules, each over the same random grids: result rows and a manifest.

    ``rule_id`` is the rule's position in 2D and its code in 3D.
    """
    _check(density, steps, rules=rules, initial_conditions=initial_conditions, size=size)
    grids = random_grids(spark, check_seed(seed), (size,) * dims, density, initial_conditions, f"sweep{dims}")
    chosen = sample_rules(spark, seed, rules, dims)
    rows = _sweep_with_progress(grids, chosen, steps, dims, progress) if progress else sweep(grids, chosen, steps, dims)
    rows = (rows.withColumn("rule_id", F.col("rule_index").cast("long")) if dims == 2 else rows).drop("rule_index")
    manifest = {"dimensions": dims, "grid_size": [size] * dims, "rules": rules, "initial_conditions_per_rule": initial_conditions, "steps": steps, "density": density, "seed": seed, "device": f"spark:{spark.sparkContext.master}", **({"dtype": "uint8"} if dims == 3 else {}), "timestamp": datetime.now(UTC).isoformat()}
    return rows, manifest


def _sweep_with_progress(grids: DataFrame, rules: list[Rule], steps: int, dims: int, progress: Callable[[int, int], None]) -> DataFrame:
    """A sweep of a job for each rule, so that ``progress(done, all)`` can be told of it; rows are written as they come."""
    path, spark = fresh_path(grids.sparkSession, "sweep"), grids.sparkSession
    for done, rule in enumerate(rules, 1):
        rows = sweep(grids, [rule], steps, dims).withColumn("rule_index", F.lit(done - 1))
        rows.write.mode("append").parquet(path)
        progress(done, len(rules))
    remove_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def random_2d_experiment(spark: SparkSession, **request) -> tuple[DataFrame, dict]:
    return random_experiment(spark, 2, **{"rules": 5, "initial_conditions": 4, "size": 24, "steps": 50} | request)


def random_3d_experiment(spark: SparkSession, **request) -> tuple[DataFrame, dict]:
    return random_experiment(spark, 3, **{"rules": 100, "initial_conditions": 20, "size": 64, "steps": 500} | request)


def compare_dimensions(spark: SparkSession, *, rules: int = 1, initial_conditions: int = 20, size_2d: int = 64, size_3d: int = 32, steps: int = 100, density: float = 0.10, seed: int = 42, rule_2d: str = "B3/S23", rule_3d: str = "B6/S5,6,7") -> tuple[DataFrame, dict]:
    """2D and 3D runs side by side: the given rules if one is asked for, else random ones of either dimension."""
    _check(density, steps, rules=rules, initial_conditions=initial_conditions, size_2d=size_2d, size_3d=size_3d)
    out = None
    for dims, size, text, parse in ((2, size_2d, rule_2d, parse_rule), (3, size_3d, rule_3d, parse_rule_3d)):
        chosen = [parse(text)] if rules == 1 else sample_rules(spark, seed, rules, dims, "compare")
        grids = random_grids(spark, seed, (size,) * dims, density, initial_conditions, f"compare{dims}")
        rows = sweep(grids, chosen, steps, dims).select("dimensions", "rule", "rule_index", "initial_condition", F.lit("x".join([str(size)] * dims)).alias("grid_shape"), F.col("steps_executed").alias("steps"), "initial_alive_fraction", "final_alive_fraction", "mean_changed_fraction")
        out = rows if out is None else out.unionByName(rows)
    manifest = {"dimensions": [2, 3], "grid_size_2d": [size_2d] * 2, "grid_size_3d": [size_3d] * 3, "rules": rules, "initial_conditions_per_dimension": initial_conditions, "steps": steps, "density": density, "seed": seed, "rule_2d": rule_2d, "rule_3d": rule_3d, "device": f"spark:{spark.sparkContext.master}", "timestamp": datetime.now(UTC).isoformat()}
    return out, manifest


def summary_by_rule(rows: DataFrame) -> DataFrame:
    """``dimensions, rule, runs, final, changed, fixed``: means over a rule's runs and how many ended fixed."""
    return rows.groupBy("dimensions", "rule").agg(F.count(F.lit(1)).alias("runs"), F.avg("final_alive_fraction").alias("final"), F.avg("mean_changed_fraction").alias("changed"), F.count_if("fixed_point").alias("fixed"))


def browse(summary: DataFrame, text: str = "", by: str = "rule", descending: bool = False) -> DataFrame:
    """The summary table as a browser shows it: rules that contain ``text`` in any case, ordered by a column."""
    found = summary.where(F.lower("rule").contains(text.lower())) if text else summary
    return found.orderBy(F.desc(by) if descending else F.asc(by), "dimensions", "rule")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as CSV files with a header and quoted values, written by the executors."""
    rows.write.option("header", True).option("quoteAll", True).csv(path)


def save_experiment(rows: DataFrame, manifest: dict, kind: str, output_dir: str | Path | None = None) -> str:
    """Write ``manifest.json`` and ``results.csv`` into a folder on the driver; its path.

    A sweep's result is small by admission control (a row per rule and condition); use ``write_results`` for others.
    """
    target = Path(output_dir) if output_dir else Path("artifacts/experiments") / f"{kind}_{datetime.now(UTC):%Y%m%dT%H%M%SZ}"
    target.mkdir(parents=True, exist_ok=True)
    (target / "manifest.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")
    order = [c for c in ("dimensions", "rule", "rule_id", "rule_index", "initial_condition") if c in rows.columns]
    rows.orderBy(order[0], order[-2], order[-1]).toPandas().to_csv(target / "results.csv", index=False)
    return str(target)
