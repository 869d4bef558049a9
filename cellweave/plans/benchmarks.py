"""What a benchmark of cube sizes runs and reports: sizes, means over repeats, result files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.workload import whole

#: The standard edges of a cube, and the step beyond the last of them.
EDGES = (16, 32, 48, 64, 96, 128, 160, 192, 256)
BEYOND = 64


def benchmark_edges(most: Column) -> Column:
    """The edges up to ``most``, itself included: standard ones, then in even steps; sorted, each once."""
    standard = F.filter(F.array(*map(F.lit, EDGES)), lambda e: e <= most)
    further = F.when(most >= EDGES[-1] + BEYOND, F.sequence(F.lit(EDGES[-1] + BEYOND), most.cast("int"), F.lit(BEYOND))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(F.array_union(standard, further), F.array(most.cast("int"))))


def benchmark_sizes(spark, most: int) -> list[int]:
    return spark.range(1).select(benchmark_edges(F.lit(whole(most, "max_size"))).alias("edges")).first()["edges"]


def mean_times(runs: DataFrame, by: str, *times: str) -> DataFrame:
    """``by``, the number of repeats, and the mean of each column of times over them; failed repeats (null) do not count."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("repeats"), *[F.avg(t).alias(t) for t in times])


def write_report(rows: list[dict], about: dict, stem: Path) -> tuple[Path, Path]:
    """The report of a benchmark (a row a size) beside each other as CSV and as JSON."""
    import pandas as pd

    table, full = stem.with_suffix(".csv"), stem.with_suffix(".json")
    pd.DataFrame(rows).to_csv(table, index=False)
    full.write_text(json.dumps({**about, "sizes": [r["size"] for r in rows], "results": rows}, indent=2), encoding="utf-8")
    return table, full
