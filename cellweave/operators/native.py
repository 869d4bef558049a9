"""Packed generations in array expressions alone: no Python on the executors, no shuffle.

Interpreted per cell, so slower than ``simulate``; for clusters whose executors have no Python with numpy, and as a
second witness in the tests.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.rules import COUNTS, rule_bit
from cellweave.functions.workload import whole


def next_cells(cells: Column, depth: Column, height: Column, width: Column, code: Column, dims: int) -> Column:
    """The next generation of an array of cells."""

    def at(i: Column, dz: int, dy: int, dx: int) -> Column:
        x = F.pmod(F.pmod(i, width) + dx, width)
        y = F.pmod(F.pmod(F.floor(i / width), height) + dy, height)
        z = F.pmod(F.floor(i / (width * height)) + dz, depth)
        return F.get(cells, ((z * height + y) * width + x).cast("int")).cast("int")

    def successor(c: Column, i: Column) -> Column:
        n = None
        for offset in product((-1, 0, 1), repeat=dims):
            if any(offset):
                value = at(i, *((0,) * (3 - dims) + offset))
                n = value if n is None else n + value
        return rule_bit(code, n + c.cast("int") * COUNTS[dims]).cast("tinyint")

    return F.transform(cells, successor)


def run_steps(grids: DataFrame, steps: int, dims: int = 2) -> DataFrame:
    """As ``simulate.run_steps``."""
    size = (F.col("depth"), F.col("height"), F.col("width"))
    for _ in range(whole(steps, "steps", 0)):
        grids = grids.withColumn("cells", next_cells(F.col("cells"), *size, F.col("rule_id"), dims))
    return grids
