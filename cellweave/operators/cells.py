"""Generations over cell relations: for grids too large for a row.

The centre cell is its own offset with a weight above all neighbours together, so one sum tells both a cell's state and
its neighbour count, each generation refers to its parent once, and small tori count with multiplicity.  Each generation
is one shuffle with map-side sums; ``run`` writes the relation into the shared folder every few generations.

A shuffle by cell parts neighbours, so the next map-side sums hold a row for nearly every neighbour of a task's cells.  Small grids
are therefore dealt out whole (``by_grid``): their generations follow in one task without a shuffle, a bounded number of cells a task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.rules import Rule, rule_bit
from cellweave.functions.workload import whole
from cellweave.operators.grids import axes, full_shape
from cellweave.sources.shared import materialise

#: Weight of the centre by dimensions: more than all neighbours.
CENTRE = {2: 10, 3: 32}
COUNTS = {2: 9, 3: 27}
CHECKPOINT_EVERY = 4
#: Cells that meet in a task, and cells of the largest grid that is dealt out whole.
TASK_CELLS, WHOLE_CELLS = 1 << 18, 1 << 14


def by_grid(rows: DataFrame, shape: tuple[int, ...], keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """Packed grids, or their cells, so that a grid is in one task and a task has about ``TASK_CELLS`` cells: the rows are counted
    for that.  Grids of more than ``WHOLE_CELLS`` cells stay where they are."""
    size = prod(full_shape(shape))
    if size > WHOLE_CELLS:
        return rows
    cells = rows.count() * (size if "cells" in rows.columns else 1)
    return rows.repartition(max(-(-cells // TASK_CELLS), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def _sums(cells: DataFrame, shape: tuple[int, ...], keys: list[str]) -> DataFrame:
    dims = len(shape)
    names = axes(dims)
    sizes = full_shape(shape)[3 - dims :]
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"d{a}") for a, o in zip(names, offset, strict=True)], F.lit(1 if any(offset) else CENTRE[dims]).alias("w")) for offset in product((-1, 0, 1), repeat=dims)])
    near = cells.select(*keys, *names, "alive", F.explode(offsets).alias("o"))
    moved = near.select(*keys, *[F.pmod(F.col(a) + F.col(f"o.d{a}"), F.lit(n)).cast("int").alias(a) for a, n in zip(names, sizes, strict=True)], (F.col("alive") * F.col("o.w")).alias("v"))
    return moved.groupBy(*keys, *names).agg(F.sum("v").cast("int").alias("s"))


def neighbour_counts(cells: DataFrame, shape: tuple[int, ...], keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """``keys, axes, alive, n`` for every cell next to a given one (all cells, if all are given)."""
    dims = len(shape)
    sums = _sums(cells, shape, list(keys))
    alive = F.floor(F.col("s") / CENTRE[dims]).cast("tinyint")
    return sums.select(*keys, *axes(dims), alive.alias("alive"), (F.col("s") - alive * CENTRE[dims]).alias("n"))


def step(cells: DataFrame, rule: Rule | Column, shape: tuple[int, ...], keys: tuple[str, ...] = ("grid_id",), live_only: bool = False) -> DataFrame:
    """The next generation.  ``rule`` may be a column of rule codes that depends on ``keys``.

    With ``live_only`` the relation holds live cells alone (sparse); that needs a rule without birth on 0.
    """
    dims = len(shape)
    code = rule if isinstance(rule, Column) else F.lit(rule.code).cast("long")
    if live_only and isinstance(rule, Rule) and rule.birth[0]:
        raise ValueError("a rule with birth on 0 needs all cells, not the live ones")
    source = cells.where(F.col("alive") != 0) if live_only else cells
    counted = neighbour_counts(source, shape, keys)
    alive = rule_bit(code, (F.col("n") + F.col("alive") * COUNTS[dims]).cast("int")).cast("tinyint")
    out = counted.select(*keys, *axes(dims), alive.alias("alive"))
    return out.where(F.col("alive") != 0) if live_only else out


def run(cells: DataFrame, rule: Rule | Column, shape: tuple[int, ...], steps: int, keys: tuple[str, ...] = ("grid_id",), live_only: bool = False, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``steps`` generations; ``checkpoint`` (a function of a DataFrame; by default a table in the shared folder) cuts the
    lineage every few of them.  Small grids are dealt out whole after each; ``cells`` from ``by_grid`` begin so."""
    checkpoint = checkpoint or (lambda df: materialise(df, "generation"))
    for i in range(whole(steps, "steps", 0)):
        cells = step(cells, rule, shape, keys, live_only)
        if i % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1 and i + 1 < steps:
            cells = by_grid(checkpoint(cells), shape, keys)
    return cells
