"""Runs of packed grids: many generations without a shuffle.

A partition's grids of one shape are stacked and advanced together in numpy: the neighbour sum is one pair of shifts
per axis, and the next state a look-up in each grid's rule.  Every row carries its own rule code, so batches of
grids, many rules over the same grids, and mixtures run alike.  Rows stream through in Arrow batches; nothing is
collected.  All functions take packed grids with a column ``rule_id`` (see ``with_rule`` and ``with_rules``); other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.rules import COUNTS, Rule, validate_rule
from cellweave.functions.workload import whole

#: Cells that are advanced together in a worker.
STACK_CELLS = 1 << 21
#: Most rules that may be crossed with grids by broadcast.
MAX_RULES = 10_000


def with_rule(grids: DataFrame, rule: Rule) -> DataFrame:
    """Every grid under one rule."""
    return grids.withColumn("rule_id", F.lit(rule.code).cast("long"))


def with_rules(grids: DataFrame, rules: list[Rule], dims: int = 2) -> DataFrame:
    """Every grid under every rule (``rule_index, rule_id``): an explode of a literal list, at most ``MAX_RULES``."""
    if not rules:
        raise ValueError("at least one rule is needed")
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules at once")
    codes = F.array(*[F.lit(validate_rule(r, dims).code).cast("long") for r in rules])
    return grids.select("*", F.posexplode(codes).alias("rule_index", "rule_id"))


def neighbour_sum(stack: np.ndarray, dims: int) -> np.ndarray:
    """Live neighbours on the torus, of a stack (grids, z, y, x); small tori count with multiplicity."""
    total = stack.astype(np.uint8)
    for axis in range(4 - dims, 4):
        total = total + np.roll(total, 1, axis) + np.roll(total, -1, axis)
    return total - stack


def next_generation(stack: np.ndarray, table: np.ndarray, dims: int) -> np.ndarray:
    """``table``: a row of next states for each grid, dead cells' counts first."""
    index = neighbour_sum(stack, dims) + stack * np.uint8(COUNTS[dims])
    if (table == table[:1]).all():
        return table[0][index]
    return table[np.arange(len(stack)).reshape(-1, 1, 1, 1), index]


def rule_tables(codes: np.ndarray, dims: int) -> np.ndarray:
    return (codes.astype(np.int64)[:, None] >> np.arange(2 * COUNTS[dims]) & 1).astype(np.uint8)


def transition(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """alive, changed, births, deaths of each grid of a stack."""
    inner = (1, 2, 3)
    alive, births = after.sum(inner, dtype=np.int64), ((before == 0) & (after != 0)).sum(inner)
    deaths = births + before.sum(inner, dtype=np.int64) - alive
    return np.stack((alive, births + deaths, births, deaths), axis=1).astype(np.int32)


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and stacked grids, by shape and in pieces of bounded size."""
    shapes = np.stack([batch.column(c).to_numpy() for c in ("depth", "height", "width")], axis=1)
    column = batch.column("cells")
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    starts = offsets - offsets[0]
    for shape in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == shape).all(axis=1))
        size = int(shape.prod())
        if (np.diff(starts)[rows] != size).any():
            raise ValueError(f"cells do not fill a grid of shape {shape.tolist()}")
        fit = max(1, STACK_CELLS // size)
        for at in range(0, len(rows), fit):
            some = rows[at : at + fit]
            cells = values[starts[some][:, None] + np.arange(size)]
            yield some, (cells != 0).astype(np.uint8).reshape(-1, *shape)


def _lists(stack: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(stack, np.int8).reshape(len(stack), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _apply(grids: DataFrame, kernel, added: str, keep_cells: bool) -> DataFrame:
    """``kernel(stack, tables)`` yields (chosen grids, added columns, cells or None); rows come out with their own columns."""
    names = [c for c in grids.columns if c != "cells"]
    schema = grids.schema
    types = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in names)
    out_names = names + [x.split()[0] for x in added.split(", ") if x] + (["cells"] if keep_cells else [])

    def evolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("rule_id").to_numpy()
            for rows, stack in _stacks(batch):
                for chosen, extra, cells in kernel(stack, codes[rows]):
                    if not len(chosen):
                        continue
                    own = batch.take(pa.array(rows[chosen]))
                    columns = [own.column(c) for c in names] + [pa.array(x) for x in extra] + ([_lists(cells)] if keep_cells else [])
                    yield pa.RecordBatch.from_arrays(columns, out_names)

    parts = [types] + ([added] if added else []) + (["cells array<tinyint>"] if keep_cells else [])
    return grids.select(*names, "cells").mapInArrow(evolve, ", ".join(parts))


def run_steps(grids: DataFrame, steps: int, dims: int = 2) -> DataFrame:
    """The grids after ``steps`` generations."""
    steps = whole(steps, "steps", 0)

    def kernel(stack, codes):
        tables = rule_tables(codes, dims)
        for _ in range(steps):
            stack = next_generation(stack, tables, dims)
        yield np.arange(len(stack)), [], stack

    return _apply(grids, kernel, "", True)


def run_metrics(grids: DataFrame, steps: int, dims: int = 2, include_first: bool = False) -> DataFrame:
    """A row of transition counts for every grid and generation 1 to ``steps``, without the grids.

    ``include_first`` adds generation 0, in which nothing changed.
    """
    steps = whole(steps, "steps", 0)

    def kernel(stack, codes):
        tables = rule_tables(codes, dims)
        if include_first:
            yield np.arange(len(stack)), [np.zeros(len(stack), np.int32), *transition(stack, stack).T], None
        for generation in range(1, steps + 1):
            after = next_generation(stack, tables, dims)
            yield np.arange(len(stack)), [np.full(len(stack), generation, np.int32), *transition(stack, after).T], None
            stack = after

    return _apply(grids, kernel, "generation int, alive int, changed int, births int, deaths int", False)


def run_last_metrics(grids: DataFrame, steps: int, dims: int = 2) -> DataFrame:
    """The grids after ``steps`` generations, with the last one's transition counts (zeros if there is none)."""
    steps = whole(steps, "steps", 0)

    def kernel(stack, codes):
        tables, before = rule_tables(codes, dims), None
        for _ in range(steps):
            before, stack = stack, next_generation(stack, tables, dims)
        counts = np.zeros((len(stack), 4), np.int32) if before is None else transition(before, stack)
        yield np.arange(len(stack)), list(counts.T), stack

    return _apply(grids, kernel, "alive int, changed int, births int, deaths int", True)


def trajectory(grids: DataFrame, steps: int, dims: int = 2, record_every: int = 1) -> DataFrame:
    """The grids at generations 0, k, 2k ... and at the last, with a column ``generation``."""
    steps, every = whole(steps, "steps", 0), whole(record_every, "record_every")

    def kernel(stack, codes):
        tables = rule_tables(codes, dims)
        for generation in range(steps + 1):
            if generation:
                stack = next_generation(stack, tables, dims)
            if generation % every == 0 or generation == steps:
                yield np.arange(len(stack)), [np.full(len(stack), generation, np.int32)], stack

    return _apply(grids, kernel, "generation int", True)


def run_until_stable(grids: DataFrame, max_steps: int = 1000, dims: int = 2) -> DataFrame:
    """Every grid until a generation changes nothing: final cells, ``steps_taken, settled`` and the last transition counts.

    The confirming generation counts.  A grid that settled is left alone while its stack goes on; a limit of 0 leaves all
    as they are, not settled.
    """
    max_steps = whole(max_steps, "max_steps", 0)

    def kernel(stack, codes):
        tables = rule_tables(codes, dims)
        open_, last = np.arange(len(stack)), np.zeros((len(stack), 4), np.int32)
        for taken in range(1, max_steps + 1):
            after = next_generation(stack, tables, dims)
            last = transition(stack, after)
            done = last[:, 1] == 0
            if done.any():
                n = int(done.sum())
                yield open_[done], [np.full(n, taken, np.int32), np.ones(n, bool), *last[done].T], after[done]
            stack, tables, open_, last = after[~done], tables[~done], open_[~done], last[~done]
            if not len(open_):
                return
        n = len(open_)
        yield open_, [np.full(n, max_steps, np.int32), np.zeros(n, bool), *last.T], stack

    return _apply(grids, kernel, "steps_taken int, settled boolean, alive int, changed int, births int, deaths int", True)


def neighbour_counts(grids: DataFrame, dims: int = 2) -> DataFrame:
    """The grids with neighbour counts in place of cells."""

    def kernel(stack, codes):
        yield np.arange(len(stack)), [], neighbour_sum(stack, dims)

    ruled = grids if "rule_id" in grids.columns else grids.withColumn("rule_id", F.lit(0).cast("long"))
    out = _apply(ruled, kernel, "", True)
    return out if "rule_id" in grids.columns else out.drop("rule_id")
