"""Admission control: estimates of the cells a request touches, and their limits."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a request.
MAX_SWEEP_CELL_UPDATES = 100_000_000
MAX_INTERACTIVE_CELL_UPDATES = 100_000_000
NEIGHBOURS = {2: 8, 3: 26}
#: Most generations that playback asks for at once; comparisons go by the 3D one.
PLAYBACK_BATCH = {2: 2000, 3: 800}


def whole(value, name: str, least: int = 1) -> int:
    try:
        if isinstance(value, bool):
            raise TypeError
        number = operator.index(value)
    except TypeError:
        raise ValueError(f"{name} must be an integer") from None
    if number < least:
        raise ValueError(f"{name} must be at least {least}")
    return number


def _dims(dimensions: int) -> int:
    if dimensions not in NEIGHBOURS:
        raise ValueError("dimensions must be 2 or 3")
    return dimensions


def estimate_cell_updates(*, dimensions: int, rules: int, initial_conditions: int, size: int, steps: int) -> int:
    return whole(rules, "rules") * whole(initial_conditions, "initial_conditions") * whole(size, "size") ** _dims(dimensions) * whole(steps, "steps", 0)


def validate_sweep_workload(**request) -> int:
    updates = estimate_cell_updates(**request)
    if updates > MAX_SWEEP_CELL_UPDATES:
        raise ValueError(f"{updates:,} cell updates are over the limit of {MAX_SWEEP_CELL_UPDATES:,}")
    return updates


def estimate_interactive_cell_updates(*, dimensions: int, cells: int, steps: int) -> int:
    """Neighbour evaluations of an interactive request."""
    return whole(cells, "cells") * whole(steps, "steps", 0) * NEIGHBOURS[_dims(dimensions)]


def validate_interactive_workload(*, dimensions: int, cells: int, steps: int) -> int:
    updates = estimate_interactive_cell_updates(dimensions=dimensions, cells=cells, steps=steps)
    if updates > MAX_INTERACTIVE_CELL_UPDATES:
        raise ValueError(f"{updates:,} neighbour evaluations are over the limit of {MAX_INTERACTIVE_CELL_UPDATES:,}")
    return updates


def playback_steps(owed: Column, dimensions: int) -> Column:
    """Whole generations of those ``owed`` that the next request of a playback asks for."""
    return F.greatest(F.lit(0), F.least(F.floor(owed), F.lit(PLAYBACK_BATCH[_dims(dimensions)]))).cast("long")
