"""Random grids and rules from keys of a table (see ``functions.threefry``): a grid, a rule or a whole sweep for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import threefry
from cellweave.functions.rules import rule_text
from cellweave.functions.seeds import check_density
from cellweave.functions.workload import whole
from cellweave.operators.grids import full_shape

#: Cells drawn at once.
DRAWN = 1 << 20


def split_keys(df: DataFrame, key: str, count: int, index: str, to: str) -> DataFrame:
    """Every row ``count`` times, with the number ``index`` and a key ``to`` of its own made of the row's key."""
    many = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(whole(count, "count") - 1))).alias(index))
    return many.withColumn(to, threefry.split(F.col(key), F.col(index)))


def random_rules(df: DataFrame, key: str, dims: int) -> DataFrame:
    """The rows with a rule of fair bits drawn from their keys: ``rule_id, rule``."""
    return df.withColumn("rule_id", threefry.rule_bits(F.col(key), dims)).withColumn("rule", rule_text(F.col("rule_id"), dims))


def random_grids(df: DataFrame, key: str, shape: tuple[int, ...], density: float) -> DataFrame:
    """The rows with a packed grid of independent cells drawn from their keys (``depth, height, width, cells``), in the key's place.

    A row without a key (null, or a null word) has no grid: null cells.
    """
    size = full_shape(shape)
    cells, density = int(np.prod(size)), check_density(density)
    names = [c for c in df.columns if c != key]
    keyed = df.select(*names, F.col(key)["k0"].alias("_k0"), F.col(key)["k1"].alias("_k1"))
    fit = max(1, DRAWN // cells)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, fit):
                part = batch.slice(at, fit)
                none = np.array(part.column("_k0").is_null()) | np.array(part.column("_k1").is_null())
                k0, k1 = (part.column(c).fill_null(0).to_numpy() for c in ("_k0", "_k1"))
                drawn = threefry.alive(k0, k1, cells, density)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * cells), pa.array(drawn.ravel()), mask=pa.array(none))
                sides = [pa.array(np.full(len(drawn), n, np.int32)) for n in size]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *sides, lists], [*names, "depth", "height", "width", "cells"])

    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return keyed.mapInArrow(draw, f"{types}depth int, height int, width int, cells array<tinyint>")
