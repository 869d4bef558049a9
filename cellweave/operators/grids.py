"""Grids as DataFrames.

*Packed*: a row per grid, ``grid_id long, depth int, height int, width int, cells array<tinyint>`` with the cell (z, y, x) at
``(z * height + y) * width + x``; 2D grids have depth 1.  *Cells*: a row per cell, ``grid_id, z, y, x, alive`` (2D without z).
Cells are 0 or 1: what comes in is made binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.seeds import alive
from cellweave.functions.workload import whole

PACKED = "grid_id long, depth int, height int, width int, cells array<tinyint>"


def axes(dims: int) -> list[str]:
    return ["z", "y", "x"][3 - dims :]


def check_shape(*shape: int) -> tuple[int, ...]:
    return tuple(whole(n, "each dimension") for n in shape)


def full_shape(shape: tuple[int, ...]) -> tuple[int, int, int]:
    """(depth, height, width) of a 2D or 3D shape."""
    shape = check_shape(*shape)
    if len(shape) not in (2, 3):
        raise ValueError("a grid has 2 or 3 dimensions")
    return (1, *shape) if len(shape) == 2 else shape  # type: ignore[return-value]


def _packed(ids: DataFrame, shape: tuple[int, ...], cells: Column) -> DataFrame:
    d, h, w = full_shape(shape)
    return ids.select("grid_id", F.lit(d).alias("depth"), F.lit(h).alias("height"), F.lit(w).alias("width"), cells.cast("array<tinyint>").alias("cells"))


def empty_grids(spark: SparkSession, shape: tuple[int, ...], count: int = 1) -> DataFrame:
    """``count`` dead grids."""
    ids = spark.range(count).withColumnRenamed("id", "grid_id")
    return _packed(ids, shape, F.array_repeat(F.lit(0), int(np.prod(full_shape(shape)))))


def random_grids(spark: SparkSession, seed: int, shape: tuple[int, ...], density: float, count: int = 1, stream: str = "grid") -> DataFrame:
    """``count`` grids of independent cells, alive with probability ``density``; the same on any cluster."""
    cells = int(np.prod(full_shape(shape)))
    ids = spark.range(count).withColumnRenamed("id", "grid_id")
    return _packed(ids, shape, F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: alive(seed, stream, F.col("grid_id"), i, density)))


def grids_from_arrays(spark: SparkSession, arrays: list) -> DataFrame:
    """Packed grids from array-likes of one number of dimensions each; numbered in order."""
    rows = []
    for i, values in enumerate(arrays):
        values = np.asarray(values)
        if values.ndim not in (2, 3) or not values.size:
            raise ValueError("a grid is a 2D or 3D array that is not empty")
        rows.append((i, *full_shape(values.shape), (values != 0).astype(np.uint8).ravel().tolist()))
    return spark.createDataFrame(rows, PACKED)


def grids_to_arrays(grids: DataFrame, dims: int = 2) -> dict[int, np.ndarray]:
    """The grids on the driver, by id: for inspection and file formats."""
    out = {}
    for row in grids.select("grid_id", "depth", "height", "width", "cells").toLocalIterator():
        shape = (row["height"], row["width"]) if dims == 2 else (row["depth"], row["height"], row["width"])
        out[row["grid_id"]] = np.array(row["cells"], np.uint8).reshape(shape)
    return out


def grids_from_vectors(df: DataFrame, id_col: str, vector: Column, shape: tuple[int, ...]) -> DataFrame:
    """Packed grids from a column of number arrays: positive is alive, null numbers and null vectors are dead.  A vector of
    another length than the shape's is an error."""
    d, h, w = full_shape(shape)
    n = d * h * w
    bits = F.transform(vector, lambda v: F.coalesce(v > 0, F.lit(False)).cast("tinyint"))
    dead = F.array_repeat(F.lit(0).cast("tinyint"), n)
    bits = F.when(vector.isNull(), dead).when(F.size(vector) == n, bits).otherwise(F.raise_error(F.format_string(f"a vector of %d numbers is no grid of {n} cells", F.size(vector))))
    return df.select(F.col(id_col).cast("long").alias("grid_id"), F.lit(d).alias("depth"), F.lit(h).alias("height"), F.lit(w).alias("width"), bits.alias("cells"))


def as_grids(grids: DataFrame) -> DataFrame:
    """Packed grids made binary: whatever is not zero is alive."""
    return grids.withColumn("cells", F.transform("cells", lambda c: (c != 0).cast("tinyint")))


def to_cells(grids: DataFrame, dims: int = 2) -> DataFrame:
    """Every cell of packed grids as a row (other columns stay in front)."""
    others = [c for c in grids.columns if c not in ("depth", "height", "width", "cells")]
    flat = grids.select(*others, "height", "width", F.posexplode("cells").alias("i", "alive"))
    places = {"z": F.floor(F.col("i") / (F.col("height") * F.col("width"))), "y": F.pmod(F.floor(F.col("i") / F.col("width")), F.col("height")), "x": F.pmod("i", "width")}
    return flat.select(*others, *[places[a].cast("int").alias(a) for a in axes(dims)], "alive")


def from_cells(cells: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Packed grids from a cell relation; cells that are not there are dead.

    A grid's live cells meet in one row, so its size is bounded by a row's; larger grids stay relations.
    """
    d, h, w = full_shape(shape)
    size = d * h * w

    def fill(batches):
        for batch in batches:
            live = batch.column("live")
            cells = np.zeros((batch.num_rows, size), np.int8)
            offsets = live.offsets.to_numpy()
            cells[np.repeat(np.arange(batch.num_rows), np.diff(offsets)), live.flatten().to_numpy()] = 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("grid_id"), lists], ["grid_id", "cells"])

    z = F.col("z") if "z" in cells.columns else F.lit(0)
    place = ((z * h + F.col("y")) * w + F.col("x")).cast("int")
    live = cells.groupBy(F.col("grid_id").cast("long").alias("grid_id")).agg(F.collect_set(F.when(F.col("alive") != 0, place)).alias("live"))
    return _packed(live.mapInArrow(fill, "grid_id long, cells array<tinyint>"), shape, F.col("cells"))


def place_pattern(grids: DataFrame, pattern: DataFrame, row: int, column: int) -> DataFrame:
    """2D packed grids with a pattern (rows ``y, x, alive``) written over the rectangle at (row, column), dead cells
    included.  The pattern must fit: no wrapping.  The pattern is no larger than a grid in a row and goes along."""
    high, wide = (None if n is None else n + 1 for n in pattern.agg(F.max("y"), F.max("x")).first())
    if high is None:
        return grids
    row, column = whole(row, "row", 0), whole(column, "column", 0)
    small = grids.where((F.col("height") < row + high) | (F.col("width") < column + wide)).limit(1).count()
    if small:
        raise ValueError(f"a pattern of {high}x{wide} does not fit at ({row}, {column})")
    # A place a row, so no more rows than cells in one of the grids.
    points = [tuple(r) for r in pattern.groupBy("y", "x").agg(F.max((F.col("alive") != 0).cast("int"))).collect()]
    y, x, value = np.array(points).T

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, starts, wide = _flat(batch)
            at = starts[:, None] + (y + row) * wide[:, None] + x + column
            cells[at] = value
            yield _with_cells(batch, cells)

    return grids.mapInArrow(scatter, grids.schema)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A copy of all cells of a batch of packed grids, one grid after the other, where each begins, and the widths."""
    column = batch.column("cells")
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return column.flatten().to_numpy(zero_copy_only=False).copy(), starts, batch.column("width").to_numpy()


def _with_cells(batch: pa.RecordBatch, cells: np.ndarray, names: list[str] | None = None) -> pa.RecordBatch:
    column = batch.column("cells")
    lists = pa.ListArray.from_arrays(pa.array(column.offsets.to_numpy() - column.offsets[0].as_py()), pa.array(cells), mask=column.is_null() if column.null_count else None)
    names = names or batch.schema.names
    return pa.RecordBatch.from_arrays([lists if c == "cells" else batch.column(c) for c in names], names)


def slice_grids(grids: DataFrame, axis: str, index: int) -> DataFrame:
    """One plane of 3D packed grids: ``grid_id, height, width, alive, cells``; only that plane's cells are kept."""
    if axis not in ("x", "y", "z"):
        raise ValueError("axis must be x, y or z")
    index = whole(index, "index", 0)
    limit = {"z": "depth", "y": "height", "x": "width"}[axis]
    if grids.where(F.col(limit) <= index).limit(1).count():
        raise ValueError("the slice index is outside the grid")
    d, h, w = grids["depth"], grids["height"], grids["width"]  # not by name: a lambda would see the new height
    if axis == "z":
        high, wide, cells = h, w, F.slice("cells", F.lit(index) * h * w + 1, h * w)
    elif axis == "y":
        high, wide = d, w
        cells = F.transform(F.sequence(F.lit(0), d * w - 1), lambda i: F.get("cells", ((F.floor(i / w) * h + index) * w + F.pmod(i, w)).cast("int")))
    else:
        high, wide = d, h
        cells = F.transform(F.sequence(F.lit(0), d * h - 1), lambda i: F.get("cells", (i * w + index).cast("int")))
    out = grids.select("grid_id", high.alias("height"), wide.alias("width"), cells.alias("cells"))
    return out.select("grid_id", "height", "width", F.aggregate("cells", F.lit(0), lambda a, c: a + c).alias("alive"), "cells")


def edit_cells(grids: DataFrame, edits: DataFrame) -> DataFrame:
    """2D packed grids after a stroke of edits (grid_id, y, x, place, mode): ``paint``, ``erase`` or, else, ``toggle`` a cell.

    A stroke meets a cell once: of several edits of a cell the one with the least ``place`` (then mode) counts.  A grid's edits
    meet it in one row and are scattered into it: cells plus edits.  Cells outside the grid and edits of grids that are not there change nothing.
    """
    first = edits.groupBy("grid_id", "y", "x").agg(F.min(F.struct("place", "mode"))["mode"].alias("mode"))
    code = F.when(F.col("mode") == "paint", 1).when(F.col("mode") == "erase", 0).otherwise(2).cast("tinyint")
    entry = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), code.alias("mode"))
    per_grid = first.groupBy(F.col("grid_id").alias("_id")).agg(F.collect_list(entry).alias("_edits"))
    joined = grids.join(per_grid, F.col("grid_id") == F.col("_id"), "left").drop("_id")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, starts, wide = _flat(batch)
            edits = batch.column("_edits")
            own = np.repeat(np.arange(batch.num_rows), np.array(edits.value_lengths().fill_null(0)))
            y, x, mode = (f.to_numpy(zero_copy_only=False) for f in edits.flatten().flatten())
            high = batch.column("height").to_numpy()
            fits = (y >= 0) & (x >= 0) & (y < high[own]) & (x < wide[own])
            at = (starts[own] + y.astype(np.int64) * wide[own] + x)[fits]
            cells[at] = np.where(mode[fits] == 2, 1 - cells[at], mode[fits])
            yield _with_cells(batch, cells, names)

    names = grids.columns
    return joined.select(*names, "_edits").mapInArrow(scatter, grids.schema)
