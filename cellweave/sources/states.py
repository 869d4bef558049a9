"""Saved states: JSON, NPY and NPZ files, and Parquet for many grids at once.

A state is a grid with its rule and how it came about (seed, density, generation).  The single-state functions work on
the driver; ``read_states`` and ``read_arrays`` read folders of files on the executors.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.rules import Rule, parse_rule, parse_rule_3d
from cellweave.operators.grids import PACKED, full_shape

STATE_SCHEMA = "dimensions int, rule string, depth int, height int, width int, seed long, density double, generation int, cells array<tinyint>"


@dataclass(frozen=True)
class SavedState:
    grid: np.ndarray
    rule: Rule
    seed: int | None = None
    density: float | None = None
    generation: int = 0

    @property
    def dims(self) -> int:
        return self.grid.ndim

    @property
    def depth(self) -> int:
        return self.grid.shape[0] if self.dims == 3 else 1

    @property
    def height(self) -> int:
        return self.grid.shape[-2]

    @property
    def width(self) -> int:
        return self.grid.shape[-1]


def _binary(values, dims: int | None = None) -> np.ndarray:
    grid = (np.asarray(values) != 0).astype(np.uint8)
    if grid.ndim not in ((2, 3) if dims is None else (dims,)) or not grid.size:
        raise ValueError("a state holds one grid of two or three dimensions")
    return grid


def state_to_dict(grid, rule: Rule, *, seed: int | None = None, density: float | None = None, generation: int = 0) -> dict:
    grid = _binary(grid, rule.dims)
    if generation < 0:
        raise ValueError("generation cannot be negative")
    head = {"dimensions": 3} if rule.dims == 3 else {}
    size = {"depth": grid.shape[0], "height": grid.shape[1], "width": grid.shape[2]} if rule.dims == 3 else {"width": grid.shape[1], "height": grid.shape[0]}
    return {**head, "rule": rule.text, **size, "seed": seed, "density": density, "generation": int(generation), "grid": grid.tolist()}


def dict_to_state(data: dict) -> SavedState:
    missing = {"rule", "grid"} - set(data)
    if missing:
        raise ValueError(f"the state lacks {', '.join(sorted(missing))}")
    dims = 3 if data.get("dimensions") == 3 else 2
    grid = _binary(data["grid"], dims)
    for name, size in zip(("depth", "height", "width")[3 - dims :], grid.shape, strict=True):
        if data.get(name) is not None and data[name] != size:
            raise ValueError(f"{name} is {data[name]}, but the grid has {size}")
    rule = parse_rule_3d(data["rule"]) if dims == 3 else parse_rule(data["rule"])
    return SavedState(grid, rule, data.get("seed"), data.get("density"), int(data.get("generation") or 0))


def export_state_json(grid, rule: Rule, **about) -> str:
    return json.dumps(state_to_dict(grid, rule, **about), indent=2)


def import_state_json(text: str) -> SavedState:
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("a state is a JSON object")
    return dict_to_state(data)


def state_to_npz_bytes(grid, rule: Rule, **about) -> bytes:
    data = state_to_dict(grid, rule, **about)
    out = io.BytesIO()
    np.savez_compressed(out, grid=np.array(data.pop("grid"), np.uint8), metadata=json.dumps(data))
    return out.getvalue()


def state_from_npz_bytes(content: bytes) -> SavedState:
    with np.load(io.BytesIO(content), allow_pickle=False) as held:
        return dict_to_state({**json.loads(str(held["metadata"])), "grid": held["grid"]})


def save_state(path: str | Path, grid, rule: Rule, **about) -> None:
    path = Path(path)
    if path.suffix == ".json":
        path.write_text(export_state_json(grid, rule, **about), encoding="utf-8")
    elif path.suffix == ".npz":
        path.write_bytes(state_to_npz_bytes(grid, rule, **about))
    else:
        raise ValueError("a state is saved as .json or .npz")


def load_state(path: str | Path) -> SavedState:
    path = Path(path)
    if path.suffix == ".json":
        return import_state_json(path.read_text(encoding="utf-8"))
    if path.suffix == ".npz":
        return state_from_npz_bytes(path.read_bytes())
    raise ValueError("a state is saved as .json or .npz")


def save_grid(path: str | Path, grid) -> None:
    path, grid = Path(path), _binary(grid)
    if path.suffix == ".npy":
        np.save(path, grid)
    elif path.suffix == ".npz":
        np.savez_compressed(path, grid=grid)
    else:
        raise ValueError("a grid is saved as .npy or .npz")


def _array(content: bytes, suffix: str) -> np.ndarray:
    held = np.load(io.BytesIO(content), allow_pickle=False)
    return _binary(held["grid"] if suffix == ".npz" else held)


def load_grid(path: str | Path, dims: int | None = None) -> np.ndarray:
    path = Path(path)
    if path.suffix not in (".npy", ".npz"):
        raise ValueError("a grid is saved as .npy or .npz")
    return _binary(_array(path.read_bytes(), path.suffix), dims)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Packed grids (``path`` and PACKED; ids are hashes of the paths) from a folder of .npy and .npz files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, ident, content in zip(*(batch.column(c).to_pylist() for c in ("path", "grid_id", "content")), strict=True):
                grid = _array(content, Path(name).suffix)
                d, h, w = full_shape(grid.shape)
                rows.append({"path": name, "grid_id": ident, "depth": d, "height": h, "width": w, "cells": grid.ravel().tolist()})
            schema = pa.schema([("path", pa.string()), ("grid_id", pa.int64()), ("depth", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("cells", pa.list_(pa.int8()))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path)
    return files.select("path", F.xxhash64("path").alias("grid_id"), "content").mapInArrow(decode, f"path string, {PACKED}")


def read_states(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    """States (STATE_SCHEMA) from a folder of JSON files; files that are no such state are left out by their missing
    rule or grid."""
    nested = "array<" * dims + "tinyint" + ">" * dims
    raw = spark.read.schema(f"dimensions int, rule string, depth int, height int, width int, seed long, density double, generation int, grid {nested}").json(path, multiLine=True)
    flat = F.flatten("grid") if dims == 2 else F.flatten(F.flatten("grid"))
    good = raw.where(F.col("rule").isNotNull() & F.col("grid").isNotNull())
    size = (F.lit(1), F.size("grid"), F.size(F.get("grid", 0))) if dims == 2 else (F.size("grid"), F.size(F.get("grid", 0)), F.size(F.get(F.get("grid", 0), 0)))
    return good.select(F.lit(dims).alias("dimensions"), "rule", *[s.alias(n) for s, n in zip(size, ("depth", "height", "width"), strict=True)], "seed", "density", F.coalesce("generation", F.lit(0)).alias("generation"), F.transform(flat, lambda c: (c != 0).cast("tinyint")).alias("cells"))


def state_json(states: DataFrame) -> DataFrame:
    """``states`` (STATE_SCHEMA) with a column ``json`` as ``read_states`` reads it; write it with ``write.text``."""
    rows = F.transform(F.sequence(F.lit(0), F.col("depth") * F.col("height") - 1), lambda r: F.slice("cells", r * F.col("width") + 1, F.col("width")))
    planes = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda z: F.slice("_rows", z * F.col("height") + 1, F.col("height")))
    shaped = states.withColumn("_rows", rows)
    common = [F.col(c) for c in ("rule", "depth", "height", "width", "seed", "density", "generation")]
    flat = F.to_json(F.struct(*[c for c in common if c is not common[1]], F.col("_rows").alias("grid")), {"ignoreNullFields": "false"})
    solid = F.to_json(F.struct(F.lit(3).alias("dimensions"), *common, planes.alias("grid")), {"ignoreNullFields": "false"})
    return shaped.select(*states.columns, F.when(F.col("dimensions") == 3, solid).otherwise(flat).alias("json"))


def _shape(depth: int, height: int, width: int, dims: int) -> tuple[int, ...]:
    return (depth, height, width)[3 - dims :]


def grid_files(grids: DataFrame, suffix: str, dims: int = 2) -> DataFrame:
    """``name, content`` of a .npy or .npz file for each packed grid; write them with ``write_files``."""
    if suffix not in (".npy", ".npz"):
        raise ValueError("a grid is saved as .npy or .npz")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for ident, depth, height, width, cells in zip(*(batch.column(c).to_pylist() for c in ("grid_id", "depth", "height", "width", "cells")), strict=True):
                grid, out = _binary(np.array(cells).reshape(_shape(depth, height, width, dims))), io.BytesIO()
                np.save(out, grid) if suffix == ".npy" else np.savez_compressed(out, grid=grid)
                names.append(f"grid-{ident}{suffix}")
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    return grids.select("grid_id", "depth", "height", "width", "cells").mapInArrow(encode, "name string, content binary")


def state_files(states: DataFrame, suffix: str, name_col: str) -> DataFrame:
    """``name, content`` of a .json or .npz file for each state (``name_col`` and STATE_SCHEMA)."""
    if suffix not in (".json", ".npz"):
        raise ValueError("a state is saved as .json or .npz")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for row in batch.to_pylist():
                dims = row["dimensions"]
                grid = np.array(row["cells"]).reshape(_shape(row["depth"], row["height"], row["width"], dims))
                rule, about = (parse_rule if dims == 2 else parse_rule_3d)(row["rule"]), {k: row[k] for k in ("seed", "density", "generation")}
                names.append(f"state-{row['_name']}{suffix}")
                contents.append(export_state_json(grid, rule, **about).encode() if suffix == ".json" else state_to_npz_bytes(grid, rule, **about))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    return states.withColumn("_name", F.col(name_col)).drop(*({name_col} - {"_name"})).mapInArrow(encode, "name string, content binary")


def read_state_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and the state (STATE_SCHEMA) of every .json and .npz file in a folder; a file that is no state is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("dimensions", pa.int32()), ("rule", pa.string()), ("depth", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("seed", pa.int64()), ("density", pa.float64()), ("generation", pa.int32()), ("cells", pa.list_(pa.int8()))])
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                s = import_state_json(content.decode()) if name.endswith(".json") else state_from_npz_bytes(content)
                rows.append({"path": name, "dimensions": s.dims, "rule": s.rule.text, "depth": s.depth, "height": s.height, "width": s.width, "seed": s.seed, "density": s.density, "generation": s.generation, "cells": s.grid.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,npz}").load(path)
    return files.select("path", "content").mapInArrow(decode, f"path string, {STATE_SCHEMA}")
