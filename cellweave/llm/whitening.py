"""Embedding whitening (operator 11) by matrix-free block Lanczos.

The covariance is never formed.  A pass over the table multiplies it with a block of vectors: every task centres its own rows,
adds up XᵀXv and hands on one number for each entry of the block, which Spark sums.  The driver holds the Lanczos basis
(dimensions x a few blocks), orthogonalises each new block against all of it, twice, and starts anew with random directions where a
block breaks down.  It stops when the residuals of the wanted components vanish at double precision, or the basis spans the
whole space; a basis that grows long is folded into its best Ritz vectors, whose images are known.  Nothing is shuffled but those
sums, so a pass costs one scan whatever the number of rows, and one very common vector costs nothing special.

Sums and deviations are exact integers; the trace comes from the deviations, in the first pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import read_table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: ``floor(SCALE * entry)`` is held within plus and minus this, so that integers stay integers.
LARGEST = 1 << 40
#: Residuals, and eigenvalues of a rank that is not there, relative to the largest eigenvalue.
RESIDUAL, RANK = 1e-13, 1e-12
#: Blocks of the basis before it is folded into Ritz vectors.
BASIS_BLOCKS = 24
MAX_PASSES = 1000
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """What a pass needs of the fit list: number, exact sums, and the mean as an integer and the rest."""

    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n * x - S)^2 of each row; null beyond a long.  Arithmetic modulo 2^64 is exact for what fits."""
        wrapped = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        t = x.astype(np.uint64) * np.uint64(self.n % (1 << 64)) - wrapped
        about = (self.centred(x) ** 2).sum(1) * float(self.n) ** 2
        return pa.array((t * t).sum(1, dtype=np.uint64).view(np.int64), mask=about >= 2.0**63 * (1 - 1e-9))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their integers, a row each; short rows are filled up with entries of zero."""
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.array(column.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = np.array(column.is_valid()) & (bad[ends] == bad[ends - sizes])
    width = int(sizes[good].max(initial=0))
    out = np.zeros((int(good.sum()), width))
    inside = np.arange(width) < sizes[good][:, None]
    out[inside] = values[np.repeat(good, sizes)]
    with np.errstate(over="ignore"):
        return good, np.clip(np.floor(out * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    good, x = _rows(column)
    if x.shape[1] < width:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=SHIFT)
    return good, x


def _fit(vectors: DataFrame) -> Fit:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _rows(batch.column("v"))
            total = (x - SHIFT).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([len(x), *total.tolist()], pa.int64())], ["i", "total"])

    found = vectors.select("v").mapInArrow(sums, "i int, total long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {r["i"]: int(r["total"]) for r in found}
    n = by.pop(-1, 0)
    return Fit(n, [by[i] + SHIFT * n for i in sorted(by)])


def _summed(vectors: DataFrame, width: int, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """One pass: ``add(x, total)`` adds what a batch's integers give to its task's ``size`` numbers; Spark sums over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(_matrix(batch.column("v"), width)[1], total)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "value"])

    out = np.zeros(size)
    for r in vectors.select("v").mapInArrow(partial, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[r["i"]] = r["value"]
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for the block, orthogonal to the basis; a column that breaks down starts anew at random."""
    done = basis
    for column in block.T:
        if done.shape[1] == len(done):
            break
        size = np.linalg.norm(column)
        while True:
            for _ in range(2):
                column = column - done @ (done.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * size:
                break
            column = random.normal(size=len(done))
            size = np.linalg.norm(column)
        column = column / left
        column = column - done @ (done.T @ column)
        done = np.column_stack([done, column / np.linalg.norm(column)])
    return done[:, basis.shape[1] :]


def leading_eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric operator ``multiply``."""
    wanted = min(wanted, width)
    random = np.random.default_rng(seed)
    basis = image = np.empty((width, 0))
    fresh = _orthonormal(random.normal(size=(width, wanted)), basis, random)
    for _ in range(MAX_PASSES):
        last = multiply(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, last])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :wanted]
        residual = np.linalg.norm(image @ turn[:, :wanted] - ritz * values[:wanted], axis=0)
        if basis.shape[1] >= width or residual.max() <= RESIDUAL * abs(values[0]):
            return values[:wanted], ritz / np.linalg.norm(ritz, axis=0)
        fresh = _orthonormal(last, basis, random)
        if basis.shape[1] >= BASIS_BLOCKS * wanted:
            basis, image = basis @ turn[:, : 2 * wanted], image @ turn[:, : 2 * wanted]
    raise RuntimeError(f"{wanted} components did not converge in {MAX_PASSES} passes")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, from the fit too.  A vector shorter than the longest counts
    as having zeros there, an empty one as all zeros; entries beyond 2^40 / 1024 count as that much.  Repeated rows and null ids count
    and come out each.  Components with no variance (constant vectors, fewer dimensions or vectors than components) have
    no rows (less than 1e-12 of the first's counts as none); ties between eigenvalues may turn their components into each other.  ``deviation`` is null where it is beyond a long.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    vectors = df.select(df[id_col].alias("vec_id"), df[vector_col].alias("v"))
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    fit = _fit(vectors)
    width = len(fit.sums)
    if not fit.n or not width:
        return spark.createDataFrame([], schema)
    squares: list[float] = []

    def multiply(block: np.ndarray) -> np.ndarray:
        cells = block.size

        def add(x: np.ndarray, total: np.ndarray) -> None:
            z = fit.centred(x)
            total[:cells] += (z.T @ (z @ block)).ravel()
            total[cells] += (z * z).sum()  # the deviations over n^2

        found = _summed(vectors, width, cells + 1, add) / fit.n
        squares.append(found[cells])
        return found[:cells].reshape(block.shape)

    values, axes = leading_eigenpairs(multiply, width, components)
    keep = (values > 0) & (values > RANK * values[0])
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn = axes / np.sqrt(values)

    def moments(x: np.ndarray, total: np.ndarray) -> None:
        w = fit.centred(x) @ turn
        total[: k * k] += (w.T @ w).ravel()
        total[k * k :] += w.sum(0)

    found = _summed(vectors, width, k * k + k, moments) / fit.n
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :]) - np.eye(k)).max())
    explained = values / squares[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _matrix(batch.column("v"), width)
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column("vec_id").filter(pa.array(good)).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fit.n)),
                fit.deviations(x).take(each),
                pa.array((fit.centred(x) @ turn).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of all ``embeddings``."""
    return whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
