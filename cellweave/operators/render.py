"""Compact views of packed grids: bit-packed planes, capped voxel lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.workload import whole


def pack_bits(grids: DataFrame) -> DataFrame:
    """``grid_id, height, width, bytes array<int>, content binary``: eight cells a byte, the first in the lowest bit,
    padded with dead cells."""
    n = F.size("cells")
    octets = F.transform(
        F.sequence(F.lit(0), F.floor((n + 7) / 8).cast("int") - 1),
        lambda b: F.aggregate(F.slice("cells", b * 8 + 1, F.lit(8)), F.struct(F.lit(0).alias("v"), F.lit(1).alias("bit")), lambda a, c: F.struct((a["v"] + c * a["bit"]).alias("v"), (a["bit"] * 2).alias("bit")), lambda a: a["v"]),
    )
    packed = grids.select("grid_id", "height", "width", octets.alias("bytes"))
    digits = F.array_join(F.transform("bytes", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return packed.withColumn("content", F.unhex(digits))


def unpack_bits(packed: DataFrame) -> DataFrame:
    """The inverse: ``grid_id, depth, height, width, cells``."""
    cells = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.call_function("shiftright", F.get("bytes", F.floor(i / 8).cast("int")), F.pmod(i, F.lit(8))).bitwiseAND(F.lit(1)).cast("tinyint"))
    return packed.select("grid_id", F.lit(1).alias("depth"), "height", "width", cells.alias("cells"))


def sample_positions(count: Column, limit: int) -> Column:
    """Which of ``count`` ordered things an even sample of ``limit`` shows, counted from 0; all if they are no more."""
    limit = whole(limit, "max_voxels")
    last = count - 1
    if limit == 1:
        even = F.array(F.lit(0))
    else:
        even = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.when(i == limit - 1, last).otherwise(F.floor(i.cast("double") * (last.cast("double") / F.lit(float(limit - 1)))).cast("int")))
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= limit, F.sequence(F.lit(0), last)).otherwise(even)


def voxels(grids: DataFrame, max_voxels: int = 75_000) -> DataFrame:
    """Live voxels of 3D grids: ``grid_id, depth, height, width, live, sampled, voxels array<struct<z, y, x>>``."""
    flat = F.filter(F.transform("cells", lambda c, i: F.when(c != 0, i)), lambda i: i.isNotNull())
    lived = grids.select("grid_id", "depth", "height", "width", flat.alias("_live"))
    lived = lived.select("*", F.size("_live").alias("live"), sample_positions(F.size("_live"), max_voxels).alias("_at"))
    h, w = F.col("height"), F.col("width")
    place = lambda i: F.struct(F.floor(i / (h * w)).cast("int").alias("z"), F.pmod(F.floor(i / w), h).cast("int").alias("y"), F.pmod(i, w).alias("x"))
    return lived.select("grid_id", "depth", "height", "width", "live", (F.col("live") > max_voxels).alias("sampled"), F.transform("_at", lambda p: place(F.get("_live", p))).alias("voxels"))


def voxel_bytes(shown: DataFrame) -> DataFrame:
    """``voxels`` rows with ``content``: unsigned bytes z, y, x of each voxel (modulo 256)."""
    octet = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")
    return shown.withColumn("content", F.unhex(F.array_join(F.transform("voxels", lambda v: F.concat(octet(v["z"]), octet(v["y"]), octet(v["x"]))), "")))


def metric_history(points: DataFrame, session: str, generation: str, order: str, limit: int = 180) -> DataFrame:
    """The newest ``limit`` points of each session: of equal generations the last written counts.

    Ranks are taken over one row per generation, after map-side aggregation.
    """
    from pyspark.sql import Window

    others = [c for c in points.columns if c not in (session, generation)]
    newest = points.groupBy(session, generation).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("p"))
    ranked = newest.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(generation)))).where(F.col("_r") <= limit)
    return ranked.select(session, generation, *[F.col(f"p.{c}").alias(c) for c in [order, *[c for c in others if c != order]]])
