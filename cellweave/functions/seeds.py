"""Seeded randomness that depends on (seed, stream, item, index) alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_seed(seed: int) -> int:
    if isinstance(seed, bool) or not isinstance(seed, int):
        raise TypeError("a seed must be an integer")
    return seed


def check_density(density: float) -> float:
    if isinstance(density, bool) or not isinstance(density, (int, float)) or not 0 <= density <= 1:
        raise ValueError("density must be a number between 0 and 1")
    return float(density)


def word(seed: int, stream: str, item: Column, index: Column) -> Column:
    """A 32-bit word as a long: the first eight hexadecimal digits of an MD5 over the four parts."""
    key = F.concat_ws(":", F.lit(str(check_seed(seed))), F.lit(stream), item.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def alive(seed: int, stream: str, item: Column, index: Column, density: float) -> Column:
    """1 with probability ``density``, else 0; exact at 0 and 1."""
    return (word(seed, stream, item, index) / F.lit(float(1 << 32)) < F.lit(check_density(density))).cast("tinyint")


def rule_bits(seed: int, stream: str, item: Column, dims: int) -> Column:
    """A rule code of fair bits: 18 in 2D, 54 in 3D, from one or two words."""
    low = word(seed, stream, item, F.lit(0))
    if dims == 2:
        return low.bitwiseAND(F.lit((1 << 18) - 1).cast("long"))
    return low + word(seed, stream, item, F.lit(1)).bitwiseAND(F.lit((1 << 22) - 1).cast("long")) * F.lit(1 << 32).cast("long")
