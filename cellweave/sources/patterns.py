"""Small named patterns and patterns written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Live cells of the named patterns, one line a row.
PATTERNS = {
    "block": "##\n##",
    "blinker": "###",
    "glider": ".#.\n..#\n###",
}


def check_text(text: str) -> list[str]:
    """The rows of a pattern's text: trimmed, blank ones left out, of equal widths and known signs."""
    rows = [line.strip() for line in text.splitlines() if line.strip()]
    if not rows:
        raise ValueError("a pattern needs at least one row")
    if len({len(row) for row in rows}) > 1:
        raise ValueError("all rows of a pattern must be equally wide")
    if set("".join(rows)) - set("#1.0"):
        raise ValueError("a pattern is written with # or 1 for live and . or 0 for dead cells")
    return rows


def pattern_from_text(spark: SparkSession, text: str) -> DataFrame:
    """``y, x, alive`` of a pattern's text."""
    check_text(text)
    return pattern_cells(spark.createDataFrame([("pattern", text)], "name string, text string")).drop("name")


def pattern_cells(patterns: DataFrame) -> DataFrame:
    """``name, y, x, alive`` for rows (name, text)."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda t: F.trim(t)), lambda t: t != "")
    rows = patterns.select("name", F.posexplode(lines).alias("y", "line"))
    return rows.select("name", "y", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("x", "sign")).select("name", "y", "x", F.col("sign").isin("#", "1").cast("tinyint").alias("alive"))


def all_patterns(spark: SparkSession) -> DataFrame:
    return pattern_cells(spark.createDataFrame(sorted(PATTERNS.items()), "name string, text string"))


def get_pattern(spark: SparkSession, name: str) -> DataFrame:
    """A named pattern, in any case."""
    if name.lower() not in PATTERNS:
        raise KeyError(f"unknown pattern {name!r}; there are {', '.join(sorted(PATTERNS))}")
    return all_patterns(spark).where(F.col("name") == name.lower()).drop("name")
