"""Grid measures as column expressions over packed cells, and as aggregations over a cell relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x)).cast("int")


def alive_count(cells: Column) -> Column:
    return _count(F.transform(cells, lambda c: c != 0))


def alive_fraction(cells: Column) -> Column:
    return alive_count(cells).cast("double") / F.size(cells)


def changed_cell_count(previous: Column, current: Column) -> Column:
    return _count(F.zip_with(previous, current, lambda a, b: (a != 0) != (b != 0)))


def has_changed(previous: Column, current: Column) -> Column:
    return changed_cell_count(previous, current) > 0


def transition_counts(previous: Column, current: Column) -> Column:
    """Struct of alive, changed, births and deaths."""
    return F.struct(
        alive_count(current).alias("alive"),
        changed_cell_count(previous, current).alias("changed"),
        _count(F.zip_with(previous, current, lambda a, b: (a == 0) & (b != 0))).alias("births"),
        _count(F.zip_with(previous, current, lambda a, b: (a != 0) & (b == 0))).alias("deaths"),
    )


def with_fractions(metrics: DataFrame, total: Column) -> DataFrame:
    """Counts and their shares of all cells, in the order of a session's metric payload."""
    share = lambda c: (F.col(c) / total.cast("double"))
    others = [c for c in metrics.columns if c not in ("alive", "changed", "births", "deaths")]
    return metrics.select(
        *others, "alive", share("alive").alias("alive_fraction"), F.col("changed").alias("changed_cells"), share("changed").alias("changed_fraction"),
        "births", share("births").alias("birth_fraction"), "deaths", share("deaths").alias("death_fraction"),
    )


def point_value(fraction: Column, count: Column, total: Column) -> Column:
    """A chart's value: the fraction, else count / total, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fraction, count / total)))


def cell_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Transition counts of two cell relations (keys, alive), by grid: the first of ``keys``; missing cells are dead."""
    a, b = before.select(*keys, F.col("alive").alias("_a")), after.select(*keys, F.col("alive").alias("_b"))
    joined = a.join(b, keys, "full").select(*keys, (F.coalesce("_a", F.lit(0)) != 0).alias("a"), (F.coalesce("_b", F.lit(0)) != 0).alias("b"))
    count = lambda cond, name: F.count_if(cond).cast("int").alias(name)
    return joined.groupBy(keys[0]).agg(count(F.col("b"), "alive"), count(F.col("a") != F.col("b"), "changed"), count(~F.col("a") & F.col("b"), "births"), count(F.col("a") & ~F.col("b"), "deaths"))
