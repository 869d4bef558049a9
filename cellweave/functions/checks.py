"""What requests are accepted, as expressions over tables of requests; null is not accepted.  ``workload`` and ``seeds`` have the same for
single requests, which raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.rules import COUNTS


def at_least(number: Column, least: int) -> Column:
    """A whole number (generations, recording intervals, counts) of at least ``least``; one with a fraction is none."""
    return F.coalesce((number >= least) & (number == F.floor(number)), F.lit(False))


def dimensions(*sizes: Column) -> Column:
    """Sizes of a grid: each a whole number of at least 1."""
    return reduce(Column.__and__, [at_least(n, 1) for n in sizes])


def density(share: Column) -> Column:
    """A share between 0 and 1; NaN is none."""
    return F.coalesce(share.between(0, 1) & ~F.isnan(share.cast("double")), F.lit(False))


def mask(flags: Column, dims: int) -> Column:
    """A rule's mask: one flag, 0 or 1, for each count of neighbours."""
    return F.coalesce((F.size(flags) == COUNTS[dims]) & F.forall(flags, lambda x: F.coalesce(x.isin(0, 1), F.lit(False))), F.lit(False))
