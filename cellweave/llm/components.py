"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import dealt_anew
from cellweave.sources.shared import materialise

MAX_ROUNDS = 60


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under edges ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            next_ = label[label]
            if np.array_equal(next_, label):
                break
            label = next_


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v), u > v.  Large: each node hands its larger neighbours to its smallest one; small: its
    smaller neighbours and itself."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew(F.col("u")).alias("_u"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionByName(least.select(F.col("_u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _state(pairs: DataFrame) -> tuple:
    """Number and hash of the edges: two rounds that agree in it have settled."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (long, not null); root is the component's smallest node.

    A node's neighbours are only ever met through a minimum and an equi-join, so a hub with a third of all edges is
    split by Spark's skew handling; every round is written to the shared folder.  Self-loops are ignored, and an
    empty edge table gives an empty result.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialise(pairs, "edges")
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        pairs = materialise(_star(_star(pairs, large=True), large=False), "edges")
        seen, state = state, _state(pairs)
        if state == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
