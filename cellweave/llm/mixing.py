"""Mixing sources to target weights (operator 8): pivotal dependent rounding in a reduction tree.

Every document of a source starts with the same expected number of copies, target / source size.  Its whole part is
taken; the fraction is rounded by the pivotal method on words: two documents exchange words, at random but fairly, until
one of them holds none or all of its own, so the words taken from the pair never change.  Documents meet in hash buckets
of about ``FAN_IN`` rows (a hot source just has more buckets); each bucket leaves at most one fractional document,
and these meet on the next level, until one is left in a source.  That last document is taken in part, rounded to
whole words, so a source's words differ from its target by rounding only.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import WORD, maybe_broadcast, read_table
from cellweave.sources.shared import materialise

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 20240229
FAN_IN = 200
#: Source statistics are broadcast up to this many sources.
BROADCAST_SOURCES = 20_000
#: Equal rows (in id, source and size) that one task numbers; more are numbered in blocks dealt out to all tasks.
BLOCK = 1024
#: Words below which a remainder is a rounding error.
TINY = 1e-6


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, n_docs, source_size, target``.

    Sources by code point, null last, weigh ``WEIGHTS`` in turn and share the total of all sizes.  No target exceeds
    ``MAX_COPIES`` times its source's size; what is cut off goes to the others by weight.  This is the water level
    that satisfies ``sum(min(cap, level * weight)) = total``, found by sorting sources by ``cap / weight``.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    capped = stats.select("*", weight.cast("double").alias("weight"), (F.col("source_size") * MAX_COPIES).cast("double").alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    steps = capped.withColumns({"level": level, "place": F.row_number().over(filling)})
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(whole)
    steps = steps.withColumn("water", first["level"])
    return steps.select("source", "n_docs", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _numbered(counted: DataFrame) -> DataFrame:
    """A row for each of ``count`` equal ones, numbered by ``copy`` from 0; no array is longer than ``BLOCK`` or than the blocks."""
    columns = [c for c in counted.columns if c != "count"]
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = counted.where(F.col("count") <= BLOCK).select(*columns, F.explode(up_to(F.col("count"))).alias("copy"))
    blocks = counted.where(F.col("count") > BLOCK).select(*columns, "count", F.explode(up_to(F.ceil(F.col("count") / BLOCK))).alias("block"))
    own = F.least(F.lit(BLOCK).cast("long"), F.col("count") - F.col("block") * BLOCK)
    many = blocks.repartition(*columns, "block").select(*columns, "block", F.explode(up_to(own)).alias("copy"))
    many = many.select(*columns, (F.col("block") * BLOCK + F.col("copy")).alias("copy"))
    return few.unionByName(many)


def _fold(item: str) -> str:
    """SQL that folds the sorted array ``items`` of (k, doc_id, size, m): pairs in turn, the fractional one goes on."""
    snap = lambda m, size: f"CASE WHEN {m} < {TINY} THEN 0D WHEN {size} - ({m}) < {TINY} THEN {size} ELSE {m} END"
    pair = f"""named_struct('a', acc.c, 'b', x, 'into_a', least(acc.c.size - acc.c.m, x.m), 'into_b', least(acc.c.m, x.size - x.m),
        'u', shiftrightunsigned(xxhash64({SEED}L, acc.c.k, x.k), 11) / 9007199254740992D)"""
    moved = "IF(q.u * (q.into_a + q.into_b) < q.into_b, q.into_a, -q.into_b)"  # fair: neither document gains on average
    settled = f"""array(
        named_struct('k', r.a.k, 'doc_id', r.a.doc_id, 'size', r.a.size, 'm', {snap("r.a.m + r.d", "r.a.size")}),
        named_struct('k', r.b.k, 'doc_id', r.b.doc_id, 'size', r.b.size, 'm', {snap("r.b.m - r.d", "r.b.size")}))"""
    return f"""aggregate(items, named_struct('c', CAST(NULL AS {item}), 'out', CAST(array() AS array<{item}>)),
      (acc, x) -> CASE WHEN acc.c IS NULL THEN named_struct('c', x, 'out', acc.out) ELSE
        get(transform(transform(transform(array({pair}),
            q -> named_struct('a', q.a, 'b', q.b, 'd', {moved})),
            r -> {settled}),
            two -> named_struct('c', get(filter(two, t -> t.m > 0 AND t.m < t.size), 0),
                                'out', concat(acc.out, filter(two, t -> NOT (t.m > 0 AND t.m < t.size))))), 0) END,
      acc -> CASE WHEN acc.c IS NULL THEN acc.out ELSE concat(acc.out, array(acc.c)) END)"""


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each row: ``doc_id, source, size, source_size, target, taken`` (words).

    ``taken`` lies within the copies around target / source size, at most ``MAX_COPIES`` times ``size``; one document
    a source may be taken in part.  Null and blank texts have size 0 and are not taken; a null source is a source; an
    empty source has target 0; an empty table gives an empty result.  Texts of any length count whole; other columns of ``df`` are not
    read, whatever their names.  Repeated rows are rounded independently, and reruns agree: all randomness is a hash of id, size, and
    the running number among rows that agree in both.
    """
    size = F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    counted = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").count()
    sizes = _numbered(materialise(counted, "sizes"))
    targets = materialise(source_targets(sizes), "targets")
    kind = sizes.schema["doc_id"].dataType.simpleString()
    item = f"struct<k: bigint, doc_id: {kind}, size: double, m: double>"

    named = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(maybe_broadcast(named, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target",
        F.floor(rate).alias("whole"),
        ((rate - F.floor(rate)) * F.col("size")).alias("m"),
        F.xxhash64(F.lit(SEED), "doc_id", "size", "copy").alias("k"),
        F.ceil(F.col("n_docs") / FAN_IN).alias("buckets"),
    )
    rows = rows.withColumn("bucket", F.pmod("k", "buckets"))
    closed = (F.col("m") < TINY) | (F.col("size") - F.col("m") < TINY)
    results = [rows.where(closed).select("doc_id", "source", "size", "source_size", "target", "whole", F.round("m").alias("m"))]
    level = rows.where(~closed)
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    at_most = -(-most // FAN_IN)
    while True:
        keys = ["source", "source_size", "target", "whole", "buckets", "bucket"]
        held = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "doc_id", F.col("size").cast("double").alias("size"), "m"))).alias("items"))
        level = held.select(*keys, F.explode(F.expr(_fold(item))).alias("x")).select(*keys, "x.k", "x.doc_id", F.col("x.size").cast("long").alias("size"), "x.m")
        level = materialise(level, "level")
        done = (F.col("m") == 0) | (F.col("m") == F.col("size"))
        last = at_most <= 1
        results.append(level.where(F.lit(last) | done).select("doc_id", "source", "size", "source_size", "target", "whole", F.round("m").alias("m")))
        if last:
            break
        at_most = -(-at_most // FAN_IN)
        level = level.where(~done).withColumns({"bucket": F.floor(F.col("bucket") / FAN_IN), "buckets": F.ceil(F.col("buckets") / FAN_IN)})
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    taken = (F.col("whole") * F.col("size") + F.col("m")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("source")
