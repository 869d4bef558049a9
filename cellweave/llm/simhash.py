"""SimHash near-dedup (operator 3): exact tiled comparison of fingerprints.

Fingerprints are computed where the texts are read.  Equal ones collapse first (map-side aggregation), so a group of
exact copies is one fingerprint however large it is.  Two fingerprints within the radius agree in at least one
combination of ``blocks - radius`` of their blocks (pigeonhole), so those bits are the bucket key and no pair is missed.
Within a bucket, rows sorted by population count form tiles that are compared whole, by exclusive-or and bit counts in
numpy; a tile pair whose population counts differ beyond the radius is skipped.  A bucket with more than ``HOT_BUCKET``
fingerprints is split by the same argument: the bits its key leaves free are cut into ``radius + 1`` blocks, one of which
any two linked fingerprints share.  Each split fixes more bits, so every bucket ends up small, and a fingerprint is copied a
number of times that depends on the bits and not on the bucket's size.  A bucket hands on a spanning forest of the links it
found, not the links, and components are found on those edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import dealt_anew, maybe_broadcast, pieces, read_table, utf8
from cellweave.llm.components import components, local_components
from cellweave.sources.shared import materialise

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 512
#: Buckets beyond this many fingerprints are split by more of their bits.
HOT_BUCKET = 2048
#: Hot buckets are broadcast (two longs each) up to this many, and joined otherwise.
BROADCAST_HOT = 200_000
#: Average fingerprints a bucket beyond which longer keys are used.
BUCKET_MEAN = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text: over its shingles' XXH64, a bit is 1 if set in more than half; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``df`` without its text, with ``fp`` (the fingerprint's bits as a signed long)."""
    others = [c for c in df.columns if c != text_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col):
            found = np.fromiter((fingerprint(x, shingle) for x in utf8(part.column(text_col))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(found.view(np.int64))], [*others, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(compute, f"{schema}, fp long")


def _bucket_keys(radius: int, distinct: int) -> list[tuple[int, ...]]:
    """Bit masks, one per combination of blocks; more and longer keys where there are more fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 3):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        bits = 64 * (blocks - radius) // blocks
        if distinct <= BUCKET_MEAN << bits:
            break
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(x)) for x in combinations(block, blocks - radius)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _finer_keys(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` blocks of its free bits added: two fingerprints of one bucket that differ in at most
    ``radius`` bits agree under at least one of them."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [_signed((mask & (1 << 64) - 1) | sum(free[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _compare(unit: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked fingerprints, for rows sorted by unit and population count."""
    left, right = [], []
    count = np.bitwise_count(fps).astype(np.int16)
    n = len(fps)
    for i in range(0, n, TILE):
        a = slice(i, min(i + TILE, n))
        for j in range(i, n, TILE):
            b = slice(j, min(j + TILE, n))
            if j > i and unit[b.start] != unit[a.stop - 1]:
                break
            one_unit = unit[a.start] == unit[b.stop - 1]
            if one_unit and int(count[b.start]) - int(count[a.stop - 1]) > radius:
                break  # population counts only rise from here
            near = np.bitwise_count(fps[a, None] ^ fps[None, b]) <= radius
            if not one_unit:
                near &= unit[a, None] == unit[None, b]
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            left.append(x + i)
            right.append(y + j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _unit_links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (mask, key, fp) sorted by bucket: whole buckets are compared as soon as they are complete."""

        def forest(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys, fps = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            a, b = _compare(keys, fps, radius)
            root = local_components(len(fps), a, b)
            linked = np.flatnonzero(root != np.arange(len(fps)))
            u, v = fps[linked].view(np.int64), fps[root[linked]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, ordinal = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key")]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(int(c[0]) for c in columns)
            change[0] = first != last
            last = tuple(int(c[-1]) for c in columns)
            unit = ordinal + np.cumsum(change)
            ordinal = int(unit[-1])
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if cut or (held and unit[0] != held[-1][0][-1]):
                if cut:
                    held.append((unit[:cut], fps[:cut]))
                yield forest(held)
                held = []
            held.append((unit[cut:], fps[cut:]))
        if held:
            yield forest(held)

    return links


def _buckets(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (mask, key, fp): the fingerprints under the bits of the mask.  Two within the radius meet in some bucket; none has more
    than ``HOT_BUCKET`` (or, if that is more, ``2 ** radius``) fingerprints."""
    masks = _bucket_keys(radius, fps.count())
    key: Column = F.col("fp").bitwiseAND(F.col("mask"))
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("mask", key.alias("key"), "fp")
    small: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("mask", "key").count().where((F.col("count") > HOT_BUCKET) & (F.bit_count("mask") < 64 - radius))
        hot = materialise(sizes.select(F.col("mask").alias("_mask"), F.col("key").alias("_key")), "hot")
        split = [(r[0], m) for r in hot.select("_mask").distinct().collect() for m in _finer_keys(r[0], radius)]
        if not split:
            return reduce(DataFrame.unionByName, small, rows)
        hot = maybe_broadcast(hot, BROADCAST_HOT)
        same = (F.col("mask") == F.col("_mask")) & (F.col("key") == F.col("_key"))
        small.append(rows.join(hot, same, "left_anti"))
        finer = F.broadcast(fps.sparkSession.createDataFrame(split, "_mask long, finer long"))
        rows = rows.join(hot, same, "left_semi").join(finer, F.col("mask") == F.col("_mask")).select(F.col("finer").alias("mask"), "fp")
        rows = materialise(rows.distinct().select("mask", key.alias("key"), "fp"), "finer")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u, v`` between the distinct longs ``fp`` that connect exactly what links at ``radius`` bits connect."""
    spread = _buckets(fps, radius).repartition("mask", "key").sortWithinPartitions("mask", "key", F.bit_count("fp"), "fp")
    return spread.mapInArrow(_unit_links(radius), "u long, v long")


def fingerprint_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` for the distinct ``fp`` of rows (doc_id, fp): the smallest doc_id reachable (null if none has one)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).select(dealt_anew(F.col("root")).alias("_root"), "component_id")
    return named.join(least, F.col("root") == F.col("_root")).select("fp", "root", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows each get a row; a null id gets
    its group's smallest id, or null where the group has none.  Texts of any length count whole; other columns are not read, whatever
    their names.  An empty table gives an empty result.
    """
    rows = materialise(add_fingerprints(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), "text", shingle), "simhash")
    found = fingerprint_components(rows, radius).withColumnRenamed("fp", "_fp")
    joined = rows.join(found, rows["fp"] == F.col("_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with ``df``'s columns: the smallest id (null last), then the smallest row hash.

    Rows that agree in every column are one row here, since all but one of them go anyway.  Texts of any length count whole, columns may
    have any names, and an empty table stays empty.
    """
    names = df.columns
    marked = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    hashed = marked.withColumns({"_h": F.xxhash64(*marked.columns), "_g": F.xxhash64(F.lit(1), *marked.columns)})
    narrow = hashed.select(F.col(ident).alias("doc_id"), "_h", "_g", F.col(text).alias("text"))
    rows = materialise(add_fingerprints(narrow, "text", shingle), "simhash")
    found = fingerprint_components(rows, radius).withColumnRenamed("fp", "_fp")
    joined = rows.join(found, rows["fp"] == F.col("_fp"))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_g")).alias("x"))
    keys = first.select(F.col("x._h").alias("_h"), F.col("x._g").alias("_g"))
    kept = hashed.join(keys.hint("shuffle_hash"), ["_h", "_g"], "left_semi").dropDuplicates(["_h", "_g"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``."""
    return simhash_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))
