"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java / RE2 / Python class.
SPACE = r"\x20\x09-\x0D"
#: One word: a run of anything else.
WORD = rf"[^{SPACE}]+"

#: Python stages cut a record batch into pieces of about this many text bytes, so a worker's memory
#: follows the longest single text and not the number of rows that Arrow packs together.
CHUNK_BYTES = 8 << 20

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def bounded_rows(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows, reading no more than needed to tell."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """``df``, marked for broadcast only if it was counted and has at most ``limit`` rows."""
    return F.broadcast(df) if bounded_rows(df, limit) else df


def dealt_anew(key: Column) -> Column:
    """A long key under which an aggregate is dealt out again when it is joined.

    An aggregate joined on its own grouping key stays where it is, and Spark can then not split a hot key of the other side.
    As another expression of the same value the key needs an exchange of its own, and skewed partitions can be split.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, or one row if that is longer."""
    for batch in batches:
        texts = batch.column(column)
        if texts.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty.  ``bytes.split()`` cuts exactly at ``SPACE``."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
