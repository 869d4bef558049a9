"""Intermediate tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests, notebooks in local mode) a temporary folder is made and set;
    on any other master a missing setting is an error, since executors could not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cellweave-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what is at ``path`` by now when the driver's JVM ends in an orderly way."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df``, marked for broadcast only if it was counted and has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def file_uri(path: str) -> str:
    """Hadoop's spelling of a path as pyarrow takes it."""
    return re.sub(r"^file:/(?!//)/?", "file:///", path) if ":" in path else f"file://{path}"


def write_files(df: DataFrame, path: str) -> DataFrame:
    """A file for each row (name, content) in the folder ``path``, written by the executors; the names and sizes.

    A file gets its name when it is whole, so a task that is run again replaces what it left.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = FileSystem.from_uri(file_uri(path))
        store.create_dir(folder)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                store.move(draft, f"{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    return materialise(df.select("name", "content").mapInArrow(write, "name string, size long"), "files")
