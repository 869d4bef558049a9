"""A data source of grid archives: thousands of packed grids a file, read by range and written as a whole or not at all.

``spark.dataSource.register(GridArchives)``, then ``spark.read.format("grid-archive").load(folder)`` and
``grids.write.format("grid-archive").mode("append").save(folder)``.

An archive is a stored (uncompressed) NPZ file: ``grid_id``, ``shape`` (depth, height, width), ``offsets`` and ``cells``, one grid after
the other; numpy opens it.  A reader's partition is a range of an archive's grids: its offsets tell which bytes of ``cells`` to
fetch, so archives are split and no task reads more than its grids.  A writer's task leaves drafts; the commit gives them their names, in one
folder all executors see, and an abort removes them, so a reader never meets part of a write.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cellweave.operators.grids import PACKED
from cellweave.sources.shared import file_uri

SUFFIX, DRAFTS = ".npz", "_drafts"
#: Cells of an archive, and of a reader's partition, at about which the next one begins.
ARCHIVE_CELLS, PARTITION_CELLS = 1 << 26, 1 << 24
#: Cells handed on at once.
BATCH_CELLS = 1 << 21
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int8())]
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


@dataclass
class Range(InputPartition):
    """Grids [begin, end) of an archive."""

    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


@dataclass
class Drafts(WriterCommitMessage):
    """What a task has written: drafts, the names they get, and their grids."""

    names: list[tuple[str, str]]
    grids: int


class _Archive:
    """An archive's members by range."""

    def __init__(self, stream):
        self.stream, self.zip = stream, zipfile.ZipFile(stream)

    def rows(self, member: str, begin: int, end: int) -> np.ndarray:
        with self.zip.open(f"{member}.npy") as data:
            version = np.lib.format.read_magic(data)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(data)
            row = kind.itemsize * int(np.prod(shape[1:]))
            data.seek(data.tell() + begin * row)
            return np.frombuffer(data.read((end - begin) * row), kind).reshape(-1, *shape[1:])

    def length(self, member: str) -> int:
        with self.zip.open(f"{member}.npy") as data:
            version = np.lib.format.read_magic(data)
            return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(data)[0][0]


class GridArchiveReader(DataSourceReader):
    def __init__(self, path: str, cells: int):
        self.path, self.cells = path, cells

    def partitions(self) -> list[Range]:
        store, folder = FileSystem.from_uri(file_uri(self.path))
        found = []
        for info in store.get_file_info(FileSelector(folder, allow_not_found=True)):
            if not info.is_file or not info.base_name.endswith(SUFFIX) or info.base_name.startswith(("_", ".")):
                continue
            with store.open_input_file(info.path) as stream:
                archive = _Archive(stream)
                n = archive.length("grid_id")
                offsets = archive.rows("offsets", 0, n + 1)
            begin = 0
            while begin < n:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + self.cells, side="right")) - 1)
                found.append(Range(info.path, begin, min(end, n)))
                begin = end
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.begin == partition.end:
            return
        store, _ = FileSystem.from_uri(file_uri(self.path))
        with store.open_input_file(partition.path) as stream:
            archive = _Archive(stream)
            offsets = archive.rows("offsets", partition.begin, partition.end + 1)
            at = 0
            while at < len(offsets) - 1:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_CELLS, side="right")) - 1)
                rows = (partition.begin + at, partition.begin + end)
                shape = archive.rows("shape", *rows)
                cells = archive.rows("cells", int(offsets[at]), int(offsets[end])).astype(np.int8)
                lists = pa.ListArray.from_arrays(pa.array((offsets[at : end + 1] - offsets[at]).astype(np.int32)), pa.array(cells))
                yield pa.RecordBatch.from_arrays([pa.array(archive.rows("grid_id", *rows)), *(pa.array(shape[:, k]) for k in range(3)), lists], _NAMES)
                at = end


class GridArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, cells: int):
        self.path, self.overwrite, self.cells, self.run = path, overwrite, cells, uuid.uuid4().hex
        # Made once, before any task: one that still runs when the write is aborted finds no place for a draft.
        store, folder = FileSystem.from_uri(file_uri(path))
        store.create_dir(f"{folder}/{DRAFTS}-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        from pyspark import TaskContext

        store, folder = FileSystem.from_uri(file_uri(self.path))
        drafts = f"{folder}/{DRAFTS}-{self.run}"
        task = TaskContext.get()
        names, held, size, grids = [], [], 0, 0

        def leave() -> None:
            nonlocal held, size
            if not held:
                return
            ids, shapes, counts, cells = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"part-{self.run[:8]}-{task.partitionId():06d}-{len(names):04d}{SUFFIX}"
            draft = f"{drafts}/{task.taskAttemptId()}-{name}"
            content = io.BytesIO()
            np.savez(content, grid_id=ids, shape=shapes, offsets=np.concatenate(([0], np.cumsum(counts))), cells=cells)
            with store.open_output_stream(draft, compression=None) as out:
                out.write(content.getbuffer())
            names.append((draft, f"{folder}/{name}"))
            held, size = [], 0

        for batch in iterator:
            column = batch.column("cells")
            if column.null_count or batch.column("grid_id").null_count:
                raise ValueError("a grid of an archive has an id and cells")
            counts = np.array(column.value_lengths(), np.int64)
            shapes = np.stack([batch.column(c).to_numpy() for c in ("depth", "height", "width")], axis=1).astype(np.int32)
            if (shapes.prod(axis=1, dtype=np.int64) != counts).any():
                raise ValueError("cells do not fill a grid of their shape")
            held.append((batch.column("grid_id").to_numpy(), shapes, counts, (column.flatten().to_numpy(zero_copy_only=False) != 0).astype(np.uint8)))
            size += int(counts.sum())
            grids += batch.num_rows
            if size >= self.cells:
                leave()
        leave()
        return Drafts(names, grids)

    def commit(self, messages: list[Drafts | None]) -> None:
        store, folder = FileSystem.from_uri(file_uri(self.path))
        old = [i.path for i in store.get_file_info(FileSelector(folder, allow_not_found=True)) if i.is_file and i.base_name.endswith(SUFFIX)] if self.overwrite else []
        for message in messages:
            for draft, name in message.names if message else ():
                store.move(draft, name)
        for path in old:
            store.delete_file(path)
        self._drop_drafts(store, folder)

    def abort(self, messages: list[Drafts | None]) -> None:
        self._drop_drafts(*FileSystem.from_uri(file_uri(self.path)))

    def _drop_drafts(self, store: FileSystem, folder: str) -> None:
        drafts = f"{folder}/{DRAFTS}-{self.run}"
        if store.get_file_info(drafts).type.name == "Directory":
            store.delete_dir(drafts)


class GridArchives(DataSource):
    """Options: ``path``; ``cells``, of a reader's partition or of an archive to be written."""

    @classmethod
    def name(cls) -> str:
        return "grid-archive"

    def schema(self) -> str:
        return PACKED

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a grid archive needs a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> GridArchiveReader:
        return GridArchiveReader(self._path(), int(self.options.get("cells", PARTITION_CELLS)))

    def writer(self, schema: StructType, overwrite: bool) -> GridArchiveWriter:
        missing = set(_NAMES) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a grid archive needs the columns {sorted(missing)}")
        return GridArchiveWriter(self._path(), overwrite, int(self.options.get("cells", ARCHIVE_CELLS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridArchives)
