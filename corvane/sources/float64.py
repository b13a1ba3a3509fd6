"""Files of contiguous little-endian float64 vectors, read and written by executors through Spark's data source API.

A file without header holds vector after vector. A reader's partition is a range of whole vectors of one
file; it is read in Arrow batches, without a Python value a vector. A folder is read as its files in the
order of their names, and vectors are numbered through. A writer's task writes a file of its own, named
by its place, which gets its name when all tasks are done; so a task that is run again leaves nothing double.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of an Arrow batch.
PARTITION, BATCH = 128 << 20, 4 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, or of a folder's files but hidden ones, by name."""
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = [i for i in where.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return [(i.path, i.size) for i in sorted(found, key=lambda i: i.base_name)]


@dataclass
class Range(InputPartition):
    file: str
    start: int  # bytes
    vectors: int
    first: int  # number of the first vector


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class Float64(DataSource):
    """Options: path, dimension, first (number of the first vector), tail ("error" or "drop": what a file holds beyond whole vectors), partition (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "float64"

    def schema(self) -> str:
        return "embedding_id bigint, embedding array<double>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.width, self.first = options["path"], 8 * int(options["dimension"]), int(options.get("first", 0))
        self.tail, self.partition = options.get("tail", "error"), int(options.get("partition", PARTITION))
        if self.tail not in ("error", "drop"):
            raise ValueError("tail must be error or drop")

    def partitions(self) -> list[Range]:
        out, at = [], self.first
        step = max(1, self.partition // self.width)
        for name, size in files_of(self.path):
            if size % self.width and self.tail == "error":
                raise ValueError(f"{name} holds {size} bytes, which is no whole number of vectors of {self.width // 8}")
            n = size // self.width
            out += [Range(name, lo * self.width, min(step, n - lo), at + lo) for lo in range(0, n, step)]
            at += n
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no vectors
            return
        step, d = max(1, BATCH // self.width), self.width // 8
        with store(self.path)[0].open_input_file(partition.file) as f:
            f.seek(partition.start)
            for lo in range(0, partition.vectors, step):
                n = min(step, partition.vectors - lo)
                values = np.frombuffer(f.read(n * self.width), "<f8")
                lists = pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + partition.first + lo), lists], ["embedding_id", "embedding"])


class Writer(DataSourceArrowWriter):
    """Takes the column embedding; each task's rows in their order, tasks in the order of partitions."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.dimension, self.run = options["path"], int(options["dimension"]), uuid.uuid4().hex
        where, at = store(self.path)
        where.create_dir(at, recursive=True)
        if overwrite:
            where.delete_dir_contents(at)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, at = store(self.path)
        place = TaskContext.get().partitionId()
        part = f"{at}/.{self.run}-{place}-{uuid.uuid4().hex}"
        with where.open_output_stream(part) as f:
            for batch in iterator:
                lists = batch.column(batch.schema.get_field_index("embedding"))
                values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                if lists.null_count or lists.flatten().null_count or (len(lists) and set(lists.value_lengths().to_pylist()) != {self.dimension}):
                    raise ValueError(f"every row must hold a vector of {self.dimension}")
                f.write(values.astype("<f8").tobytes())
        return Written(part, f"{at}/part-{place:05d}-{self.run}.f64")

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = store(self.path)
        for m in filter(None, messages):
            where.move(m.part, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = store(self.path)
        for m in filter(None, messages):
            where.delete_file(m.part)
