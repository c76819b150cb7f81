"""Files and zip entries as blocks of bytes: a Spark data source whose tasks read parts of one file.

A plain file is dealt to tasks by ranges of bytes. Of a zip, the driver reads the central directory only; each large entry is a task
of its own and small ones share tasks, in the order in which they lie in the file. Entries are unpacked block by block, so neither
a zip nor an entry has to fit in memory or in one value. Files are opened by the tasks themselves: they have to be on a
disk that all executors see.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, block long, body binary"
_ARROW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("body", pa.binary())])
#: Bytes in a block, and bytes for a task.
BLOCK, SPLIT = 4 << 20, 64 << 20


@dataclass
class FilePart(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class ZipPart(InputPartition):
    path: str
    entries: tuple[str, ...]


def local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def plain_entries(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Entries that are read, in the order in which they lie in the file: no directories, encrypted ones or zips in zips; of two with one name the later."""
    last = {i.filename: i for i in z.infolist()}
    return sorted((i for i in last.values() if not i.is_dir() and not i.flag_bits & 1 and not i.filename.lower().endswith(".zip")), key=lambda i: i.header_offset)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.block, self.split = int(options.get("block", BLOCK)), int(options.get("split", SPLIT))
        self.entries = options.get("entries")
        self.filters: list[Filter] = []

    def _wanted(self, path: str) -> bool:
        checks = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith}
        return all(checks[type(f)](path, f.value) for f in self.filters)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if zipfile.is_zipfile(local(path)):
                with zipfile.ZipFile(local(path)) as z:
                    group, size = [], 0
                    for i in plain_entries(z):
                        if (self.entries and not fnmatch.fnmatch(i.filename, self.entries)) or not self._wanted(f"{path}!/{i.filename}"):
                            continue
                        if group and size + i.file_size > self.split:
                            out.append(ZipPart(path, tuple(group)))
                            group, size = [], 0
                        group.append(i.filename)
                        size += i.file_size
                    if group:
                        out.append(ZipPart(path, tuple(group)))
            elif self._wanted(path):
                whole = os.path.getsize(local(path))
                step = max(1, self.split // self.block) * self.block
                out += [FilePart(path, at, min(whole, at + step)) for at in range(0, max(whole, 1), step)]
        return out or [ZipPart("", ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        def row(path: str, k: int, body: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([k], pa.int64()), pa.array([body], pa.binary())], schema=_ARROW)

        if isinstance(partition, FilePart):
            with open(local(partition.path), "rb") as f:
                f.seek(partition.start)
                for at in range(partition.start, max(partition.end, partition.start + 1), self.block):
                    yield row(partition.path, at // self.block, f.read(min(self.block, partition.end - at)))
        elif partition.entries:
            with zipfile.ZipFile(local(partition.path)) as z:
                for name in partition.entries:
                    with z.open(name) as f:
                        k, body = 0, f.read(self.block)
                        while body or not k:
                            yield row(f"{partition.path}!/{name}", k, body)
                            k, body = k + 1, f.read(self.block)


class NarrowedBlockReader(BlockReader):
    def pushFilters(self, filters: list[Filter]):
        """Conditions on the path choose files and entries before any is opened by a task."""
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f


class Blocks(DataSource):
    """Format ``palimpsest_blocks``. Options: path, or paths (a JSON list); block and split (bytes); entries (a glob of names in
    zips); pushdown (true only where spark.sql.python.filterPushdown.enabled is)."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return (NarrowedBlockReader if self.options.get("pushdown") == "true" else BlockReader)(self.options)


def read_blocks(spark: SparkSession, *paths: str, block: int = BLOCK, split: int = SPLIT, entries: str | None = None) -> DataFrame:
    """path (of a zip's entry: zip!/entry), block (its number from 0 on), body. An empty file has one empty block."""
    spark.dataSource.register(Blocks)
    reader = spark.read.format("palimpsest_blocks").option("paths", json.dumps(list(paths))).option("block", block).option("split", split).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("entries", entries) if entries else reader).load()
