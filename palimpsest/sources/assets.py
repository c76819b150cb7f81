"""Assets: the files that exports hold beside their conversations, and their bodies, each content once.

A body is read and stored in parts and is never one value, so it may be of any size. Its digest comes from a tree: the SHA-256 of a
body of one part, else ``tree-`` and the SHA-256 of the digests of up to ``FAN`` neighbours, level by level until one is left.
All parts are digested first; only those of contents that aren't stored yet are read a second time, to be written.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import local
from .readers import SKIPPED

ASSET = "digest string, uuid string, relative_path string, size long, mtime timestamp, export_index int, seq long"
BODY = "digest string, part int, body binary"
#: Bytes of a part, digests that one node of a tree is made of, and parts that one task reads.
PART, FAN, PER_TASK = 4 << 20, 1024, 256
#: Fixed values: 'content' files in asset folders, and images.
_IS_ASSET = r"/[^/]+/content$|\.(?i:jpe?g|png|gif)$"


_FOUND = "path string, size long, mtime timestamp, folder boolean, hidden boolean, linked boolean"
_FOUND_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_()), ("hidden", pa.bool_()), ("linked", pa.bool_())])
#: Rounds in which the folders found are dealt to tasks before each is walked by one, and rows of a batch.
ROUNDS, ROWS = 3, 4096


def _hidden(name: str) -> bool:
    """Names that Spark's reader passes over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _scan(deep: bool):
    """Folders -> what is in them, or below them if ``deep``; files go through. Of asset files the size and time are taken as they are found."""

    def below(r: dict) -> Iterator[dict]:
        todo = [r]
        while todo:
            at = todo.pop()
            with os.scandir(at["path"]) as entries:
                for e in entries:
                    own = {"path": e.path, "size": None, "mtime": None, "folder": e.is_dir(), "hidden": at["hidden"] or _hidden(e.name), "linked": at["linked"] or e.is_symlink()}
                    if own["folder"]:
                        if own["hidden"] and own["linked"]:
                            continue
                        if deep:
                            todo.append(own)
                        else:
                            yield own
                    elif re.search(_IS_ASSET, e.path):
                        yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for batch in batches:
            for r in batch.to_pylist():
                for x in below(r) if r["folder"] else (r,):
                    if deep:
                        s = os.stat(x["path"])
                        x |= {"size": s.st_size, "mtime": datetime.fromtimestamp(s.st_mtime_ns // 1_000_000 / 1000, timezone.utc)}
                    own.append(x)
                    if len(own) == ROWS:
                        yield pa.RecordBatch.from_pylist(own, schema=_FOUND_ARROW)
                        own = []
        if own:
            yield pa.RecordBatch.from_pylist(own, schema=_FOUND_ARROW)

    return run


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of the asset files below a folder, found by tasks: the driver holds no names. As Spark's reader has it, hidden ones
    are passed over and links followed; empty files, which it doesn't see, are found where they aren't behind links."""
    rows = spark.createDataFrame([(local(root).rstrip("/") or "/", None, None, True, False, False)], _FOUND)
    tasks = spark.sparkContext.defaultParallelism
    for _ in range(ROUNDS):
        rows = rows.mapInArrow(_scan(False), _FOUND).repartition(tasks, "path")
    rows = rows.mapInArrow(_scan(True), _FOUND)
    seen = F.when(F.col("size") > 0, ~F.col("hidden")).otherwise(~F.col("linked"))
    return rows.where(seen).select(F.concat(F.lit("file:"), "path").alias("path"), F.col("size").alias("length"), F.col("mtime").alias("modificationTime"))


def listing(spark: SparkSession, *roots: str, skips: tuple[str, ...] = ()) -> DataFrame:
    """path, relative_path (below its root), size, mtime of the asset files in folders. No file is opened. ``skips`` as in ``readers.skipped``.

    Folders on local paths are walked by tasks. Others are listed by Spark's reader, on the driver; it passes over empty files."""
    out = None
    for root in roots:
        if os.path.isdir(local(root)):
            files = _walked(spark, root)
        else:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        skipped = F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.").replace("+", r"\+") for s in SKIPPED) + ")/")
        plain, below = F.regexp_replace("path", "^file:/+", "/"), local(root).rstrip("/") + "/"
        for own in skips:
            skipped |= F.startswith(plain, F.lit(own.rstrip("/") + "/")) if own.startswith("/") else F.contains(F.concat(F.lit("/"), plain, F.lit("/")), F.lit("/" + own.strip("/") + "/"))
        relative = F.when(F.startswith(plain, F.lit(below)), F.substring(plain, len(below) + 1, 1 << 30)).otherwise(F.col("path"))
        own = files.where(F.col("path").rlike(_IS_ASSET) & ~skipped).select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        out = own if out is None else out.union(own)
    return out


def _opened(rows: DataFrame, size: int) -> DataFrame:
    """(path, part, ...) -> the same and body: tasks open the files of their rows and read the bytes of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, parts = batch.column("path").to_pylist(), batch.column("part").to_pylist()
            own, held, first = [], 0, 0
            for k, (path, part) in enumerate(zip(paths, parts, strict=True)):
                with open(local(path), "rb") as f:
                    f.seek(part * size)
                    own.append(f.read(size))
                held += len(own[-1])
                if held >= PART or k == len(paths) - 1:
                    rows = batch.slice(first, len(own))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own, pa.binary())], names=[*rows.schema.names, "body"])
                    own, held, first = [], 0, k + 1

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("body", T.BinaryType())]))


def _cut(rows: DataFrame, size: int, roots: tuple[str, ...]) -> DataFrame:
    """The same through Spark's reader, for files that only it can open: each is one value, of at most 2 GB, before it is cut."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    files = files.select("path", "length", "content").join(rows.select("path").distinct(), "path", "left_semi")
    cuts = F.expr(f"transform(sequence(0, cast(greatest(ceil(length / {size}), 1) as int) - 1), k -> substring(content, k * {size} + 1, {size}))")
    return files.select("path", F.posexplode(cuts).alias("part", "body")).join(rows, ["path", "part"]).select(*rows.columns, "body")


def tree_digests(parts: DataFrame, by: str = "path", fan: int = FAN) -> DataFrame:
    """(by, part, digest, bytes) -> by, digest, size, parts. A group has at most ``fan`` rows; there are as many rounds as the largest tree has levels."""
    top = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    rows = parts.select(by, F.col("part").cast("long").alias("part"), "digest", F.col("bytes").cast("long").alias("size"), F.lit(1).cast("long").alias("parts"))
    while top > 0:
        own = rows.groupBy(by, F.floor(F.col("part") / fan).alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("c"), F.sum("size").alias("size"), F.sum("parts").alias("parts"))
        node = F.concat(F.lit("tree-"), F.sha2(F.array_join("c.digest", ""), 256))
        rows = own.select(by, "part", F.when(F.size("c") == 1, F.col("c")[0]["digest"]).otherwise(node).alias("digest"), "size", "parts")
        top //= fan
    return rows.select(by, "digest", "size", "parts")


def part_digests(bodies: DataFrame, by: str = "digest", fan: int = FAN) -> DataFrame:
    """(by, part, body) -> by, own (the digest that the bytes give), size, parts."""
    parts = bodies.select(F.col(by).alias("_by"), "part", F.sha2("body", 256).alias("digest"), F.length("body").alias("bytes"))
    return tree_digests(parts, "_by", fan).select(F.col("_by").alias(by), F.col("digest").alias("own"), "size", "parts")


def catalog(listed: DataFrame, work: str, stored: DataFrame | None = None, size: int = PART, fan: int = FAN, through: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, relative_path, size, mtime, export_index, seq), digests that are stored -> ASSET rows of all files, and BODY rows of the
    contents that aren't stored yet, sorted by digest and part where tasks open files themselves. Files below ``through`` (all, or none) are opened by Spark.

    Both read what is written to the folder ``work``. An empty file has one empty part. A file that changes between the two reads is an error. Without files both are empty.
    """
    spark = listed.sparkSession

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    listed = write(listed, "listed")
    wanted = listed.select("path", "size").distinct().select("path", F.explode(F.expr(f"sequence(0, cast(greatest(ceil(size / {size}), 1) as int) - 1)")).alias("part"))
    n, held = wanted.count(), listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # by bytes; small parts are many to a task, as each task and each file that it writes is known to the driver
    tasks = max(1, min(-(-n // PER_TASK), spark.sparkContext.defaultParallelism), -(-n // (16 * PER_TASK)), -(-held // (PER_TASK * PART)))
    read = (lambda rows: _cut(rows, size, through)) if through else (lambda rows: _opened(rows, size))
    parts = write(read(wanted.repartition(tasks)).select("path", "part", F.sha2("body", 256).alias("digest"), F.length("body").alias("bytes")), "parts")
    files = write(tree_digests(parts, fan=fan), "files")
    names = F.split("path", "/")
    rows = listed.drop("size").join(files, "path")
    uuid = F.when(F.col("path").endswith("/content"), F.element_at(names, -2)).otherwise(F.col("digest"))
    assets = rows.select("digest", uuid.alias("uuid"), "relative_path", "size", "mtime", "export_index", "seq")
    new = files if stored is None else files.join(stored.select("digest").distinct(), "digest", "left_anti")
    new = new.groupBy("digest").agg(F.min("path").alias("path"))
    due = parts.select("path", "part", F.col("digest").alias("want")).join(new, "path")
    if not through:
        due = write(due, "due").repartitionByRange(tasks, "digest", "part").sortWithinPartitions("digest", "part")
    sound = F.when(F.sha2("body", 256) == F.col("want"), F.col("body")).otherwise(F.raise_error(F.concat("path", F.lit(" changed while it was read"))))
    return assets, read(due).select("digest", F.col("part").cast("int").alias("part"), sound.alias("body"))


def restore(bodies: DataFrame, folder: str, size: int = PART) -> None:
    """BODY rows -> files in a folder that all executors see, named by their digests: each task writes its parts at their places, so a
    task that runs again writes the same. Parts may come in any order."""
    os.makedirs(local(folder), exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = os.open(os.path.join(local(folder), r["digest"]), os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    at, body = r["part"] * size, memoryview(r["body"])
                    while body:
                        n = os.pwrite(f, body, at)
                        at, body = at + n, body[n:]
                finally:
                    os.close(f)
            yield batch.select(["part"])

    bodies.mapInArrow(run, "part int").agg(F.count("*")).collect()
