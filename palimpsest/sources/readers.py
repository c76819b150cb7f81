"""Files of any known shape, and zips of them, as item rows."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.batches import batches_of, rows_of
from . import arrays
from .blocks import BLOCK, local, read_blocks
from .parsers import OPAQUE, PARSERS, dump_tables, overlay_summary, sniff

#: Rows of these kinds aren't conversations: tables of a dump, sibling files, lines of a session's other files.
TAGGED = ("media_posts", "projects", "tasks", "extra", "leftover", *OPAQUE)
ITEMS = "path string, kind string, place int, item string, problem string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("item", pa.string()), ("problem", pa.string())])
#: Largest zip entry that is read; parts of paths that are skipped.
MAX_ENTRY = 8 << 30
SKIPPED = ("node_modules", ".git", ".trash", "Trash", ".Trash", "__MACOSX", "lost+found")


def skipped(path: str, more: tuple[str, ...] = ()) -> bool:
    """Whether a path has a skipped part; ``more`` are relative runs of parts, or absolute beginnings."""
    parts = path.split("/")
    if any(p in SKIPPED for p in parts):
        return True
    for s in more:
        own = s.strip("/").split("/")
        if s.startswith("/") and path.startswith(s.rstrip("/") + "/") or not s.startswith("/") and any(parts[k : k + len(own)] == own for k in range(len(parts))):
            return True
    return False


def zip_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Plain entries in order of their names; directories, encrypted, too large and nested zip entries are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if not info.is_dir() and not info.flag_bits & 1 and info.file_size <= MAX_ENTRY and not info.filename.endswith(".zip"):
                yield info.filename, z.read(info)


def relative(path: str, roots: tuple[str, ...] = ()) -> str:
    """A file's path inside its export: in its zip, or below the root that was read, so that an export may be moved. A root that is the file leaves its name."""
    if "!/" in path:
        return path.split("!/", 1)[1]
    plain = re.sub("^file:/+", "/", path)
    for root in sorted((re.sub("^file:/+", "/", r).rstrip("/") for r in roots), key=len, reverse=True):
        if plain == root:
            return plain.rsplit("/", 1)[-1]
        if plain.startswith(root + "/"):
            return plain[len(root) + 1 :]
    return path


def own_path(path: str, kind: str, roots: tuple[str, ...]) -> str:
    """The path that a parser is given: notes and activities have it in their ids."""
    return relative(path, roots) if kind in ("markdown", "activity") else path


def _of_file(path: str, data: bytes, kind: str | None, roots: tuple[str, ...] = ()) -> Iterator[dict]:
    kind = kind or sniff(path, data[:65536])
    if kind is None:
        return
    try:
        for k, item in enumerate(PARSERS[kind](own_path(path, kind, roots), data)):
            yield {"path": path, "kind": kind, "place": k, "item": json.dumps(item, ensure_ascii=False), "problem": None}
        if kind == "assistant":
            for name, values in dump_tables(path, data).items():
                for k, value in enumerate(v for v in values if v != {}):
                    yield {"path": path, "kind": name, "place": k, "item": json.dumps(value, ensure_ascii=False), "problem": None}
    except (SourceError, AttributeError, TypeError, KeyError) as e:
        yield {"path": path, "kind": kind, "place": None, "item": None, "problem": str(e)}


def parse_files(files: DataFrame, kind: str | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) -> ITEMS rows. A broken file gives one row with its problem, and the others are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for batch in batches for r in rows_of(batch) for row in items_in(r["path"], r["content"])), _ARROW)

    def items_in(path: str, data: bytes) -> Iterator[dict]:
        if data[:4] != b"PK\x03\x04":
            yield from _of_file(path, data, kind, roots)
            return
        try:
            for name, own in zip_entries(data):
                yield from _of_file(f"{path}!/{name}", own, kind, roots)
        except zipfile.BadZipFile as e:
            yield {"path": path, "kind": "zip", "place": None, "item": None, "problem": str(e)}

    return files.select("path", "content").mapInArrow(run, ITEMS)


#: Kinds whose items are those of one array (of a file that begins with one), or of the arrays of an object; and what the items are put in again to be parsed.
IN_ARRAYS = {"assistant": "object", "mapping": "array", "activity": "array", "assigned": "array"}
#: Bytes from which a file on a local path is read by several tasks, if its kind is one of these.
LARGE = 64 << 20


def _kinds(kind: str | None):
    """The first block of each file -> its kind, and whether it is an array's or an object's that is read item by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                k = kind or sniff(path, body[:65536])
                text = body[:65536].removeprefix(b"\xef\xbb\xbf").lstrip()
                shape = "array" if text[:1] == b"[" or text.startswith(b"window.") else "object" if text[:1] == b"{" else None
                own.append((k, k in IN_ARRAYS and IN_ARRAYS[k] == shape))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.bool_())], names=["path", "kind", "split"])

    return run


def _items(roots: tuple[str, ...]):
    """path, kind, key, place, item -> ITEMS rows: each item parsed as the only one of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for batch in batches for r in rows_of(batch) for row in parsed(r)), _ARROW)

    def parsed(r: dict) -> Iterator[dict]:
        path, kind, key, place = r["path"], r["kind"], r["key"], int(r["place"])
        if kind == "assistant" and key != "conversations":
            known = key in ("media_posts", "projects", "tasks")
            if not known or r["item"] != "{}":
                yield {"path": path, "kind": key if known else "extra", "place": place, "item": r["item"] if known else json.dumps({key: [json.loads(r["item"])]}, ensure_ascii=False), "problem": None}
            return
        data = ('{"conversations":[' + r["item"] + "]}" if kind == "assistant" else "[" + r["item"] + "]").encode()
        try:
            own = PARSERS[kind](own_path(path, kind, roots), data, *([place] if kind == "activity" else []))
            yield from [{"path": path, "kind": kind, "place": place, "item": json.dumps(x, ensure_ascii=False), "problem": None} for x in own]
        except (SourceError, AttributeError, TypeError, KeyError) as e:
            yield {"path": path, "kind": kind, "place": None, "item": None, "problem": str(e)}

    return run


def parse_blocks(blocks: DataFrame, work: str, kind: str | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """(path, block, body) -> ITEMS rows. Files of several blocks whose items are in arrays are split into these, by many tasks; others
    of several blocks are put together again, each as one value. ``work`` is a folder for what is written on the way; the result reads it."""
    spark = blocks.sparkSession
    blocks.write.parquet(f"{work}/blocks")  # an entry is unpacked once
    stored = spark.read.schema(blocks.schema).parquet(f"{work}/blocks")
    sizes = stored.groupBy("path").agg(F.max("block").alias("last"))
    known = stored.where("block = 0").mapInArrow(_kinds(kind), "path string, kind string, split boolean").join(sizes, "path").where("kind is not null")
    known.write.parquet(f"{work}/kinds")
    known = spark.read.parquet(f"{work}/kinds")
    single = stored.join(known.where("last = 0").select("path"), "path", "left_semi").select("path", F.col("body").alias("content"))
    out = parse_files(single, kind, roots)
    if known.where("last > 0 and not split").limit(1).count():
        parted = stored.join(known.where("last > 0 and not split").select("path"), "path", "left_semi")
        whole = parted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "body"))).alias("x")).select("path", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["body"])).alias("content"))
        out = out.union(parse_files(whole, kind, roots))
    large = known.where("last > 0 and split").select("path", "kind")
    if large.limit(1).count():
        rows = arrays.pieces(stored.join(large.select("path"), "path", "left_semi"), f"{work}/arrays")
        own = arrays.items_of(rows).join(large, "path").select("path", "kind", "key", "place", "item")
        others = arrays.others_of(rows).join(large.where("kind = 'assistant'"), "path")
        others = others.select("path", F.lit("extra").alias("kind"), F.col("place").cast("int").alias("place"), F.col("member").alias("item"), F.lit(None).cast("string").alias("problem"))
        broken = spark.read.parquet(f"{work}/arrays/states").where("not sound and block = 0").join(large, "path")
        broken = broken.select("path", "kind", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("item"), F.concat("path", F.lit(": what is opened isn't closed")).alias("problem"))
        out = out.union(own.mapInArrow(_items(roots), ITEMS)).union(others).union(broken)
    return out


def read_files(spark: SparkSession, *paths: str, kind: str | None = None, work: str | None = None, roots: tuple[str, ...] = (), block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """Items of files and folders (read to any depth). Files go to tasks one by one; summaries are laid over sessions.

    With a folder ``work``, zips and files from ``large`` bytes on that lie on local paths are read in blocks, by many tasks each.
    """
    apart = [p for p in paths if work and os.path.isfile(local(p)) and (zipfile.is_zipfile(local(p)) or os.path.getsize(local(p)) >= large)]
    together = [p for p in paths if p not in apart]
    parts = [parse_blocks(read_blocks(spark, *apart, block=block), work, kind, roots)] if apart else []
    if together:
        parts.append(_read_together(spark, together, kind, roots))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _read_together(spark: SparkSession, paths: list[str], kind: str | None, roots: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    keep = ~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.").replace("+", r"\+") for s in SKIPPED) + ")/")
    files = files.where(keep)
    items = parse_files(files, kind, roots)
    summaries = files.where(F.col("path").endswith("/summary.json")).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.col("content").cast("string").alias("summary"))
    # other line files beside a session's log are kept with the export, not as conversations
    folder = F.regexp_replace("path", "/[^/]*$", "")
    logs = items.where(F.col("path").endswith("/chat_history.jsonl")).select(folder.alias("log_dir")).distinct()
    items = items.withColumn("own_dir", F.when((F.col("kind") == "session") & ~F.col("path").endswith("/chat_history.jsonl"), folder))
    items = items.join(logs, F.col("own_dir") == F.col("log_dir"), "left").withColumn("kind", F.when(F.col("log_dir").isNotNull(), "leftover").otherwise(F.col("kind"))).drop("own_dir", "log_dir")
    joined = items.withColumn("dir", F.when(F.col("path").endswith("/chat_history.jsonl"), F.regexp_replace("path", "/[^/]*$", ""))).join(summaries, "dir", "left")

    def overlay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((laid(r) for batch in batches for r in rows_of(batch)), _ARROW)

    def laid(r: dict) -> dict:
        if (s := r.pop("summary")) and r["item"]:
            r["item"] = json.dumps(overlay_summary(json.loads(r["item"]), json.loads(s)), ensure_ascii=False)
        return r

    return joined.select(*_ARROW.names, "summary").mapInArrow(overlay, ITEMS)


def digest_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()
