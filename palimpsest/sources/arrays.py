"""Items of one large JSON array, or of an object of arrays, read by many tasks.

1. Each block of bytes is taken as a step of an automaton with three states: outside a string, in one, in one after a backslash. For each
   state it may start in, the block says in which it ends and by how much brackets change the depth. Nothing but these few
   numbers a block is put together by file, in order.
2. With its state known, a block is cut at brackets and commas of the depth of items. Cuts are counted on from block to
   block, so each piece has a number, and pieces that a block's end parts have the same one and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import rows_of

#: States, as they are numbered.
OUT, IN, ESCAPED = 0, 1, 2
#: Rows of block states that are sent to all tasks; beyond, they are joined.
FEW = 200_000


def quotes_of(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that aren't escaped, and whether what follows the block is. Backslashes stand in strings only."""
    slash = b == 92
    if escaped and len(b):
        slash[0] = False
    edge = np.diff(np.concatenate([[0], slash.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = ends[(ends - starts) % 2 == 1]
    quote = b == 34
    if escaped and len(b):
        quote[0] = False
    quote[odd[odd < len(b)]] = False
    return quote, bool(len(odd) and odd[-1] == len(b)) or (escaped and not len(b))


def _brackets(b: np.ndarray) -> np.ndarray:
    up, down = (b == 91) | (b == 123), (b == 93) | (b == 125)
    return up.astype(np.int8) - down.astype(np.int8)


def summary(body: bytes) -> tuple[list[int], list[int], str | None]:
    """For each state at the start the one at the end, and the change of depth; the first opening bracket outside strings, from OUT."""
    b = np.frombuffer(body, np.uint8)
    step = _brackets(b)
    ends, deltas, first = [0, 0, 0], [0, 0, 0], None
    for escaped in (False, True):
        quote, after = quotes_of(b, escaped)
        inside = np.bitwise_xor.accumulate(quote.view(np.uint8)) if len(b) else np.zeros(0, np.uint8)
        odd, outside = bool(len(b) and inside[-1]), int(step[inside == 0].sum())
        if escaped:
            ends[ESCAPED], deltas[ESCAPED] = OUT if odd else ESCAPED if after else IN, int(step.sum()) - outside
        else:
            ends[OUT], deltas[OUT] = (ESCAPED if after else IN) if odd else OUT, outside
            ends[IN], deltas[IN] = OUT if odd else ESCAPED if after else IN, int(step.sum()) - outside
            found = np.flatnonzero((step == 1) & (inside == 0))
            first = chr(b[found[0]]) if len(found) else None
    return ends, deltas, first


_STATES = "path string, block long, state int, depth int, at int, sound boolean"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [summary(r["body"] or b"") for r in rows_of(batch.select(["body"]))]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array([x[0] for x in own], pa.list_(pa.int32())), pa.array([x[1] for x in own], pa.list_(pa.int32())), pa.array([x[2] for x in own], pa.string())], names=["path", "block", "ends", "deltas", "opens"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a file in order -> the state and depth at each one's start, and the depth of items."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state, depth = OUT, 0
            first = next((x["opens"] for x in r["x"] if x["opens"]), "[")
            own = []
            for x in r["x"]:
                own.append((r["path"], x["block"], state, depth, 1 if first == "[" else 2))
                state, depth = x["ends"][state], depth + x["deltas"][state]
            out += [(*o, (state, depth) == (OUT, 0)) for o in own]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], names=["path", "block", "state", "depth", "at", "sound"])


def states(blocks: DataFrame) -> DataFrame:
    """path, block, state, depth, at, sound: of each block's start; a file's items are at depth ``at``. A file is sound if all that
    is opened in it is closed. A few numbers a block meet by file."""
    own = blocks.select("path", "block", "body").mapInArrow(_summaries, "path string, block long, ends array<int>, deltas array<int>, opens string")
    by = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "ends", "deltas", "opens"))).alias("x"))
    return by.mapInArrow(_chained, _STATES)


def cut(body: bytes, state: int, depth: int, at: int) -> list[tuple[int, str | None, bytes]]:
    """(depth, what ended it, text) of a block's pieces: it is cut at all brackets and commas from the depth of items upwards.
    The last piece has no end; the next block's first piece goes on with it."""
    b = np.frombuffer(body, np.uint8)
    quote, _ = quotes_of(b, state == ESCAPED)
    inside = np.bitwise_xor.accumulate(quote.view(np.uint8)) if len(b) else np.zeros(0, np.uint8)
    out = inside == (0 if state == OUT else 1)
    step = np.where(out, _brackets(b), 0)
    after = depth + np.cumsum(step, dtype=np.int32)
    before = after - step
    low = np.minimum(before, after)
    # an opening bracket belongs to the depth it opens from, a closing one to the one it goes back to
    where = np.flatnonzero(((step != 0) & (low < at)) | ((b == 44) & out & (after <= at)))
    pieces, start, level = [], 0, min(depth, at)
    for p in where.tolist():
        pieces.append((level, chr(b[p]), body[start:p]))
        start, level = p + 1, int(after[p])
    pieces.append((level, None, body[start:]))
    return pieces


_PIECES = "path string, block long, idx int, level int, at int, ended string, body binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in rows_of(batch):
            own = cut(r["body"] or b"", r["state"], r["depth"], r["at"])
            for lo in range(0, len(own), 20_000):
                some = own[lo : lo + 20_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * n, pa.string()), pa.array([r["block"]] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int32()), pa.array([x[0] for x in some], pa.int32()), pa.array([r["at"]] * n, pa.int32()), pa.array([x[1] for x in some], pa.string()), pa.array([x[2] for x in some], pa.binary())],
                    names=["path", "block", "idx", "level", "at", "ended", "body"],
                )


def pieces(blocks: DataFrame, folder: str) -> DataFrame:
    """path, no, level, at, ended, key_no, body: whole pieces, numbered by file. ``key_no`` is the number of the last piece above the items' depth:
    what stands before their array. Files that aren't sound have none. ``folder`` takes the states and the pieces as they are cut; the
    result reads them."""
    spark = blocks.sparkSession
    known = states(blocks)
    known.write.parquet(f"{folder}/states")
    known = spark.read.parquet(f"{folder}/states")
    known = F.broadcast(known) if known.count() <= FEW else known
    blocks.join(known.where("sound"), ["path", "block"]).select("path", "block", "body", "state", "depth", "at").mapInArrow(_cut, _PIECES).write.parquet(f"{folder}/pieces")
    raw = spark.read.parquet(f"{folder}/pieces")
    sums = raw.groupBy("path", "block").agg(F.max("idx").alias("cuts"), F.max(F.when(F.col("level") < F.col("at"), F.col("idx"))).alias("key"))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("cuts").over(order), F.lit(0))).withColumn("key", F.col("before") + F.col("key"))
    sums = sums.withColumn("carried", F.max("key").over(order)).select("path", "block", "cuts", "before", "carried")
    inside = Window.partitionBy("path", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = raw.withColumn("own", F.max(F.when(F.col("level") < F.col("at"), F.col("idx"))).over(inside)).join(sums, ["path", "block"])
    placed = placed.select("path", "block", (F.col("before") + F.col("idx")).alias("no"), "level", "at", "ended", F.coalesce(F.col("before") + F.col("own"), "carried").alias("key_no"), "body", ((F.col("idx") > 0) & (F.col("idx") < F.col("cuts"))).alias("whole"))
    parted = placed.where("not whole").groupBy("path", "no").agg(F.min("level").alias("level"), F.min("at").alias("at"), F.max("ended").alias("ended"), F.min("key_no").alias("key_no"), F.array_sort(F.collect_list(F.struct("block", "body"))).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["body"]))
    columns = ["path", "no", "level", "at", "ended", "key_no", "body"]
    return placed.where("whole").select(*columns).union(parted.withColumn("body", joined).select(*columns))


def _key(before: Column) -> Column:
    """The name before a colon, from the text between a comma or brace and what the name is for."""
    return F.element_at(F.json_object_keys(F.concat(F.lit("{"), F.regexp_replace(before, r'^[^"]*', ""), F.lit("0}"))), 1)


def items(blocks: DataFrame, folder: str) -> DataFrame:
    """path, key, place, item: the items of a file's arrays as JSON texts. ``key`` is the array's key in the object around, null
    if the array is the file; what stands before a lone array is passed over. Objects and scalars under a key aren't items."""
    return items_of(pieces(blocks, folder))


def items_of(rows: DataFrame) -> DataFrame:
    keys = rows.where((F.col("level") == F.col("at") - 1) & (F.col("ended") == "[")).select("path", F.col("no").alias("key_no"), F.col("body").cast("string").alias("before"))
    own = rows.where("level = at").select("path", "no", "at", "key_no", F.col("body").cast("string").alias("item")).where(r"item rlike '[^\\x00-\\x20]'")
    joined = own.join(keys, ["path", "key_no"])
    return joined.select("path", F.when(F.col("at") == 2, _key(F.col("before"))).alias("key"), (F.col("no") - F.col("key_no") - 1).alias("place"), F.trim("item").alias("item"))


def others_of(rows: DataFrame) -> DataFrame:
    """path, place, member: what an object of arrays has beside them, each as an object of one member: a scalar with its key, or a member of an
    object with that object's key around it."""
    above = rows.where("at = 2 and level = 1").select("path", "no", "ended", F.col("body").cast("string").alias("text"))
    scalars = above.where("ended in (',', '}')").where(r"text rlike '\"[^\"]*\"\\s*:\\s*[^\\s]'").select("path", F.col("no").alias("place"), F.concat(F.lit("{"), F.trim("text"), F.lit("}")).alias("member"))
    objects = above.where("ended = '{'").select("path", F.col("no").alias("key_no"), F.regexp_replace("text", r'^[^"]*', "").alias("before"))
    inside = rows.where("level = at and at = 2").select("path", "no", "key_no", F.col("body").cast("string").alias("text")).join(objects, ["path", "key_no"])
    return scalars.union(inside.select("path", F.col("no").alias("place"), F.concat(F.lit("{"), "before", F.lit("{"), F.trim("text"), F.lit("}}")).alias("member")))
