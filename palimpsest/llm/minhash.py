"""b-bit MinHash near-duplicate detection with every link confirmed on the full shingle sets.

1. Each document's shingle set gives ``bands * rows`` minima. The bands' hashes and the low ``bits`` of the minima,
   packed, are all that is kept of them.
2. Equal sets are one node. Nodes that share a band are candidates: each is paired with the smallest node of its
   bucket (a star, never all pairs), the packed signatures estimate the likeness by counting equal low bits with the
   chance of equal bits taken off, and the pairs that can reach the threshold are confirmed on the sets.
3. Buckets whose nodes are still in two or more components are gone through again, inside the bucket: signatures of
   different components are compared block by block, and what can reach the threshold is confirmed on the sets, so
   that no link is lost to the star. Large buckets are cut in blocks and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_long, dealt, materialize, mix, shingle_set, utf8, release
from .components import connected_components

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


class Params:
    """bands x rows minima of ``width``-word shingles; at the threshold 0.85 a link misses all 25 bands of 5 rows once
    in two million. ``slack`` is how far under the threshold an estimate may be before a pair isn't confirmed
    (five and more standard deviations). ``block``: nodes of a bucket that one task compares."""

    def __init__(self, numerator: int = 85, denominator: int = 100, width: int = 5, bands: int = 25, rows: int = 5, bits: int = 2, slack: float = 0.25, block: int = 4096, seed: int = 1):
        self.numerator, self.denominator, self.width, self.bands, self.rows, self.bits, self.slack, self.block = numerator, denominator, width, bands, rows, bits, slack, block
        self.least_estimate = numerator / denominator - slack
        random = np.random.default_rng(seed)
        self.mul = random.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = random.integers(0, 1 << 63, bands * rows, np.uint64)


def minima(items: np.ndarray, p: Params) -> np.ndarray:
    out = np.full(len(p.mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        part = items[at : at + 256, None] * p.mul
        part += p.add
        np.minimum(out, part.min(axis=0), out=out)
    return mix(out)


def band_hashes(low: np.ndarray, p: Params) -> np.ndarray:
    grid, total = low.reshape(p.bands, p.rows), np.arange(1, p.bands + 1, dtype=np.uint64)
    for k in range(p.rows):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + grid[:, k])
    return total


def pack(low: np.ndarray, p: Params) -> bytes:
    """The low bits, plane by plane, so that equal positions are found by XOR, OR and a bit count."""
    planes = [np.packbits((low >> np.uint64(k)).astype(np.uint8) & 1) for k in range(p.bits)]
    return b"".join(x.tobytes() for x in planes)


def estimates(one: np.ndarray, many: np.ndarray, p: Params) -> np.ndarray:
    """Likeness of packed signatures (rows of ``many``) to ``one``: share of equal low bits, corrected for chance."""
    k, width = len(p.mul), many.shape[-1] // p.bits
    unlike = np.zeros((len(many), width), np.uint8)
    for b in range(p.bits):
        unlike |= many[:, b * width : (b + 1) * width] ^ one[b * width : (b + 1) * width]
    equal = 1 - np.bitwise_count(unlike).sum(axis=1, dtype=np.int64) / k
    chance = 0.5**p.bits
    return (equal - chance) / (1 - chance)


def _sketches(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                items = shingle_set(text, p.width)
                low = minima(items, p) if len(items) else None
                digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                rows.append((len(items), digest, None if low is None else as_long(band_hashes(low, p)), None if low is None else pack(low, p)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], _SKETCH_ARROW.field(k + 1).type) for k in range(4))], schema=_SKETCH_ARROW)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, width).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "items"])

    return run


def linked(a: np.ndarray, b: np.ndarray, p: Params) -> bool:
    """Whether two sorted sets reach the threshold, exactly."""
    if p.denominator * min(len(a), len(b)) < p.numerator * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return p.denominator * both >= p.numerator * (len(a) + len(b) - both)


def _confirm(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), p) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(p: Params):
    """Keeps the pairs whose signatures allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
                width = a.shape[1] // p.bits
                unlike = np.zeros((len(a), width), np.uint8)
                for k in range(p.bits):
                    unlike |= a[:, k * width : (k + 1) * width] ^ b[:, k * width : (k + 1) * width]
                chance = 0.5**p.bits
                like = (1 - np.bitwise_count(unlike).sum(axis=1, dtype=np.int64) / len(p.mul) - chance) / (1 - chance)
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(like >= p.least_estimate))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of equal keys in rows that are sorted by them."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


def _contested(p: Params):
    """Of each bucket block: the nodes that may be linked to a node of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bh", "one", "two"]):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
            comp = np.array([r["comp"] for r in rows])
            hit = np.zeros(len(rows), bool)
            for k in range(len(rows) - 1):
                near = (comp[k + 1 :] != comp[k]) & (estimates(sig[k], sig[k + 1 :], p) >= p.least_estimate)
                hit[k + 1 :] |= near
                hit[k] |= bool(near.any())
            if hit.any():
                of = np.flatnonzero(hit)
                yield pa.RecordBatch.from_pydict({k: [rows[i][k] for i in of] for k in ("bh", "one", "two", "node", "comp", "sig")}, schema=pa.schema([("bh", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("sig", pa.binary())]))

    return run


def _settle(p: Params):
    """Links that join components, found in one block of a bucket; pairs that are joined already aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bh", "one", "two"]):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
            comp, sets, out = np.array([r["comp"] for r in rows]), [np.frombuffer(r["items"], np.uint64) for r in rows], []
            for k in range(len(rows) - 1):
                for j in np.flatnonzero((comp[k + 1 :] != comp[k]) & (estimates(sig[k], sig[k + 1 :], p) >= p.least_estimate)) + k + 1:
                    if comp[j] != comp[k] and linked(sets[k], sets[j], p):
                        out.append((rows[k]["node"], rows[j]["node"]))
                        comp[comp == comp[j]] = comp[k]
            if out:
                yield pa.RecordBatch.from_pydict({"u": [x[0] for x in out], "v": [x[1] for x in out]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Deals each bucket's nodes to blocks; a row goes to every pair of blocks that its own is in."""
    sizes = rows.groupBy("bh").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, part) as one, greatest(x, part) as two))")
    return rows.join(dealt(sizes), "bh").withColumn("part", part).withColumn("pair", F.explode(pairs)).select(*rows.columns, "pair.one", "pair.two")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked when ``denominator * |A & B| >= numerator * |A | B|`` for their shingle sets, and
    ``component_id`` is the smallest doc_id reachable. Null and wordless texts have an empty set and are alone. Rows
    with the same doc_id are one document with the links of each. Rows without a doc_id are linked with nothing, have
    no component and are kept. Other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    p = params or Params()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(docs.mapInArrow(_sketches(p), SKETCH), "sketches")
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = materialize(real.select("digest", F.col("doc_id").alias("node"), "bands", "sig").join(dealt(reps), ["digest", "node"]).dropDuplicates(["digest", "node"]), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bh"))
    buckets = banded.groupBy("bh").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").select("bh", "rep")
    members = materialize(banded.join(dealt(buckets), "bh").select("bh", "node", "rep"), "members")
    sigs = nodes.select("node", "sig")
    stars = members.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v")).distinct()
    both = stars.join(dealt(sigs.toDF("u", "a")), "u").join(dealt(sigs.toDF("v", "b")), "v")
    likely = materialize(both.mapInArrow(_likely(p), "u long, v long").distinct(), "likely")

    shared = members.select("node").distinct()
    sets = materialize(docs.withColumnRenamed("doc_id", "node").join(dealt(shared), "node").mapInArrow(_sets(p.width), "node long, items binary"), "sets")
    confirmed = likely.join(dealt(sets.toDF("u", "a")), "u").join(dealt(sets.toDF("v", "b")), "v").mapInArrow(_confirm(p), "u long, v long")
    stars = materialize(confirmed.distinct(), "stars")
    release(likely)
    first = connected_components(stars)

    placed = members.select("bh", "node").join(dealt(first), "node", "left").select("bh", "node", F.coalesce("component", "node").alias("comp"))
    split = placed.groupBy("bh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bh")
    rows = _blocks(placed.join(dealt(split), "bh").distinct().join(dealt(sigs), "node").select("bh", "node", "comp", "sig"), p.block)
    by = ["bh", "one", "two"]
    contested = materialize(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(_contested(p), "bh long, one int, two int, node long, comp long, sig binary"), "contested")
    late = contested.join(dealt(sets), "node").repartition(*by).sortWithinPartitions(*by).mapInArrow(_settle(p), "u long, v long")
    late = materialize(late.distinct(), "late")
    release(contested, sets, members, stars)
    # rows that share a doc_id but not a set tie the nodes of their sets
    several = real.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    ties = real.select("doc_id", "digest").join(dealt(several), "doc_id").join(dealt(reps), "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    # the components so far are stars already: the late links join them
    final = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late).union(ties))

    ids = sketches.select("doc_id", "n_shingles", "digest").join(dealt(reps), "digest", "left").withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id")))
    out = materialize(ids.join(dealt(final), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")), "membership")
    release(sketches, nodes, first, late, final)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is the one that stays of its group; all columns of ``docs``."""
    gone = near_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(dealt(gone), docs["doc_id"] == gone["_gone_id"], "left_anti")
