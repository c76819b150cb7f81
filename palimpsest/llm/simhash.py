"""SimHash near duplicates by covering locality-sensitive hashing: no pair within the radius is lost.

1. A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of its shingles' XXH64 values.
2. Each bit position i has a vector m(i) of radius + 1 bits, not zero. For each vector v but zero there is a table; its
   mask has the positions whose m(i) has an odd product with v. Any ``radius`` positions are all orthogonal to some v,
   as radius vectors can't span radius + 1 dimensions. So two fingerprints that differ in these positions only are
   equal under the mask of v: they meet in that table.
3. Equal fingerprints are one node. Each node goes under its masked value in every table, and a bucket's nodes are
   compared by XOR and a bit count. A bucket gives a spanning forest of its links, never all its pairs.
4. A bucket of more than ``most`` nodes is dealt anew under a second set of masks (other vectors, the same guarantee),
   joined with the first, and so on. Each set halves the bits left free, so buckets have a bound that doesn't depend
   on the data: at the fourth set 2 to the power of the few bits still free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release, utf8
from .components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_CHUNK = 1 << 20


class Params:
    """``width`` words a shingle, links at ``radius`` or fewer differing bits; ``most``: nodes of a bucket that one task
    compares; ``sets``: sets of masks, one more for each time that a bucket is dealt anew."""

    def __init__(self, radius: int = 4, width: int = 4, seed: int = 42, most: int = 4096, sets: int = 4):
        self.radius, self.width, self.seed, self.most, self.sets = radius, width, seed, most, sets


def mask_set(radius: int, k: int) -> list[int]:
    """The masks of set k, one for each vector but zero. Every vector but zero is dealt to equally many positions, or one more."""
    n = (1 << (radius + 1)) - 1
    order = np.random.default_rng(k).permutation(64) if k else np.arange(64)
    vector = [1 + int(order[i]) % n for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- fingerprints


def fingerprint(data: bytes, p: Params) -> int:
    """Of a UTF-8 text. Long texts go piece by piece."""
    from xxhash import xxh64_intdigest

    ones, n, words, at = np.zeros(64, np.int64), 0, [], 0

    def add(upto: int) -> None:
        nonlocal ones, n
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts, span = np.concatenate([[0], ends[:-1]]).tolist(), p.width
        ends, seed = (ends - 1).tolist(), p.seed
        values = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:upto], ends[span - 1 : span - 1 + upto], strict=True)], "<u8")
        for k in range(0, len(values), 65536):
            ones += np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(values)

    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        words += data[at:end].translate(_LOWER).split()
        if len(words) >= p.width and end < len(data):
            add(len(words) - p.width + 1)
            words = words[len(words) - p.width + 1 :] if p.width > 1 else []
        at = end
    if len(words) >= p.width:
        add(len(words) - p.width + 1)
    elif words and not n:
        n, value = 1, xxh64_intdigest(b" ".join(words), p.seed)
        ones += np.array([value >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > n)


def _fingerprints(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, p)) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


# ---------------------------------------------------------------- links


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is joined by links of at most ``radius`` bits: each value is reached once, from one that was before."""
    left, out = np.arange(1, len(values)), []
    todo = [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        here = todo.pop()
        near = np.bitwise_count(values[left] ^ values[here]) <= radius
        for j in left[near].tolist():
            out.append((here, j))
            todo.append(j)
        left = left[~near]
    return out


_FOUND = "u long, v long, mask long, key long"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("u", "v", "mask", "key")])


def _compare(p: Params, last: bool):
    """Rows sorted by bucket -> links (u, v), and the rows of buckets that are too large (u, and the bucket's mask and key)."""

    def links(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        """Of whole buckets."""
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        size, start = np.diff(edge), edge[:-1]
        two = start[size == 2]
        two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= p.radius]
        out = [np.stack([values[two], values[two + 1]], axis=1)]
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = forest(values[a : a + n], p.radius)
            if found:
                out.append(values[a : a + n][np.array(found)])
        return out

    def table(pairs: list[np.ndarray]) -> pa.RecordBatch:
        of = np.concatenate(pairs).view(np.int64) if pairs else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(of), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(of[:, 0]), pa.array(of[:, 1]), none, none], schema=_FOUND_ARROW)

    def large(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], schema=_FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, beyond = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), None  # beyond: the bucket whose rows are handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([batch.column("mask").to_numpy(), batch.column("key").to_numpy()], axis=1)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if beyond is not None:
                n = int(np.argmin(np.append((more == beyond).all(axis=1), False)))
                if n:
                    yield large(more[:n], fps[:n])
                more, fps = more[n:], fps[n:]
                if not len(fps):
                    continue
                beyond = None
            keys, values = np.concatenate([keys, more]), np.concatenate([values, fps])
            # the last bucket may go on in the next batch
            cut = len(keys) - int(np.argmin(np.append((keys[::-1] == keys[-1]).all(axis=1), False)))
            if not last:
                edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
                over = np.repeat(np.diff(edge) > p.most, np.diff(edge))
                if over.any():
                    yield large(keys[over], values[over])
                    if over[-1]:
                        beyond = keys[-1]
                    cut = len(keys) if over[-1] else cut
                if cut:
                    some = ~over[:cut]
                    if some.any():
                        yield table(links(keys[:cut][some], values[:cut][some]))
            elif cut:
                yield table(links(keys[:cut], values[:cut]))
            keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield table(links(keys, values))

    return run


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask) -> fp, mask, key: each row once for each of ``masks``, joined with its own."""
    joined = rows.select("fp", F.explode(F.array(*(F.col("mask").bitwiseOR(F.lit(_signed(m))) for m in masks))).alias("mask"))
    return joined.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def near_links(nodes: DataFrame, p: Params) -> DataFrame:
    """Distinct fp -> (u, v): links within the radius that join what all such links join. A written table."""
    rows, found = _dealt(nodes.select("fp", F.lit(0).cast("long").alias("mask")), mask_set(p.radius, 0)), []
    for k in range(p.sets):
        last = k == p.sets - 1
        got = materialize(rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_compare(p, last), _FOUND), "simhash-links")
        found.append(got)
        rest = got.where("v is null")
        if last or not rest.limit(1).count():
            break
        rows = _dealt(rest.selectExpr("u as fp", "mask"), mask_set(p.radius, k + 1))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    out = materialize(links.where("v is not null").select("u", "v").distinct(), "simhash-pairs")
    release(*found)
    return out


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, fingerprint, component_id: one row for each row of ``docs``.

    Rows are linked when their fingerprints differ in ``radius`` bits at most; ``component_id`` is the smallest doc_id
    reachable. Null, empty and wordless texts have the fingerprint zero and are linked like any other; with fewer words
    than a shingle has, the whole sequence is the one shingle. Each row has the fingerprint of its own text, also where
    rows share a doc_id. Rows without a doc_id link others, but give no component an id: a component of such rows only
    has none. Other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    p = params or Params()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(docs.mapInArrow(_fingerprints(p), "doc_id long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = near_links(nodes, p)
    found = connected_components(links)
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(ids, "component").select("fp", "component_id")
    out = materialize(prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "simhash")
    release(prints, nodes, links, found)
    return out
