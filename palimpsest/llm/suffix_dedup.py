"""Removal of long byte strings that occur more than once, by hash-compared sorting of anchored suffixes.

Every ``length``-byte string holds the stretch of ``gram`` bytes whose hash is smallest in it: its anchor. Equal strings
have the same anchor at the same place, so all places of a string are found among the anchors with one hash.

1. A row for each anchor: its hash, and a 128-bit digest of its surroundings (all strings that it can be the anchor of).
2. Equal surroundings, the inside of copied passages, are equal suffixes: they are counted, and one of them stays.
3. Different surroundings of one anchor are the ends of passages. They are sorted by what follows the anchor, and by
   what stands before it, in merge sorts whose comparisons find the common extension by binary search over
   polynomial prefix hashes; each extension is verified on the bytes. All merges of a batch of anchors go step by step
   together, so that a step is a few array operations. Neighbours in the two orders bound the strings that can
   repeat; strings inside the bounds are matched by their hashes, place by place, and verified on the bytes.
4. Anchors with more than ``most`` different surroundings don't go to one task: their strings are counted by digest,
   with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import as_long, keyed, materialize, mix, powers, prefix_hashes, release, utf8

_ANCHORS = "doc_id long, rid long, kh long, d1 long, d2 long, pos int, start int, stop int"


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in a string of ``length`` bytes."""
    prefix, n = prefix_hashes(data), len(data) - gram + 1
    h = (prefix[gram:] - prefix[:n]) * powers("down", n)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    low = _slide(h, width, True)
    padded = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, width, False) == h)
    return at, h[at]


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = length - gram
        for batch in batches:
            ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            cols: list[list] = [[] for _ in range(8)]
            for doc, rid, text in zip(ids, rids, utf8(batch.column("text")), strict=True):
                if len(text) < length:
                    continue
                at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                start, stop = np.maximum(at - before, 0), np.minimum(at + length, len(text))
                digests = []
                for a, s, e in zip(at.tolist(), start.tolist(), stop.tolist(), strict=True):
                    d = hashlib.blake2b((a - s).to_bytes(4, "little"), digest_size=16)
                    d.update(text[s:e])
                    digests.append(d.digest())
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                for c, x in zip(cols, ([doc] * len(at), np.full(len(at), rid), as_long(h), pair[:, 0], pair[:, 1], at, start, stop), strict=True):
                    c.append(x)
            if cols[1]:
                flat = [pa.array([y for x in cols[0] for y in x], pa.int64()), *(pa.array(np.concatenate(c), pa.int64()) for c in cols[1:5]), *(pa.array(np.concatenate(c).astype(np.int32)) for c in cols[5:])]
                yield pa.RecordBatch.from_arrays(flat, names=["doc_id", "rid", "kh", "d1", "d2", "pos", "start", "stop"])

    return run


class _Surroundings:
    """The different surroundings of many anchors, those of one anchor behind each other, with prefix hashes."""

    def __init__(self, texts: list[bytes], lefts: list[int], sizes: list[int]):
        """``lefts``: bytes before the anchor; ``sizes``: how many surroundings each anchor has."""
        self.texts, self.n, self.sizes = texts, len(texts), np.array(sizes)
        self.width = max(map(len, texts)) + 1
        self.data = np.frombuffer(b"".join(t.ljust(self.width, b"\0") for t in texts), np.uint8).reshape(self.n, -1)
        self.hashes = np.zeros((self.n, self.width + 1), np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers("up", self.width), axis=1, out=self.hashes[:, 1:])
        self.left = np.array(lefts)
        self.right = np.array([len(t) for t in texts]) - self.left
        self.first = np.cumsum(self.sizes) - self.sizes
        self.group = np.repeat(np.arange(len(sizes)), sizes)

    def stretch(self, i: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.hashes[i, end] - self.hashes[i, start]) * powers("down", self.width + 1)[start]

    def common(self, i: np.ndarray, j: np.ndarray, after: bool, verify: bool = True) -> np.ndarray:
        """Lengths of the common extensions of pairs: binary search over prefix hashes, verified on the bytes."""
        have = self.right if after else self.left
        lo, hi, x, y = np.zeros(len(i), np.int64), np.minimum(have[i], have[j]), self.left[i], self.left[j]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.stretch(i, x, x + mid) == self.stretch(j, y, y + mid) if after else self.stretch(i, x - mid, x) == self.stretch(j, y - mid, y)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        for k, (a, b, p, q, n) in enumerate(zip(i.tolist(), j.tolist(), x.tolist(), y.tolist(), lo.tolist(), strict=True)) if verify else ():
            s, t = (self.texts[a][p : p + n], self.texts[b][q : q + n]) if after else (self.texts[a][p - n : p], self.texts[b][q - n : q])
            if s != t:  # two strings with one hash
                at = range(n) if after else range(n - 1, -1, -1)
                lo[k] = next(m for m, c in enumerate(at) if s[c] != t[c])
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, after: bool) -> np.ndarray:
        """Whether i's extension sorts before j's, or like it; ``n`` is their common length."""
        have = self.right if after else self.left
        x, y = (self.left[i] + n, self.left[j] + n) if after else (self.left[i] - n - 1, self.left[j] - n - 1)
        return (n == have[i]) | (n < have[j]) & (self.data[i, np.maximum(x, 0)] < self.data[j, np.maximum(y, 0)])

    def order(self, who: np.ndarray, after: bool, verify: bool) -> np.ndarray:
        """``who``, by anchor, in the order of their extensions: a merge sort of all anchors at once.

        Two runs are merged by the place of each of their members in the other run, found by binary search."""
        order, run, sizes = who, 1, np.bincount(self.group[who], minlength=len(self.sizes))
        size, first = sizes[self.group[who]], (np.cumsum(sizes) - sizes)[self.group[who]]
        place = np.arange(len(who)) - first
        while run < sizes.max(initial=0):
            second = (place // run) % 2 == 1
            begin = place // run * run
            # the other run of each place, [lo, hi) from the anchor's first
            lo = np.where(second, begin - run, np.minimum(begin + run, size))
            other, hi = lo.copy(), np.where(second, begin, np.minimum(begin + 2 * run, size))
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                two = second[open_]
                own, met = order[open_], order[first[open_] + mid]
                # equal ones of the first run come first
                i, j = np.where(two, met, own), np.where(two, own, met)
                ahead = self.before(i, j, self.common(i, j, after, verify), after) == two
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            new = np.empty_like(order)
            new[first + np.where(second, begin - run, begin) + (place - begin) + (lo - other)] = order
            order, run = new, 2 * run
        return order

    def longest(self, after: bool, verify: bool = False) -> np.ndarray:
        """The longest common extension of each with another of its anchor: that with a neighbour in the order.

        Equal extensions are sorted once. Comparisons of the sort are by hashes alone; neighbours are verified on the
        bytes, and where two aren't in order all is done again with each comparison verified."""
        ends = (self.left, self.left + self.right) if after else (np.zeros_like(self.left), self.left)
        everyone = np.arange(self.n)
        h = mix(self.stretch(everyone, *ends) + mix((self.group.astype(np.uint64) << np.uint64(16)) + (ends[1] - ends[0]).astype(np.uint64)))
        _, who, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if verify:
            who, of, times = everyone, everyone, np.ones(self.n, np.int64)
        best = np.zeros(len(who), np.int64)
        rank = np.empty(self.n, np.int64)
        rank[who] = np.arange(len(who))
        order = self.order(np.sort(who), after, verify)
        i, j = order[:-1], order[1:]
        same = self.group[i] == self.group[j]
        i, j = i[same], j[same]
        n = self.common(i, j, after)
        if not verify and not self.before(i, j, n, after).all():
            return self.longest(after, True)
        np.maximum.at(best, rank[i], n)
        np.maximum.at(best, rank[j], n)
        out = best[of]
        again = np.flatnonzero((times > 1)[of])
        n = self.common(again, who[of[again]], after)
        if not verify and (n < (ends[1] - ends[0])[again]).any():
            return self.longest(after, True)
        out[again] = n
        return out

    def repeated(self, length: int, slab: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Strings that stand in another place too: whose they are, and their starts (from its own start), in order.

        Strings are compared at one distance from the anchor, so that a place counts once from each anchor in it."""
        low, high = np.maximum(length - self.longest(True), 0), np.minimum(self.longest(False), self.left)
        out = [np.zeros(0, np.int64)]
        pair = (self.sizes == 2)[self.group]
        every = np.flatnonzero(low <= high)

        def strings(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = np.maximum(hi - lo + 1, 0)
            i = np.repeat(who, n)
            return i, np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)

        two = every[pair[every]]  # of two, the bounds are the answer
        i, a = strings(two, low[two], high[two])
        out.append(i << 32 | self.left[i] - a)
        many = every[~pair[every]]
        if len(many):
            step = max(1, slab // len(many))
            for at in range(int(low[many].min()), int(high[many].max()) + 1, step):
                i, a = strings(many, np.maximum(low[many], at), np.minimum(high[many], at + step - 1))
                out += [k << 32 | self.left[k] - z for k, z in self._matched(i, a, length)]
        all_ = np.unique(np.concatenate(out))
        return all_ >> 32, all_ & 0xFFFFFFFF

    def _matched(self, i: np.ndarray, a: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of strings of ``i`` that begin ``a`` bytes before the anchor: those that another of the anchor has too."""
        start = self.left[i] - a
        h = mix(self.stretch(i, start, start + length) + mix((self.group[i].astype(np.uint64) << np.uint64(20)) + a.astype(np.uint64)))
        o = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[o][1:] != h[o][:-1])) if len(o) else np.zeros(0, bool)
        rep = o[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first of the strings with one hash
        x, y, z = i[o[~new]], i[rep[~new]], a[o[~new]]
        by = np.lexsort((z, y, x))
        x, y, z = x[by], y[by], z[by]
        # runs of neighbouring strings of two surroundings are verified on the bytes at once
        edge = np.concatenate(([0], np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(z) != 1)) + 1, [len(x)])) if len(x) else np.zeros(1, np.int64)
        b, e = edge[:-1], edge[1:] - 1
        true = np.repeat(self.group[x[b]] == self.group[y[b]], e - b + 1)
        texts = self.texts
        for first, last, k, m, p, q, lo, hi in zip(b.tolist(), e.tolist(), x[b].tolist(), y[b].tolist(), self.left[x[b]].tolist(), self.left[y[b]].tolist(), z[b].tolist(), z[e].tolist(), strict=True):
            if texts[k][p - hi : p - lo + length] != texts[m][q - hi : q - lo + length]:  # one hash for two strings
                for n in range(first, last + 1):
                    true[n] &= texts[k][p - z[n] : p - z[n] + length] == texts[m][q - z[n] : q - z[n] + length]
        return [(x[true], z[true]), (y[true], z[true])]


_RANGES = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _settle_ends(length: int, at_once: int = 2_000_000):
    """``at_once``: bytes of surroundings that are sorted together; those of one anchor always are."""

    def settle(groups: list[list[dict]]) -> pa.RecordBatch:
        rows = [r for g in groups for r in g]
        cols: list = [[], [], [], []]
        if rows:
            who, at = _Surroundings([r["ctx"] for r in rows], [r["pos"] - r["start"] for r in rows], [len(g) for g in groups]).repeated(length)
            alone = np.array([r["c"] == 1 for r in rows])[who]  # the others go whole
            who, at = who[alone], at[alone]
            if len(who):
                cut = np.flatnonzero((np.diff(who) != 0) | (np.diff(at) > length)) + 1
                first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(who)])) - 1
                own = [rows[k] for k in who[first].tolist()]
                base = np.array([r["start"] for r in own])
                cols = [[r["doc_id"] for r in own], [r["rid"] for r in own], base + at[first], base + at[last] + length]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RANGES, strict=True)], schema=_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, groups, size = None, [], [], 0

        def close() -> None:
            if len(rows) > 1 and any(r["c"] == 1 for r in rows):
                groups.append(rows)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kh"] != now:
                    close()
                    if size > at_once:
                        yield settle(groups)
                        groups, size = [], 0
                    now, rows = row["kh"], []
                rows.append(row)
                size += len(row["ctx"])
        close()
        yield settle(groups)

    return run


def _strings(length: int):
    """A row for each string of the surroundings: its digest and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["ctx"]) - length + 1
                d = np.frombuffer(b"".join(hashlib.blake2b(r["ctx"][k : k + length], digest_size=16).digest() for k in range(n)), np.int64).reshape(-1, 2)
                at = r["start"] + np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]] * n, pa.int64()), pa.array([r["rid"]] * n, pa.int64()), pa.array(at), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "rid", "start", "d1", "d2"])

    return run


def _cut(more: list[str], characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for r in sorted((x["start"], x["stop"]) for x in ranges or ()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append([*r])
                parts, at, gone = [], 0, 0
                for b, e in runs:
                    if characters:  # not into the middle of one
                        while b > at and text[b] & 0xC0 == 0x80:
                            b -= 1
                        while e < len(text) and text[e] & 0xC0 == 0x80:
                            e += 1
                        b = max(b, at)
                    parts.append(text[at:b])
                    gone, at = gone + e - b, e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                sizes.append(len(text))
                removed.append(gone)
                spans.append(len(runs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *map(batch.column, more)], names=["doc_id", "rid", "kept", "n_bytes", "n_removed", "n_spans", *more])

    return run


def repeated_ranges(docs: DataFrame, length: int = 400, gram: int = 128, most: int = 32_768) -> DataFrame:
    """(doc_id, rid, text) -> doc_id, rid, start, stop: byte ranges covered by strings that start anywhere else too.

    Ranges of one document may overlap. ``rid`` tells rows with one doc_id apart. ``most``: different surroundings of
    one anchor that a single task sorts.
    """
    every = materialize(docs.mapInArrow(_find_anchors(length, gram), _ANCHORS), "anchors")
    # equal surroundings meet in partial sums before they are shuffled; a passage that is everywhere is a row from each task
    key = ["d1", "d2"]
    classes = materialize(every.groupBy(*key).agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("kh", "doc_id", "rid", "pos", "start", "stop"))), "classes")
    inside = every.join(classes.where("c > 1").select(*key).hint("merge"), key, "left_semi").select("doc_id", "rid", "start", "stop")

    ends = classes.groupBy("kh").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 and least = 1").select("kh", "n")
    open_ = classes.join(ends.hint("merge"), "kh").select("kh", "n", "c", "pos", "start", "stop", F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    # identical rows of the table give one text for a key
    texts = docs.join(open_.hint("merge"), docs["doc_id"].eqNullSafe(open_["a"]) & (docs["rid"] == open_["b"]))
    ctx = texts.select("kh", "n", "c", "doc_id", "rid", "pos", "start", F.expr("substring(cast(text as binary), start + 1, stop - start)").alias("ctx"))
    ctx = materialize(ctx, "surroundings")
    few = ctx.where(F.col("n") <= most).dropDuplicates(["kh", "doc_id", "rid", "pos"])
    some = few.repartition("kh").sortWithinPartitions("kh").select("kh", "c", "doc_id", "rid", "pos", "start", "ctx").mapInArrow(_settle_ends(length), "doc_id long, rid long, start int, stop int")
    strings = ctx.where(F.col("n") > most).dropDuplicates(["kh", "doc_id", "rid", "pos"]).select("doc_id", "rid", "start", "ctx").mapInArrow(_strings(length), "doc_id long, rid long, start int, d1 long, d2 long").distinct()
    twice = strings.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("d1", "d2")
    rest = strings.join(twice, ["d1", "d2"], "left_semi").select("doc_id", "rid", "start", (F.col("start") + length).alias("stop"))
    # written, so that what it came from needs no place while the texts are cut
    out = materialize(inside.union(some).union(rest).distinct(), "ranges")
    release(every, classes, ctx)
    return out


def _find_grams(passage: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rids, hashes = [], [], []
            for doc, rid, text in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), utf8(batch.column("text")), strict=True):
                if len(text) >= passage:
                    h = np.unique(anchors(np.frombuffer(text, np.uint8), passage, gram)[1])
                    docs += [doc] * len(h)
                    rids.append(np.full(len(h), rid))
                    hashes.append(as_long(h))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.concatenate(rids), pa.int64()), pa.array(np.concatenate(hashes))], names=["doc_id", "rid", "kh"])

    return run


def shared_grams(docs: DataFrame, passage: int = 288, gram: int = 160) -> DataFrame:
    """(doc_id, rid, text) -> doc_id, rid, n_shared: how many of a document's chosen grams another document has too.

    Each stretch of ``passage`` bytes has a chosen gram, in all documents the same; so documents that share such a passage,
    too short to be removed, have a count over 0. Documents without shared grams have no row.
    """
    every = materialize(docs.mapInArrow(_find_grams(passage, gram), "doc_id long, rid long, kh long"), "grams")
    often = every.groupBy("kh").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("kh")
    out = materialize(every.join(often.hint("merge"), "kh", "left_semi").groupBy("doc_id", "rid").agg(F.count_distinct("kh").alias("n_shared")), "shared-grams")
    release(every)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 128, most: int = 32_768, carry: Column | None = None, passage: int | None = None, characters: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, rid, kept (binary), n_bytes, n_removed, n_spans: one row for each row of ``docs``.

    Each byte is removed that a ``length``-byte string covers which also starts anywhere else, in the same document
    too; overlaps count, matches never cross documents, strings are judged on the input. Null texts are empty, texts
    under ``length`` bytes stay as they are; an empty table gives an empty table. A row that is there twice repeats
    itself. Rows without a doc_id take part like others. ``carry``, if given, comes back
    as ``carried``; other columns are ignored, whatever their names. With ``passage``, n_shared tells of shared passages of
    so many bytes, see :func:`shared_grams`; nothing is removed for them. With ``characters``, code points that lose a byte are removed whole.
    """
    whole = keyed(docs, carry)
    texts = whole.select("doc_id", "rid", "text")
    found = repeated_ranges(texts, length, gram, most).select(F.col("doc_id").alias("a"), F.col("rid").alias("b"), F.struct("start", "stop").alias("range"), F.lit(0).cast("long").alias("n"))
    more = [] if carry is None else ["carried"]
    if passage is not None:
        own = shared_grams(texts, passage)
        found = found.union(own.select("doc_id", "rid", F.lit(None).cast(found.schema["range"].dataType), "n_shared"))
        more.append("n_shared")
    ranges = found.groupBy("a", "b").agg(F.collect_list("range").alias("ranges"), F.sum("n").alias("n"))
    joined = whole.join(ranges.hint("merge"), whole["doc_id"].eqNullSafe(ranges["a"]) & (whole["rid"] == ranges["b"]), "left").withColumn("n_shared", F.coalesce("n", F.lit(0)).cast("long"))
    joined = joined.select("doc_id", "rid", "text", "ranges", *more)
    schema = StructType.fromDDL("doc_id long, rid long, kept binary, n_bytes long, n_removed long, n_spans long")
    return joined.mapInArrow(_cut(more, characters), StructType([*schema, *(joined.schema[c] for c in more)]))
