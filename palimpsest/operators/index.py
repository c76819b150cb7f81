"""Tokens of spans, and a persistent index of them that searches use.

The index of an archive is three Parquet tables. ``postings``: blocks of places, sorted by folded term, so that the reader's
statistics leave out most of the file for a term. A block has up to ``BLOCK`` spans of one term of one archive; a frequent
term has many blocks, dealt to tasks by range. The spans of a block and the byte offsets in them are two columns of
delta-coded variable-length numbers, so a search that wants spans reads no offsets. ``terms``: each term with its totals.
``totals``: spans of each archive.

A search asks the terms table which tokens hold the pieces of its words, takes the spans of the rarest pieces, and runs the
exact filter over these only. Words match inside words, so an outer piece of a word may be the end or the start of a token,
or inside one. What the index can't narrow down (regular expressions, words without letters, pieces in most spans)
is searched as without one.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.query import Query

TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
#: Spans in a block, at most.
BLOCK = 4096
#: Characters of texts that one task takes at once, and spans and places that it decodes at once.
CHUNK, DECODED = 1 << 23, 1 << 18
PLACED = "archive string, span_index long, term string, offsets array<long>"
BLOCKS = "fold string, term string, odd boolean, archive string, first_span long, last_span long, n_spans long, n_places long, spans binary, places binary"
_BLOCKS_ARROW = pa.schema([("fold", pa.string()), ("term", pa.string()), ("odd", pa.bool_()), ("archive", pa.string()), ("first_span", pa.int64()), ("last_span", pa.int64()), ("n_spans", pa.int64()), ("n_places", pa.int64()), ("spans", pa.binary()), ("places", pa.binary())])


class _Folds(dict):
    """Each character to upper and to lower case, found once."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        up = c.upper()
        self[point] = own = (up if len(up) == 1 else c).lower()[0]
        return own


_FOLDS = _Folds()


def fold(text: str) -> str:
    """What texts are compared by when case is ignored: each character by itself to upper and to lower case."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


@cache
def _inside() -> np.ndarray:
    """For each code point whether it is part of a token."""
    return np.array([TOKEN.match(chr(c)) is not None for c in range(0x110000)])


@cache
def _odd() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "No")


def token_places(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens of a text and where they begin, in bytes. All that isn't in a token is made blank, and the text is cut there."""
    if text.isascii():
        blank = text.encode().translate(_ASCII)
        inside = np.frombuffer(blank, np.uint8) != 32
        words, widths = blank.decode().split(), None
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = _inside()[points]
        words = np.where(inside, points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").split()
        widths = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            widths += points >= least
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    return words, starts if widths is None else (np.cumsum(widths) - widths)[starts]


def _numbers() -> defaultdict[str, int]:
    """Texts numbered as they are first asked for."""
    out: defaultdict[str, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Archives, terms, and for each place of a token its archive, span, term and offset; archives and terms are numbers. A chunk has ``most`` characters and a text more at most."""

    def done():
        return list(archives), list(names), *(np.concatenate(x) for x in (own, of, ids, offs))

    archives, names, own, of, ids, offs, held = {}, _numbers(), [], [], [], [], 0
    for batch in batches:
        for archive, span, text in zip(batch.column("archive"), batch.column("span_index"), batch.column("text"), strict=True):
            text = text.as_py()
            found, at = token_places(text) if text else ((), ())
            held += len(text or "")
            if len(found):
                own.append(np.full(len(found), archives.setdefault(archive.as_py(), len(archives)), np.int64))
                of.append(np.full(len(found), span.as_py(), np.int64))
                ids.append(np.fromiter(map(names.__getitem__, found), np.int64, len(found)))
                offs.append(at)
            if held >= most:
                if ids:
                    yield done()
                archives, names, own, of, ids, offs, held = {}, _numbers(), [], [], [], [], 0
    if ids:
        yield done()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each span, with all its offsets. One pass over a text; offsets cost no more than tokens."""
    for batch in batches:
        archives, spans, texts = (batch.column(c).to_pylist() for c in ("archive", "span_index", "text"))
        for lo in range(0, len(texts), 64):
            names = _numbers()
            rows, ids, offs = [], [], []
            for k in range(lo, min(lo + 64, len(texts))):
                if not texts[k]:
                    continue
                found, at = token_places(texts[k])
                ids.append(np.fromiter(map(names.__getitem__, found), np.int64, len(found)))
                offs.append(at)
                rows.append(np.full(len(found), k, np.int64))
            if not ids or not names:
                continue
            row, term, off = np.concatenate(rows), np.concatenate(ids), np.concatenate(offs)
            order = np.lexsort((off, term, row))
            row, term, off = row[order], term[order], off[order]
            edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
            of, words = row[edge].tolist(), list(names)
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(row)), pa.int32()), pa.array(off))
            yield pa.RecordBatch.from_arrays([pa.array([archives[k] for k in of], pa.string()), pa.array([spans[k] for k in of], pa.int64()), pa.array([words[k] for k in term[edge].tolist()], pa.string()), lists], names=["archive", "span_index", "term", "offsets"])


def placed(spans: DataFrame) -> DataFrame:
    """archive, span_index, term, offsets: nothing is shuffled. Null and empty texts have none."""
    return spans.where("text <> ''").select("archive", "span_index", "text").mapInArrow(_placed, PLACED)


def postings(spans: DataFrame) -> DataFrame:
    """term, term_lower, archive, span_index, byte_off: a row for each place of a token."""
    rows = placed(spans).select("term", "archive", "span_index", F.explode("offsets").alias("byte_off"))
    return rows.select("term", F.lower("term").alias("term_lower"), "archive", "span_index", "byte_off")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, names, _, span, term, off in _chunks(batches):
        order = np.lexsort((span, term))
        span, term, off = span[order], term[order], off[order]
        new = np.concatenate([[True], (term[1:] != term[:-1])])
        first = np.flatnonzero(new)
        spans = np.add.reduceat(np.concatenate([[True], span[1:] != span[:-1]]) | new, first, dtype=np.int64)
        columns = [np.diff(np.append(first, len(term))), spans, span[first], np.add.reduceat(off, first), np.maximum.reduceat(off, first)]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in term[first].tolist()], pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "places", "spans", "first_span", "sum_off", "last_off"])


def term_sums(spans: DataFrame) -> DataFrame:
    """term, term_lower, places, spans (distinct ones), first_span, sum_off, last_off (of byte offsets). Tasks add places up before anything is shuffled;
    only spans that are several rows meet by number first."""
    rows = spans.where("text <> ''").select("archive", "span_index", "text")
    several = rows.groupBy("span_index").agg(F.count("*").alias("n")).where("n > 1 or span_index is null").select("span_index")
    schema = "term string, places long, spans long, first_span long, sum_off long, last_off long"
    if several.limit(1).count():
        own = rows.join(several, F.equal_null(rows["span_index"], several["span_index"]), "left_semi")
        places = postings(own).groupBy("term", "span_index").agg(F.count("*").alias("places"), F.sum("byte_off").alias("sum_off"), F.max("byte_off").alias("last_off"))
        more = places.select("term", "places", F.when(F.col("span_index").isNotNull(), 1).otherwise(0).cast("long").alias("spans"), F.col("span_index").alias("first_span"), "sum_off", "last_off")
        out = rows.join(several, F.equal_null(rows["span_index"], several["span_index"]), "left_anti").mapInArrow(_sums, schema).union(more)
    else:
        out = rows.mapInArrow(_sums, schema)
    sums = [f(c).alias(c) for f, c in ((F.sum, "places"), (F.sum, "spans"), (F.min, "first_span"), (F.sum, "sum_off"), (F.max, "last_off"))]
    return out.groupBy("term").agg(*sums).select("term", F.lower("term").alias("term_lower"), *schema.replace(" long", "").replace("term string, ", "").split(", "))


def document_frequency(spans: DataFrame, lower: bool = False) -> DataFrame:
    """term, spans: in how many spans a token is."""
    own = F.transform(tokens(F.col("text")), F.lower) if lower else tokens(F.col("text"))
    return spans.select(F.explode(F.array_distinct(own)).alias("term")).groupBy("term").agg(F.count("*").alias("spans"))


# ---------------------------------------------------------------- blocks


def to_varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0 on, seven bits a byte, the lowest first; the top bit says that more follow. And where each ends, from 0 on."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = (v >> np.uint64(7 * k)) > 0
        if not more.any():
            break
        size += more
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[:-1][has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), at


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + k <= ends
        out[has] |= (b[starts[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _deltas(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences to the value before; at ``firsts`` the value itself."""
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def encode(spans: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, firsts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The two columns of blocks that begin at the rows ``firsts``: spans as deltas; and how many offsets each span has, followed
    by these as deltas, span by span. All blocks are coded in one go."""
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return _coded(spans, sizes, _deltas(offsets, cut[:-1][sizes > 0]), firsts)


def _coded(spans: np.ndarray, sizes: np.ndarray, deltas: np.ndarray, firsts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    rows = np.append(firsts, len(spans))
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    own, own_at = to_varints(_deltas(spans, firsts))
    counts, counts_at = to_varints(sizes)
    places, places_at = to_varints(deltas)
    cuts = [x[rows].tolist() for x in (own_at, counts_at, places_at[cut])]
    bounds = [list(zip(c, c[1:], strict=False)) for c in cuts]
    return [own[a:b] for a, b in bounds[0]], [counts[a:b] + places[c:d] for (a, b), (c, d) in zip(bounds[1], bounds[2], strict=True)]


def decode_spans(data: bytes) -> np.ndarray:
    return np.cumsum(from_varints(data))


def decode_places(data: bytes, n: int) -> list[np.ndarray]:
    """Offsets of each of the block's ``n`` spans."""
    values = from_varints(data)
    sizes, flat = values[:n], values[n:]
    ends = np.cumsum(sizes)
    return [np.cumsum(flat[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ...: as many as the sizes say, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _cut_runs(run_start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Where blocks begin: each run is cut at ``size`` rows."""
    return np.flatnonzero((np.arange(n) - np.repeat(run_start, np.diff(np.append(run_start, n)))) % size == 0)


def _staged(size: int):
    """Spans -> blocks of a chunk: what a term has in it is coded before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archives, names, own, span, term, off in _chunks(batches):
            order = np.lexsort((span, own, term))  # offsets of a span are in order already
            own, span, term, off = own[order], span[order], term[order], off[order]
            new = np.concatenate([[True], (term[1:] != term[:-1]) | (own[1:] != own[:-1])])
            # rows of one number are spans of their own: they begin where offsets go back
            at = np.flatnonzero(new | np.concatenate([[True], (span[1:] != span[:-1]) | (off[1:] <= off[:-1])]))
            sizes, runs = np.diff(np.append(at, len(term))), np.flatnonzero(new[at])
            firsts = _cut_runs(runs, len(at), size)
            spans, places = encode(span[at], sizes, off, firsts)
            of = at[firsts]
            words, lasts = [names[k] for k in term[of].tolist()], np.append(firsts[1:], len(at)) - 1
            odd = [not t.isascii() and not _odd().isdisjoint(t) for t in words]
            columns = [[fold(t) for t in words], words, odd, [archives[k] for k in own[of].tolist()], span[of], span[at[lasts]], lasts - firsts + 1, np.add.reduceat(sizes, firsts), spans, places]
            whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)
            for lo in range(0, whole.num_rows, 50_000):
                yield whole.slice(lo, 50_000)

    return run


def _slices(batches: Iterator[pa.RecordBatch], *counts: str) -> Iterator[pa.RecordBatch]:
    """Batches of blocks, cut so that ``DECODED`` of what is counted, or one block, is decoded at once."""
    for batch in batches:
        n = sum(batch.column(c).to_numpy() for c in counts)
        ends, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + DECODED, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _joined(values: pa.Array) -> bytes:
    return b"".join(values.to_pylist())


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of all blocks, how many offsets each has, and these as deltas."""
    n, m = batch.column("n_spans").to_numpy(), batch.column("n_places").to_numpy()
    spans = from_varints(_joined(batch.column("spans")))
    firsts = np.cumsum(n) - n
    sums = np.cumsum(spans)
    spans = sums - np.repeat(sums[firsts] - spans[firsts], n)
    values = from_varints(_joined(batch.column("places")))
    starts = np.cumsum(n + m) - (n + m)
    return spans, values[_spread(starts, n)], values[_spread(starts + n, m)]


def _blocks(size: int):
    """Blocks of chunks in order of term, archive and span -> blocks. A block ends with its slice at the latest, so none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "n_spans", "n_places"):
            new = np.ones(batch.num_rows, bool)
            differs = [pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in ("term", "archive")]
            new[1:] = differs[0] | differs[1]
            n = batch.column("n_spans").to_numpy()
            alone = new & np.append(new[1:], True) & (n <= size)
            if alone.any():
                yield batch.filter(pa.array(alone))
            if alone.all():
                continue
            batch, new, n = batch.filter(pa.array(~alone)), new[~alone], n[~alone]
            spans, sizes, deltas = _decoded(batch)
            run_of = np.repeat(np.cumsum(new), n)
            order = np.lexsort((spans, run_of))
            starts = (np.cumsum(sizes) - sizes)[order]
            spans, sizes, run_of = spans[order], sizes[order], run_of[order]
            deltas = deltas[_spread(starts, sizes)]
            firsts = _cut_runs(np.flatnonzero(np.diff(run_of, prepend=-1)), len(spans), size)
            lasts = np.append(firsts[1:], len(spans)) - 1
            own, places = _coded(spans, sizes, deltas, firsts)
            names = batch.take(pa.array(np.flatnonzero(new)[run_of[firsts] - 1])).columns[:4]
            columns = [spans[firsts], spans[lasts], lasts - firsts + 1, np.add.reduceat(sizes, firsts), own, places]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(c, f.type) for c, f in zip(columns, list(_BLOCKS_ARROW)[4:], strict=True))], schema=_BLOCKS_ARROW)

    return run


def build(spans: DataFrame, path: str, block: int = BLOCK, options: dict | None = None) -> TermIndex:
    """Writes the index of ``spans`` (archive, span_index, text; span_index from 0 on, one of its own for each span of an archive)."""
    spark, options = spans.sparkSession, options or {}
    spans.where("text <> ''").select("archive", "span_index", "text").mapInArrow(_staged(block), BLOCKS).write.options(**options).parquet(f"{path}/staged")  # texts are read once; ranges are sampled from this
    rows = spark.read.parquet(f"{path}/staged")
    by = ["fold", "term", "archive", "first_span"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocks(block), BLOCKS).write.options(**options).parquet(f"{path}/postings")
    whole = spark.read.parquet(f"{path}/postings").groupBy("fold", "term", "odd").agg(F.sum("n_spans").alias("n_spans"), F.sum("n_places").alias("n_places"))
    whole.repartitionByRange("fold", "term").sortWithinPartitions("fold", "term").write.options(**options).parquet(f"{path}/terms")
    spans.groupBy("archive").agg(F.count("*").alias("spans")).coalesce(1).write.options(**options).parquet(f"{path}/totals")
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/staged")
    staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(staged, True)
    return TermIndex(spark, path)


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "n_spans"):
        n = batch.column("n_spans").to_numpy()
        deltas = from_varints(_joined(batch.column("spans")))
        firsts, sums = np.cumsum(n) - n, np.cumsum(deltas)
        spans = sums - np.repeat(sums[firsts] - deltas[firsts], n)
        yield pa.RecordBatch.from_arrays([batch.column("archive").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(spans)], names=["archive", "span_index"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "n_spans", "n_places"):
        spans, sizes, deltas = _decoded(batch)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        has, sums = cut[:-1][sizes > 0], np.cumsum(deltas)
        offsets = sums - np.repeat(sums[has] - deltas[has], sizes[sizes > 0])
        of = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n_spans").to_numpy()))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(offsets))
        yield pa.RecordBatch.from_arrays([batch.column("term").take(of), batch.column("archive").take(of), pa.array(spans), lists], names=["term", "archive", "span_index", "offsets"])


# ---------------------------------------------------------------- lookup


@dataclass(frozen=True)
class Piece:
    """A token of a searched word: which of its ends a token may go on beyond, and whether case is ignored. ``loose``: an
    end is a word's boundary, which isn't quite a token's; tokens with characters such as superscripts may go on."""

    text: str
    left: bool
    right: bool
    folded: bool
    loose: bool

    def condition(self) -> Column:
        column = F.col("fold" if self.folded else "term")
        within = column.contains(self.text)
        exact = within if self.left and self.right else column.endswith(self.text) if self.left else column.startswith(self.text) if self.right else column == self.text
        if not self.folded and not self.left:  # blocks are in order of fold: it narrows the file down
            start = F.col("fold") == fold(self.text) if not self.right else F.col("fold").startswith(fold(self.text))
            exact = start & exact
        return exact | (F.col("odd") & within) if self.loose else exact


def pieces(term: str, q: Query) -> list[Piece]:
    """Tokens that any text with the term has; none if the term has no letter or digit."""
    out = []
    for m in TOKEN.finditer(term):
        first, last = m.start() == 0, m.end() == len(term)
        text = fold(m.group()) if q.flags.ignore_case else m.group()
        out.append(Piece(text, first and not q.flags.word, last and not q.flags.word, q.flags.ignore_case, q.flags.word and (first or last)))
    return out


class TermIndex:
    """``share``: an alternative whose rarest piece is in a larger part of all spans isn't narrowed down. ``most``: candidates up to which
    their places become ranges that the scan of the spans can leave files and row groups out by; more are joined."""

    def __init__(self, spark: SparkSession, path: str, share: float = 0.25, most: int = 20_000, ranges: int = 64):
        self.spark, self.path, self.share, self.most, self.ranges = spark, path, share, most, ranges

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def places(self) -> DataFrame:
        """term, archive, span_index, offsets: all of it, decoded."""
        return self._table("postings").select("term", "archive", "n_spans", "n_places", "spans", "places").mapInArrow(_place_rows, "term string, archive string, span_index long, offsets array<long>")

    def plan(self, q: Query) -> list[list[Piece]] | None:
        """For each alternative the pieces to look up (two at most, the rarest), or None for a scan; sets ``estimate``."""
        self.estimate = None
        if q.kind == "regex":
            return None
        of = [[p for t in alt for p in pieces(t, q)] for alt in q.alternatives]
        if not all(of):
            return None
        flat = list(dict.fromkeys(p for alt in of for p in alt))
        sums = [F.coalesce(F.sum(F.when(p.condition(), F.col("n_spans"))), F.lit(0)).alias(f"c{k}") for k, p in enumerate(flat)]
        costs = dict(zip(flat, self._table("terms").agg(*sums).first(), strict=True))
        total = self._table("totals").agg(F.sum("spans")).first()[0] or 0
        chosen = [sorted(dict.fromkeys(alt), key=costs.get)[:2] for alt in of]
        estimate = sum(costs[alt[0]] for alt in chosen)
        if estimate > self.share * total:
            return None
        self.estimate = estimate
        # a second piece pays if it isn't much more to read than it can take away
        return [[p for p in alt if p is alt[0] or costs[p] <= 16 * costs[alt[0]]] for alt in chosen]

    def candidates(self, q: Query) -> DataFrame | None:
        """(archive, span_index), each once: all spans with a match are among them. None if the index doesn't narrow the query down."""
        plan = self.plan(q)
        if plan is None:
            return None
        out = None
        for alt in plan:
            both = None
            for p in alt:
                own = self._table("postings").where(p.condition()).select("archive", "n_spans", "spans").mapInArrow(_span_rows, "archive string, span_index long")
                both = own if both is None else both.join(own, ["archive", "span_index"], "left_semi")
            out = both if out is None else out.union(both)
        return out.distinct()

    def narrowed(self, spans: DataFrame, q: Query) -> DataFrame:
        """The spans that may match: those of the candidates, or all."""
        found = self.candidates(q)
        if found is None:
            return spans
        if self.estimate > self.most:
            return spans.join(found, ["archive", "span_index"], "left_semi").select(*spans.columns)
        rows = found.collect()  # as many as the estimate at most
        if not rows:
            return spans.where(F.lit(False))
        here = None
        for lo, hi in ranges(sorted({r["span_index"] for r in rows}), self.ranges):
            own = F.col("span_index").between(lo, hi)
            here = own if here is None else here | own
        few = self.spark.createDataFrame([tuple(r) for r in rows], "archive string, span_index long")
        return spans.where(here).join(F.broadcast(few), ["archive", "span_index"], "left_semi").select(*spans.columns)


def ranges(values: list[int], most: int) -> list[tuple[int, int]]:
    """Sorted values as at most ``most`` ranges: those with the widest gaps between them."""
    gaps = sorted(range(1, len(values)), key=lambda k: values[k - 1] - values[k])[: most - 1]
    cuts = [0, *sorted(gaps), len(values)]
    return [(values[a], values[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
