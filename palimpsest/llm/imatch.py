"""I-Match fingerprints: terms of a band of inverse document frequency, hashed over randomised subsets of the lexicon.

Document frequencies are counted over all documents. The lexicon is the whole band from ``most`` of the documents down to
``least`` of them. It has no more terms than the mean document has different terms, divided by ``least``, whatever the
corpus's size (22,072 on 51,282 documents), and goes to the executors as a hash table of integers inside the plan, where each term is looked up in two places. The lexicon is cut at random in subsets
of three sizes, 64 of each: each holds a 64th, 512th or 4096th of the terms. A document's sorted distinct terms in a
subset are hashed; the fingerprint is these hashes. Two fingerprints are compared at the size whose subsets hold about one term
of the two documents: the share of equal and of empty subsets gives the likeness of the term sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 64
LEVELS = 3


def let(x: Column, use) -> Column:
    """``use(x)`` with x evaluated once."""
    return F.transform(F.array(x), use)[0]


def term_hashes(text: Column) -> Column:
    """Distinct words, lower-cased and without the marks around them, as 64-bit hashes."""
    words = F.split(F.lower(text), r"""[\x20\x09-\x0D.,;:!?"'()]+""")
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))


class Lexicon:
    """A hash table of terms, each in one of two places of its own."""

    def __init__(self, hashes: list[int]):
        self.bits = max(6, math.ceil(math.log2(max(1, len(hashes)))) + 2)
        size = 1 << self.bits
        place: dict[int, int] = {}
        for start in hashes:
            h, at, tries = start, (start & (1 << 64) - 1) & (size - 1), 0
            while at in place:  # the one that was here goes to its other place
                h, place[at] = place[at], h
                one, two = self._places(h)
                at, tries = (two if at == one else one), tries + 1
                if tries > 500:
                    raise RuntimeError("the lexicon's table can't be filled")
            place[at] = h
        self.csv = ",".join(str(self._mark(place[k])) if k in place else "0" for k in range(size))

    def _places(self, h: int) -> tuple[int, int]:
        u = h & (1 << 64) - 1
        return u & ((1 << self.bits) - 1), (u >> self.bits) & ((1 << self.bits) - 1)

    @staticmethod
    def _mark(h: int) -> int:
        return ((h & (1 << 64) - 1) >> 33) | 1

    def holds(self, h: Column) -> Column:
        """Whether a term's hash is in the lexicon; a term outside is taken for one inside once in two thousand million."""
        table = F.split(F.lit(self.csv), ",").cast("array<int>")  # folded to a literal
        mask, mark = F.lit((1 << self.bits) - 1).cast("long"), F.shiftrightunsigned(h, 33).cast("int").bitwiseOR(F.lit(1))
        one, two = h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, self.bits).bitwiseAND(mask).cast("int")
        return (F.get(table, one) == mark) | (F.get(table, two) == mark)


def lexicon(docs: DataFrame, least: float = 0.002, most: float = 0.2) -> Lexicon:
    """The terms in the band, from the frequencies of all documents' terms."""
    n = docs.count()
    low, high = max(1, math.ceil(n * least)), max(1, math.floor(n * most))
    counts = docs.select(F.explode(term_hashes("text")).alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    return Lexicon(sorted(r["h"] for r in counts.select("h").collect()))


def cells(text: Column, terms: Lexicon) -> Column:
    """192 hashes from 1 to 65535, 0 for a subset without a term of the text."""

    def entries(band: Column) -> Column:
        def level(k: int) -> Column:
            own = lambda h: F.xxhash64(h)
            at = 0 if k == 0 else 6 + 9 * (k - 1)
            some = band if k == 0 else F.filter(band, lambda h: F.shiftrightunsigned(own(h), at).bitwiseAND(F.lit((1 << 3 * k) - 1).cast("long")) == 0)
            cell = lambda h: F.shiftrightunsigned(own(h), 30 + 6 * k).bitwiseAND(F.lit(CELLS - 1).cast("long")) + 64 + CELLS * k
            return F.transform(some, lambda h: F.concat(F.chr(cell(h)), F.lit(" "), F.hex(h)))

        marks = F.transform(F.sequence(F.lit(64), F.lit(63 + CELLS * LEVELS)), lambda c: F.concat(F.chr(c), F.lit("\t")))
        parts = F.split(F.array_join(F.sort_array(F.concat(marks, *(level(k) for k in range(LEVELS)))), ""), "\t")
        # a part is a subset's sorted terms, and the letter of the next mark
        return F.transform(F.slice(parts, 2, CELLS * LEVELS), lambda s: F.when(F.length(s) <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(s), F.lit(65535)).cast("int") + 1))

    def of(all_terms: Column) -> Column:
        return let(F.filter(all_terms, terms.holds), lambda band: entries(F.when(F.size(band) == 0, all_terms).otherwise(band)))

    return let(term_hashes(text), of)


def fingerprint(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of cells."""

    def level(kinds: Column, k: int) -> tuple[Column, Column]:
        own = F.slice(kinds, CELLS * k + 1, CELLS)
        return F.size(F.filter(own, lambda x: x == 0)), F.size(F.filter(own, lambda x: x == 1))

    def one(empty: Column, same: Column) -> Column:
        equal, none = (empty + same) / CELLS, F.greatest(empty, F.lit(0.5)) / CELLS
        return F.when(same == 0, 0.0).when(empty == CELLS, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log(equal) / F.log(none))))

    def of(kinds: Column) -> Column:
        out = one(*level(kinds, 0))
        for k in range(1, LEVELS):
            empty, same = level(kinds, k)
            out = F.when(CELLS - empty >= 16, one(empty, same)).otherwise(out)
        return out

    kinds = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(2))
    return F.when(a == b, 1.0).otherwise(let(kinds, of))


def _below(splits: Column, x: Column, n: int) -> Column:
    """How many of the n sorted splits are below x, by binary search."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.coalesce(F.get(splits, mid) < x, F.lit(False))
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), start, halve)["lo"]


def with_next(docs: DataFrame, per_bucket: int = 2000, max_buckets: int = 65_536) -> DataFrame:
    """(doc_id, text) -> bucket, own, doc_id, text, next_text: next in descending order, after the last the first.

    Rows are dealt to buckets of the id's order; the largest of a bucket is also sent, as a lender (own 0), to the
    bucket above, and the largest of all to the lowest. So one shuffle of the texts does, and no bucket is larger than its share.
    """
    n, top = docs.agg(F.count("*"), F.max("doc_id")).first()
    k = min(max_buckets, -(-max(1, n) // per_bucket))
    splits = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 20 * k))).first()[0] if k > 1 else []
    splits = sorted({s for s in splits or [] if s < top})
    array = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>") if splits else F.array().cast("array<bigint>")
    bucket = _below(array, F.col("doc_id"), len(splits))
    to = lambda b, own: F.array(F.struct(b.cast("int").alias("bucket"), F.lit(own).alias("own")))
    none = F.expr("cast(array() as array<struct<bucket: int, own: int>>)")
    rows = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    lend = F.when(F.get(array, F.col("bucket")) == F.col("doc_id"), to(F.col("bucket") + 1, 0)).otherwise(none)
    around = F.when(F.col("doc_id") == F.lit(top).cast("long"), to(F.lit(0), 0)).otherwise(none)
    dealt = rows.withColumn("to", F.explode(F.concat(to(F.col("bucket"), 1), lend, around))).select("doc_id", "text", "to.bucket", "to.own")
    return dealt.selectExpr("*", "lag(text) over (partition by bucket order by own, doc_id, text) as next_text")


def fingerprints(docs: DataFrame, least: float = 0.002, most: float = 0.2) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points (rounded down) replaced by the first as many of the next
    document's in descending order of doc_id, after the last the first. Null texts are empty. Rows with one doc_id follow in descending order of their texts; a null doc_id is below all
    others, and a table of nothing else lends nothing. A text without a term in the band is judged by all its terms; without any, its
    subsets are all empty. Equal texts have equal fingerprints, and likeness 1. A row for each row; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = lexicon(docs, least, most)
    rows = with_next(docs)
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 3), substring(coalesce(next_text, ''), 1, cast(n_chars div 3 as int)))")
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("edited", edited)
    rows = rows.withColumn("both", F.transform(F.array("text", "edited"), lambda t: cells(t, terms)))
    rows = rows.select("bucket", "own", "doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("both")[0].alias("a"), F.col("both")[1].alias("e"))
    rows = rows.selectExpr("*", "lag(a) over (partition by bucket order by own, doc_id, text) as x")
    empty = F.array_repeat(F.lit(0), CELLS * LEVELS)
    rows = rows.where("own = 1").withColumn("x", F.coalesce("x", empty))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"))
