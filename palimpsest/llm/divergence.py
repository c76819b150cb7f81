"""How much each source's use of terms diverges from each other source's, and from its language's.

1. Each task counts terms document by document and hands on its sums by language, source and term.
2. A term's counts in the sources of its language are its vector, kept sparse: sources without the term aren't in it.
   Terms with equal vectors are one column with a multiplicity, so each pair of sources is evaluated once for it.
3. Of a pair, one source or both may be absent from a vector, and then have the share of a count of zero. The sum over all terms is
   that of two absent sources for every term, plus for each source that is present what it changes beside an absent
   one (which depends on its count only: a histogram of counts is enough), plus for both what that leaves out.
4. The terms part ranks vectors first and gives only those that can be in front back their terms.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, release, utf8

#: The scale of shares, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
_CHUNK = 1 << 20
_HELD = 500_000


def _table() -> bytes:
    """A-Z lower-cased, all that no term has turned into a space. In UTF-8 the bytes from 0x80 on are those of other code points, which all are in terms."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


_TERMS = _table()


def term_counts(data: bytes) -> Counter:
    """Occurrences of each term of one UTF-8 text; long ones go piece by piece."""
    if len(data) <= _CHUNK:
        return Counter(data.translate(_TERMS).split())
    out, at = Counter(), 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and _TERMS[data[end]] != 32:
            end += 1
        out.update(data[at:end].translate(_TERMS).split())
        at = end
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, n, docs: sums of what this task has read, handed on whenever they are many."""
    sums: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0

    def table() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in sums.items():
            names, found = list(terms), list(terms.values())
            for k in range(0, len(names), 50_000):
                some = found[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(names[k : k + 50_000], pa.binary()).cast(pa.string()), pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text")), strict=True):
            mine = sums.setdefault((lang, source), {})
            size = len(mine)
            for term, n in term_counts(text).items():
                x = mine.get(term)
                if x is None:
                    mine[term] = [n, 1]
                else:
                    x[0] += n
                    x[1] += 1
            held += len(mine) - size
            if held > _HELD:
                yield from table()
                sums, held = {}, 0
    yield from table()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exactly, as a long."""
    over, under = count + ADDED, total + ADDED * terms
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * over.cast("decimal(20,0)"), under.cast("decimal(20,0)"))
    return 1 + F.when(over < (1 << 63) // SCALE, F.call_function("div", F.lit(SCALE).cast("long") * over, under)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); shares are at most SCALE + 1, so squares are within a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """documents -> lang, source, part, item, value, rank.

    Null text, lang and source are ''. A language's terms are those in at least ``least`` of its documents; repeated rows
    are documents of their own. Part `pair` has for each source each other one of its language, and the distances of their
    shares summed over all terms (0 where there is none); part `term` its ``top`` terms that it uses more than
    its language does. Ties go by item, in UTF-8 order. Other columns are ignored, whatever their names; an empty table
    gives an empty table, and a language with one source no pairs.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    sums = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    kept = materialize(vectors.where(F.col("docs") >= least).select("lang", "term", "total", "vector"), "kept-terms")

    columns = materialize(kept.groupBy("lang", "vector", "total").agg(F.count("*").alias("many")).withColumn("id", F.monotonically_increasing_id()), "count-columns")
    flat = columns.select("id", "lang", "many", "total", F.explode("vector").alias("x")).select("id", "lang", "many", "total", "x.*")
    langs = columns.groupBy("lang").agg(F.sum("many").alias("terms"), F.sum(F.col("many") * F.col("total")).alias("all"))
    sizes = flat.groupBy("lang", "source").agg(F.sum(F.col("many") * F.col("n")).alias("size"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("size", F.lit(0)).alias("size"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))
    groups = materialize(groups.withColumn("p0", zero), "source-sizes")

    shares = flat.join(groups, ["lang", "source"]).select("id", "lang", "source", "many", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), "p0", share(F.col("total"), F.col("all"), F.col("terms")).alias("q"))
    shares = materialize(shares, "shares")

    # each pair of sources of a language: it is in the result, so these rows aren't more than that
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    both_absent = groups.withColumnRenamed("source", "a").join(other, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    counts = shares.groupBy("lang", F.col("source").alias("a"), "p", "p0").agg(F.sum("many").alias("many"))
    beside = counts.join(other, "lang").where("a <> b")
    one = beside.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("many") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("value"))
    whole = shares.groupBy("id", "lang", "many").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("x"))
    first = whole.select("lang", "many", "x", F.posexplode("x").alias("k", "i"))
    pairs = first.select("lang", "many", "i", F.explode(F.slice("x", F.col("k") + 2, F.size("x"))).alias("j"))
    d = lambda a, b: distance(F.col(a), F.col(b))
    both = pairs.select("lang", F.col("i.source").alias("a"), F.col("j.source").alias("b"), (F.col("many") * (d("i.p", "j.p") - d("i.p", "j.p0") - d("i.p0", "j.p") + d("i.p0", "j.p0"))).alias("value"))
    total = materialize(both_absent.union(one).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    pair = total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    more = shares.where("p > q").select("id", "lang", "source", distance(F.col("p"), F.col("q")).alias("value"))
    front = more.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("place") <= top)
    vectors = columns.select("id", F.col("lang").alias("_lang"), "vector", "total")
    named = front.join(vectors, "id").join(kept.withColumnRenamed("lang", "_lang"), ["_lang", "vector", "total"]).select("lang", "source", F.col("term").alias("item"), "value")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    out = materialize(ranked(pair, "pair").union(ranked(named, "term").where(F.col("rank") <= top)), "divergence")
    release(kept, columns, groups, shares, total)
    return out
