"""Line dedup by a segment-partition edit join at edit distance 1.

Of two lines that are one edit apart, the shorter (or each, at equal length) cut in two segments, one more than the
threshold, has a segment that the other holds unchanged, in a place that its length gives. So a line of L code points
goes under the two segments of its own cut, as one to be found, and probes with the stretches that the segments of a
line of L - 1 would have in it. Lines that meet are verified by a banded bit-parallel automaton.

Pairs are formed only in buckets of at most ``most`` lines. A larger bucket is dealt anew: one of the halves of what isn't known to be equal
is unchanged too, so each line goes under either half, and so on, until a bucket is small or its lines differ in one place only. There
all are linked, which a minimum shows without forming pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import dealt, keyed, materialize, release

HAS_WORD = r"[^\x20\x09-\x0D]"
_AT = "struct<doc_id: bigint, rid: bigint, no: int>"


def within_one(a: Column, b: Column) -> Column:
    """Whether two lines are at most one edit apart: the band's three diagonals are the bits of a state for no edit and one
    for an edit at most. Each code point of b takes both states on by one AND with the band's matches, and shifts."""

    def chars(s: Column) -> Column:
        return F.split(s, "")

    def step(x: Column):
        def move(s: Column, j: Column) -> Column:
            c = F.get(x["b"], j)
            bit = lambda d: F.when(F.get(x["a"], j + d - 1) == c, F.lit(1 << d)).otherwise(F.lit(0))
            m = (bit(0) + bit(1) + bit(2)).cast("int")
            s0 = s["s0"].bitwiseAND(m)
            s1 = s["s1"].bitwiseAND(m).bitwiseOR(s["s0"]).bitwiseOR(F.shiftright(s["s0"], 1)).bitwiseOR(F.shiftleft(s0, 1)).bitwiseAND(F.lit(7))
            return F.struct(s0.alias("s0"), s1.alias("s1"))

        return move

    def run(x: Column) -> Column:
        start = F.struct(F.lit(2).alias("s0"), F.lit(6).alias("s1"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(x["b"]) - 1), start, step(x))["s1"]
        bit = F.when(F.size(x["a"]) < F.size(x["b"]), 1).when(F.size(x["a"]) == F.size(x["b"]), 2).otherwise(4)
        return end.bitwiseAND(bit) != 0

    near = F.abs(F.length(a) - F.length(b)) <= 1
    pair = F.struct(chars(a).alias("a"), chars(b).alias("b"))
    return F.when(~near, F.lit(False)).when((a == "") | (b == ""), F.lit(True)).otherwise(F.transform(F.array(pair), run)[0])


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """Distinct lines with a word: h, g (hashes), at (first place), len, and their keys: k1, k2 to be found, k3, k4 to probe."""
    rows = docs.select("doc_id", "rid", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(HAS_WORD))
    keyed = rows.selectExpr("doc_id", "rid", "no", "line", "length(line) as len").selectExpr(
        "xxhash64(line) as h",
        "xxhash64(7, line) as g",
        "struct(doc_id, rid, no) as at",
        "len",
        "xxhash64(len, 0, substring(line, 1, len div 2)) as k1",
        "xxhash64(len, 1, substring(line, cast(len div 2 as int) + 1)) as k2",
        "xxhash64(len - 1, 0, substring(line, 1, (len - 1) div 2)) as k3",
        "xxhash64(len - 1, 1, substring(line, cast((len - 1) div 2 as int) + 2)) as k4",
    )
    return keyed.groupBy("h", "g").agg(F.min(F.struct("at", "len", "k1", "k2", "k3", "k4")).alias("x")).select("h", "g", "x.*")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, g, at) -> h, g, line"""
    need = wanted.select("h", "g", "at").distinct().select("h", "g", F.col("at.doc_id").alias("a"), F.col("at.rid").alias("b"), F.col("at.no").alias("no"))
    # the same shuffle at any size: how many lines are wanted grows with the corpus
    found = docs.join(need.hint("merge"), docs["doc_id"].eqNullSafe(need["a"]) & (docs["rid"] == need["b"]))
    return found.select("h", "g", F.get(F.split("text", "\n"), F.col("no")).alias("line")).dropDuplicates(["h", "g"])


def _pairs(rows: DataFrame) -> DataFrame:
    """Lines to be found with those that meet them, once each."""
    left = rows.where("role = 0").selectExpr("key", "h as h1", "g as g1", "at as at1")
    right = rows.selectExpr("key", "role", "h as h2", "g as g2", "at as at2")
    met = left.join(right, "key").where("role = 1 or h1 < h2 or (h1 = h2 and g1 < g2)")
    return met.select("h1", "g1", "at1", "h2", "g2", "at2").dropDuplicates(["h1", "g1", "h2", "g2"])


def _halve(rows: DataFrame) -> DataFrame:
    """Each row under either half of what isn't known to be equal: [lo, hi) of the line to be found, [lo, hi + 1) of a probing one."""
    mid = "cast((lo + hi) div 2 as int)"
    left = f"struct(xxhash64(key, 0, {mid}, substring(line, lo + 1, {mid} - lo)) as key, {mid} as lo, hi as hi)"
    right = f"struct(xxhash64(key, 1, {mid}, substring(line, {mid} + role + 1, hi - {mid})) as key, lo as lo, {mid} as hi)"
    return rows.selectExpr("role", "h", "g", "at", "line", f"explode(array({left}, {right})) as x").select("x.*", "role", "h", "g", "at", "line")


def _last(rows: DataFrame) -> DataFrame:
    """Lines of which an earlier one differs in the one place left: h, g."""
    sub = rows.where("role = 0").select(F.xxhash64(F.lit(0), "key").alias("key"), "h", "g", "at", F.lit(0).alias("role"))
    found = rows.where("role = 0").selectExpr("xxhash64(1, key, substring(line, lo + 1, 1)) as key", "h", "g", "at", "role")
    probes = rows.where("role = 1").selectExpr("explode(array_distinct(array(xxhash64(1, key, substring(line, lo + 1, 1)), xxhash64(1, key, substring(line, lo + 2, 1))))) as key", "h", "g", "at", "role")
    # all lines of a 'sub' bucket are linked
    first = sub.groupBy("key").agg(F.min("at").alias("first"))
    gone = sub.join(dealt(first), "key").where("at > first").select("h", "g")
    # in the others each probing line is linked with the one to be found
    ends = found.union(probes).groupBy("key").agg(F.min(F.when(F.col("role") == 0, F.col("at"))).alias("f"), F.min(F.when(F.col("role") == 1, F.col("at"))).alias("p"))
    both = found.union(probes).join(dealt(ends), "key").where("(role = 1 and f < at) or (role = 0 and p < at)").select("h", "g")
    return gone.union(both)


def later_near_lines(docs: DataFrame, least: int = 16, most: int = 64) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(distinct lines, those of them that are one edit from an earlier line: h, g; written tables that both read)"""
    lines = materialize(_lines(docs, least), "lines")
    keys = [(f"k{k}", int(k > 2), k % 2 == 1) for k in (1, 2, 3, 4)]
    # where the half isn't known to be equal: the second after an equal first one, and the other way round
    entry = [f"struct({k} as key, {role} as role, {f'cast((len - {role}) div 2 as int)' if first else '0'} as lo, {f'len - {role}' if first else f'cast((len - {role}) div 2 as int)'} as hi)" for k, role, first in keys]
    rows = lines.where(F.col("len") >= least).selectExpr("h", "g", "at", f"explode(array({', '.join(entry)})) as x").select("x.*", "h", "g", "at")
    sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("role").alias("r")).where("c > 1 and r = 0").select("key", "c")
    met = materialize(rows.join(dealt(sizes), "key"), "met")
    written = [lines, met]
    # what a round finds is written: else the plan of the result would grow with the rounds, and the driver's memory with it
    pairs, gone = [_pairs(met.where(F.col("c") <= most))], []
    large = met.where(F.col("c") > most).drop("c")
    if large.limit(1).count():
        large = materialize(large.join(dealt(_texts(docs, large)), ["h", "g"]), "large")
        written.append(large)
        while True:
            gone.append(materialize(_last(large.where("hi - lo <= 1")).distinct(), "ended"))
            halves = _halve(large.where("hi - lo > 1"))
            sizes = halves.groupBy("key").agg(F.count("*").alias("c"), F.min("role").alias("r")).where("c > 1 and r = 0").select("key", "c")
            halves = materialize(halves.join(dealt(sizes), "key"), "halves")
            pairs.append(materialize(_pairs(halves.where(F.col("c") <= most)), "round-pairs"))
            written += [halves, gone[-1], pairs[-1]]
            large = halves.where(F.col("c") > most).drop("c")
            if not large.limit(1).count():
                break
    pairs = materialize(reduce(DataFrame.union, pairs).dropDuplicates(["h1", "g1", "h2", "g2"]), "pairs")
    written.append(pairs)
    texts = materialize(_texts(docs, pairs.selectExpr("h1 as h", "g1 as g", "at1 as at").union(pairs.selectExpr("h2 as h", "g2 as g", "at2 as at"))), "line-texts")
    written.append(texts)
    both = pairs.join(dealt(texts.toDF("h1", "g1", "one")), ["h1", "g1"]).join(dealt(texts.toDF("h2", "g2", "two")), ["h2", "g2"])
    true = both.where(within_one(F.col("one"), F.col("two")))
    later = true.selectExpr("case when at1 < at2 then struct(h2 as h, g2 as g) else struct(h1 as h, g1 as g) end as x").select("x.*")
    return lines, reduce(DataFrame.union, [later, *gone]).distinct(), written


def dedup_lines(docs: DataFrame, least: int = 16, most: int = 64, carry: Column | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, rid, text, n_lines, n_removed: one row for each row of ``docs``.

    A line with a word stays unless an earlier line, of the same or another document, is equal, or one edit from it where both have
    ``least`` code points. Earlier is by doc_id (null first), then a hash of the row, then place. Lines without a word stay and aren't counted.
    Null texts stay null and have no lines. Rows with equal doc_id and text are one document; of other rows with one doc_id
    each is its own. ``rid`` tells them apart. ``carry``, if given, comes back as ``carried``;
    other columns are ignored, whatever their names.
    """
    whole = keyed(docs, carry)
    docs = whole.select("doc_id", "rid", "text")
    lines, near, written = later_near_lines(docs, least, most)
    stay = materialize(lines.select("h", "g", "at").join(dealt(near), ["h", "g"], "left_anti").groupBy(F.col("at.doc_id").alias("a"), F.col("at.rid").alias("b")).agg(F.collect_list("at.no").alias("nos")), "staying")
    release(*written)
    more = [] if carry is None else ["carried"]
    rows = whole.join(dealt(stay), whole["doc_id"].eqNullSafe(stay["a"]) & (whole["rid"] == stay["b"]), "left").select("doc_id", "rid", "text", *more, F.coalesce("nos", F.array().cast("array<int>")).alias("nos"), F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("blank", F.expr(rf"filter(sequence(0, size(lines) - 1), i -> not (get(lines, i) rlike '[^\\x20\\x09-\\x0D]'))"))
    kept = F.expr("array_join(transform(sort_array(concat(nos, blank)), i -> get(lines, i)), '\n')")
    n = F.coalesce(F.size("lines") - F.size("blank"), F.lit(0)).cast("long")
    return rows.select("doc_id", "rid", F.when(F.col("text").isNotNull(), kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("nos")).cast("long").alias("n_removed"), *more)
