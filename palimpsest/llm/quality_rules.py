"""Quality rules: a decision list learned by sequential covering from labelled statistics, run as Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

SPACE = r"[\x20\x09-\x0D]"
FEATURES = ("words_log", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "repeat_words_log")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated 3-word windows are found by sorting the windows' hashes, with each window's place in the low bits: equal
    neighbours are windows found twice, if their words are equal too. The places of all of them, sorted, give the words that they cover.
    """
    words = F.array_remove(F.split("text", SPACE + "+"), "")
    rows = docs.select("doc_id", "text", words.alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = rows.select(
        "doc_id",
        "w",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        lines.alias("lines"),
    ).withColumn("bits", F.ceil(F.log2(F.col("n") + 2.0)).cast("int"))
    window = F.expr("sort_array(transform(sequence(0, n - 3), i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), bits) | cast(i as bigint)))")
    base = base.withColumn("s", F.when(F.col("n") >= 4, window))
    # equal hashes first, then equal words; a window with another's hash may stand between two equal ones
    close = F.expr("filter(s, (x, i) -> coalesce(shiftright(x, bits) = shiftright(get(s, i - 1), bits), false) or coalesce(shiftright(x, bits) = shiftright(get(s, i + 1), bits), false))")
    base = base.withColumn("near", close).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    words = " and ".join(f"get(w, cast(x & mask as int) + {k}) = get(w, cast(y & mask as int) + {k})" for k in range(3))
    twice = F.expr(f"sort_array(transform(filter(near, (x, i) -> exists(array(get(near, i - 2), get(near, i - 1), get(near, i + 1), get(near, i + 2)), y -> coalesce(shiftright(x, bits) = shiftright(y, bits) and {words}, false))), x -> x & mask))")
    base = base.withColumn("p", twice)
    covered = F.expr("case when coalesce(size(p), 0) <= 0 then 0L else aggregate(transform(p, (x, i) -> least(3L, coalesce(get(p, i + 1), x + 3) - x)), 0L, (a, x) -> a + x) end")
    return base.select("doc_id", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """What thresholds are set on, from the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words_log": F.log1p(F.col("n_words").cast("double")),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "repeat_words_log": F.log1p(F.col("n_repeat_words").cast("double")),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        own = x[:, FEATURES.index(self.feature)]
        return own > self.limit if self.above else own <= self.limit

    def column(self) -> Column:
        own = features()[self.feature]
        return own > self.limit if self.above else own <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(lambda a, t: a & t.holds(x), rule, np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray, most_tests: int, cuts: int) -> Rule:
    """Adds the test with the most information gained, until no good row is covered or nothing is gained."""
    rule: Rule = ()
    while len(rule) < most_tests:
        inside = _covers(rule, x)
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            values = np.unique(np.quantile(x[inside, k], np.linspace(0, 1, cuts), method="inverted_cdf"))
            at = np.sort(x[inside & bad, k]), np.sort(x[inside & ~bad, k])
            below = [np.searchsorted(a, values, side="right") for a in at]
            for above in (True, False):
                p, n = (len(a) - b if above else b for a, b in zip(at, below, strict=True))
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1)
                j = int(g.argmax())
                if g[j] > gain:
                    best, gain = Test(name, above, float(values[j])), float(g[j])
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last tests while that doesn't lower (p - n) / (p + n) on rows that it wasn't grown on."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, cuts: int = 256) -> list[Rule]:
    """Rules for bad rows, in order. Each is grown on two thirds of what is left and pruned on the last third."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (bad & left).sum() >= 5:
        rule = _prune(_grow(x[left & ~third], bad[left & ~third], most_tests, cuts), x[left & third], bad[left & third])
        inside = _covers(rule, x) & left
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        held = _covers(rule, x) & left & third
        if not rule or p < 5 or p < precision * (p + n) or (bad & held).sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true is kept."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, (t.column() for t in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000) -> DataFrame:
    """(doc_id, text, ...), (doc_id, quality, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The list is learned from ``max_labelled`` labelled rows at most, first by a hash of their ids. Null texts have no words. Rows with
    one doc_id share a label; contradicting labels count as bad. Without labels the base rules decide alone. A row for each
    row of ``docs``; other columns are ignored, an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stats = materialize(statistics(docs), "statistics")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = stats.join(F.broadcast(known), "doc_id").where(~base).select("quality", *(c.alias(k) for k, c in features().items()), F.xxhash64("doc_id").alias("h")).orderBy("h", *FEATURES).limit(max_labelled).collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    rules = learn(x, np.array([r["quality"] == 0 for r in rows], bool))
    return stats.select("*", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))
