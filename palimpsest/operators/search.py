"""Search over spans: filter, first match, snippet, unique hits, groups by text, cap.

A span is a row (archive, conversation_id, span_index, field, text). Nothing but hits is shuffled; texts are dealt by a hash of theirs and
compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_key, snippet
from ..plans.query import Query, check_java, first_match, match_count, matches

#: Fixed value: groups that a report shows if nothing else is said; 0 is all.
MAX_COUNT = 100


def hits(spans: DataFrame, q: Query) -> DataFrame:
    """One row for each span with a match, at its first one: archive, conversation_id, span_index, field, text, pos, len, snippet."""
    check_java(spans.sparkSession, q)
    found = spans.where((F.col("text") != "") & matches(F.col("text"), q)).withColumn("m", first_match(F.col("text"), q)).where("m is not null and m.pos + m.len <= octet_length(text) and m.pos < octet_length(text)")
    return found.select("archive", "conversation_id", "span_index", "field", "text", F.col("m.pos").alias("pos"), F.col("m.len").alias("len"), snippet(F.col("text"), F.col("m.pos"), F.col("m.len")).alias("snippet"))


def unique_hits(found: DataFrame) -> DataFrame:
    """The first hit of each (archive, conversation, field, text); null conversations are equal."""
    first = found.groupBy("archive", "conversation_id", "field", "text").agg(F.min(F.struct("span_index", "pos", "len", "snippet")).alias("h"))
    return first.select("archive", "conversation_id", "field", "text", "h.*")


def in_order(unique: DataFrame) -> DataFrame:
    """Adds ord: archives by the parts of their paths, then conversations by their first hit, then spans."""
    ranks = unique.groupBy("archive", "conversation_id").agg(F.min("span_index").alias("rank"))
    joined = unique.alias("u").join(ranks.alias("r"), F.expr("u.archive <=> r.archive and u.conversation_id <=> r.conversation_id"))
    return joined.select("u.*", F.struct(path_key(F.col("u.archive")).alias("path"), F.col("rank"), F.col("span_index").alias("span")).alias("ord"))


def keys(found: DataFrame) -> DataFrame:
    """archive, conversation_id, field, digest, span_index: the first hit of each (archive, conversation, field, text), without the text."""
    own = found.select("archive", "conversation_id", "field", F.sha2("text", 256).alias("digest"), "span_index")
    return own.groupBy("archive", "conversation_id", "field", "digest").agg(F.min("span_index").alias("span_index"))


def first_groups(ordered: DataFrame, max_count: int) -> DataFrame:
    """digest, ord, archive, span_index of the first ``max_count`` groups (0: all), each at its first hit. Only order keys and digests are sorted."""
    by = ordered.groupBy("digest").agg(F.min(F.struct("ord", "archive", "span_index")).alias("f")).select("digest", "f.*")
    return by.orderBy("ord").limit(max_count) if max_count else by


def _shown(spans: DataFrame, q: Query, max_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places of the groups that are shown; these groups; their texts and snippets, taken from their first hits only)"""
    ordered = in_order(keys(hits(spans, q)))
    first = first_groups(ordered, max_count)
    few = F.broadcast(first) if 0 < max_count <= FEW else first
    places = ordered.join(few.select("digest"), "digest", "left_semi").select("digest", "ord", "archive", "conversation_id", "field") if max_count else ordered.select("digest", "ord", "archive", "conversation_id", "field")
    own = spans.join(few.select("archive", "span_index"), ["archive", "span_index"], "left_semi").select(*spans.columns)
    texts = hits(own, q).select(F.sha2("text", 256).alias("digest"), "text", "snippet", "field", "archive", "span_index")
    return places, few, texts


#: Groups up to which a cap is small enough for them to be sent to all tasks.
FEW = 10_000


def report(spans: DataFrame, q: Query, max_count: int = MAX_COUNT) -> DataFrame:
    """snippet, field, occurrences, ord, text: a row for each text, over all archives, with snippet and field of its first hit.

    The first ``max_count`` groups, in order; 0 is all. Groups are told apart by digests and capped before texts, snippets and
    occurrences are fetched, and these of the shown groups only. Each occurrence list is one value here; ``report_segments`` cuts them.
    """
    places, first, texts = _shown(spans, q, max_count)
    lists = places.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("ord", "archive", "conversation_id", "field"))).alias("o"))
    out = first.join(texts, ["digest", "archive", "span_index"]).join(lists, "digest")
    return out.select("snippet", "field", F.transform("o", lambda x: F.struct(x["archive"].alias("archive"), x["conversation_id"].alias("conversation_id"), x["field"].alias("field"))).alias("occurrences"), "ord", "text").orderBy("ord")


def report_segments(spans: DataFrame, q: Query, max_count: int = MAX_COUNT, size: int = 1000) -> DataFrame:
    """As ``report``, with each list in rows of ``size`` occurrences at most, numbered by ``segment``; snippet, field and text are on the first."""
    places, first, texts = _shown(spans, q, max_count)
    numbered = places.withColumn("segment", F.expr(f"(row_number() over (partition by digest order by ord) - 1) div {size}"))
    lists = numbered.groupBy("digest", "segment").agg(F.array_sort(F.collect_list(F.struct("ord", "archive", "conversation_id", "field"))).alias("o"))
    named = first.join(texts, ["digest", "archive", "span_index"]).select("digest", F.lit(0).cast("long").alias("segment"), "snippet", "field", "text")
    out = lists.join(first.select("digest", F.col("ord").alias("first")), "digest").join(named, ["digest", "segment"], "left")
    return out.select("snippet", "field", F.transform("o", lambda x: F.struct(x["archive"].alias("archive"), x["conversation_id"].alias("conversation_id"), x["field"].alias("field"))).alias("occurrences"), F.col("first").alias("ord"), "segment", "text").orderBy("ord", "segment")


def group_count(spans: DataFrame, q: Query) -> int:
    """How many groups there are in all: different digests of texts, without their order, texts or occurrences."""
    return hits(spans, q).select(F.sha2("text", 256).alias("digest")).distinct().count()


def duplicate_omitted(spans: DataFrame, q: Query) -> DataFrame:
    """archive, matches, hits, duplicate_omitted: matches that aren't shown as hits, for queries of one term an alternative."""
    check_java(spans.sparkSession, q)
    found = spans.where((F.col("text") != "") & matches(F.col("text"), q)).withColumn("n", match_count(F.col("text"), q))
    counts = found.groupBy("archive", "conversation_id", "field", "text").agg(F.sum("n").alias("n")).groupBy("archive").agg(F.sum("n").alias("matches"), F.count("*").alias("hits"))
    return counts.select("archive", "matches", "hits", (F.col("matches") - F.col("hits")).alias("duplicate_omitted"))


def suppressed_clause(not_shown: int, omitted: int) -> str:
    """What a report says of what it leaves out."""
    parts = [f"{not_shown} group{'' if not_shown == 1 else 's'} not shown"] if not_shown else []
    parts += [f"{omitted} duplicates omitted"] if omitted else []
    return ", ".join(parts)
