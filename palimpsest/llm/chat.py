"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones, which are rendered.

A snapshot's turns are a prefix of a later one's. Each turn has a hash of its place, role and text; the running XOR of
two such hashes is the hash of the prefix that ends there. The whole hashes of conversations that appear among the
inner prefixes of others go in an anti-join. Places and running hashes come from two levels of windows (blocks of
turns, then the blocks' sums), so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

# The marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"


def _ranked(turns: DataFrame, block: int) -> DataFrame:
    """Adds n (place in the conversation, from 1), blk, and the running prefix hashes p and q."""
    turns = turns.withColumn("blk", F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))))
    inner = turns.selectExpr("*", "row_number() over (partition by conv_id, blk order by turn, role, text) as r")
    sums = inner.groupBy("conv_id", "blk").agg(F.count("*").alias("c"))
    before = sums.selectExpr("conv_id", "blk", "coalesce(sum(c) over (partition by conv_id order by blk rows between unbounded preceding and 1 preceding), 0) as off")
    placed = inner.join(before, ["conv_id", "blk"]).withColumn("n", F.col("off") + F.col("r")).drop("off", "r")
    placed = placed.withColumn("a", F.xxhash64("n", F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00")))).withColumn("b", F.xxhash64(F.sha2(F.concat_ws("\x1f", "n", F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))), 256)))
    inner = placed.selectExpr("*", *(f"bit_xor({x}) over (partition by conv_id, blk order by n rows unbounded preceding) as r{x}" for x in "ab"))
    sums = placed.groupBy("conv_id", "blk").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    before = sums.selectExpr("conv_id", "blk", *(f"coalesce(bit_xor(x{x}) over (partition by conv_id order by blk rows between unbounded preceding and 1 preceding), 0L) as o{x}" for x in "ab"))
    return inner.join(before, ["conv_id", "blk"]).select("conv_id", "turn", "role", "text", "n", F.expr("ra ^ oa").alias("p"), F.expr("rb ^ ob").alias("q"))


def maximal_conversations(ranked: DataFrame) -> DataFrame:
    """(conv_id, n, p, q) -> conv_id, n_turns of the conversations that stay; see :func:`format_chats`."""
    ends = ranked.groupBy("conv_id").agg(F.max("n").alias("n"))
    whole = ranked.join(ends, ["conv_id", "n"]).groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"))
    inner = ranked.join(ends.withColumnRenamed("n", "last"), "conv_id").where("n < last").select("n", "p", "q").distinct()
    return whole.join(inner, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def format_chats(turns: DataFrame, block: int = 1024, segment: int = 256) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, segment, n_turns, rendered: the maximal conversations, rendered.

    A conversation goes when its turns are a prefix of a longer one's; of equal ones the smallest conv_id stays. Turns
    are taken in the order of turn, then role and text (nulls first); repeated rows are turns. A null role is 'user', a null text
    empty in what is rendered, and both differ from those when prefixes are compared. Marks inside a text are broken
    by a space, so that it can't end its turn. ``segment`` turns make one row; a conversation's text is its rows' text in order. Rows
    without a conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    # read four times, so places and hashes are worked out once and written
    ranked = materialize(_ranked(turns, block).drop("turn"), "ranked-turns")
    stay = maximal_conversations(ranked)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("user")), F.lit("\n"), body, F.lit(END + "\n"))
    rows = ranked.join(stay, "conv_id").select("conv_id", F.floor((F.col("n") - 1) / segment).cast("long").alias("segment"), "n", line.alias("line"))
    out = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return out.select("conv_id", "segment", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))
