"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dealt, materialize, release


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settled(state: DataFrame) -> bool:
    """Whether links are stars already, which no round changes: each larger end has one link, and is no other link's smaller end."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")
    return not loose.limit(1).count()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, component), the component being its smallest node. Nodes without links don't appear.

    Each round is two shuffles of the links on one end; nothing is collected but a count, and links that are stars already take no
    round. Self links and nulls are ignored, repeated links count once, an empty table gives an empty table.
    """
    links = links.where("u is not null and v is not null and u <> v")
    state = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(state):
            found = state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            found = materialize(found, "components")
            release(state)
            return found
        # large star: each larger neighbour of u is tied to u's smallest neighbour
        around = _both(state)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are tied to the smallest of them
        small = large.where("u <> v").distinct()
        lowest = small.groupBy("u").agg(F.min("v").alias("m"))
        tied = small.join(dealt(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        state, old = materialize(tied.where("u <> v").distinct(), "links"), state
        release(old)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
