"""Message trees as rows: the way from the root to the current message, in as many rounds as the length of the way has binary digits.

A node's link to its parent is a jump of one step. In each round every node that is known to be on the way marks the node
that its jump leads to, and jumps are joined with themselves, so they double. A way that runs into a cycle has each node of it
once, as a walk that stops at the first node seen again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def starts(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(tree, key, parent) and (tree, key) -> (tree, key): where each tree's way begins: at its current node; without one that exists, at the greatest leaf; without a leaf, at the greatest node."""
    given = current.select("tree", "key").join(nodes.select("tree", "key"), ["tree", "key"], "left_semi").distinct()
    parents = nodes.select("tree", F.col("parent").alias("key"), F.lit(True).alias("inner")).where("key is not null").distinct()
    greatest = nodes.join(parents, ["tree", "key"], "left").groupBy("tree").agg(F.max(F.when(F.col("inner").isNull(), F.col("key"))).alias("leaf"), F.max("key").alias("any"))
    rest = greatest.join(given.select("tree").distinct(), "tree", "left_anti").select("tree", F.coalesce("leaf", "any").alias("key"))
    return given.groupBy("tree").agg(F.max("key").alias("key")).union(rest)


def ways(nodes: DataFrame, current: DataFrame, folder: str, max_rounds: int = 64) -> DataFrame:
    """(tree, key, parent) and (tree, key) -> (tree, key, dist): the nodes on each tree's way, with their distance from its
    beginning. ``folder`` takes each round's tables; the result reads the last."""
    spark = nodes.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    nodes = nodes.select("tree", "key", "parent").where("key is not null").dropDuplicates(["tree", "key"])
    real = nodes.select("tree", F.col("key").alias("to"))
    jumps = written(nodes.where("parent is not null").select("tree", "key", F.col("parent").alias("to")).join(real, ["tree", "to"], "left_semi").select("tree", "key", "to"), "jumps-0")
    marks = written(starts(nodes, current).select("tree", "key", F.lit(0).cast("long").alias("dist")), "marks-0")
    n = marks.count()
    for k in range(max_rounds):
        on = marks.join(jumps, ["tree", "key"]).select("tree", F.col("to").alias("key"), (F.col("dist") + (1 << k)).alias("dist"))
        marks = written(marks.union(on).groupBy("tree", "key").agg(F.min("dist").alias("dist")), f"marks-{k + 1}")
        more = marks.count()
        if more == n:
            return marks
        n = more
        on = jumps.select("tree", F.col("key").alias("first"), F.col("to").alias("key"))
        jumps = written(on.join(jumps, ["tree", "key"]).select("tree", F.col("first").alias("key"), "to"), f"jumps-{k + 1}")
    raise RuntimeError(f"ways longer than 2 ** {max_rounds}")


def message_order(nodes: DataFrame, current: DataFrame, folder: str) -> DataFrame:
    """(tree, key, parent) and (tree, key) -> (tree, key, place): each tree's nodes in the order in which its messages are read: from the
    root to the current one, then those not on the way, by key. Places count from 0.

    Trees without a node have no rows; a parent that doesn't exist is none; of nodes with one key the tree has one; a
    null key is no node. The order inside a tree is a window over its rows (keys only).
    """
    way = ways(nodes, current, folder)
    rows = nodes.select("tree", "key").where("key is not null").distinct().join(way, ["tree", "key"], "left")
    order = Window.partitionBy("tree").orderBy(F.col("dist").desc_nulls_last(), "key")
    return rows.select("tree", "key", (F.row_number().over(order) - 1).cast("long").alias("place"))
