"""A Merkle tree over rows: one root for a table in any order and partitioning, the parts that differ between two tables, and proofs for single rows.

A row's leaf is the digest of its columns; its place is given by the digest of its key, so equal tables have equal trees
whatever wrote them. Leaves with the same first ``depth`` hex digits are a block. A node's digest is that of its children's, in order,
with what it is; a level has a sixteenth of the nodes of the one below. All levels are groupings; the rows of a block
and the children of a node are all that meet in one place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of a block on average, at most; and the fixed values that tell leaves and nodes apart.
BLOCK = 1024
LEAF, NODE = "leaf", "node"


def _encoded(x: Column) -> Column:
    """Null and values of any content are told apart: the length stands before the value."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def depth_for(rows: int, block: int = BLOCK) -> int:
    depth = 0
    while rows > block * 16**depth:
        depth += 1
    return depth


def leaves(df: DataFrame, key: list[str], columns: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """place, leaf: a row for each row; equal rows have equal ones. Columns ``more`` are passed through."""
    place = F.sha2(F.concat(*map(_encoded, map(F.col, key))), 256)
    return df.select(place.alias("place"), F.sha2(F.concat(F.lit(LEAF), *map(_encoded, map(F.col, [*key, *columns]))), 256).alias("leaf"), *more)


def _node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit(NODE), F.array_join(children, "")), 256)


def nodes(rows: DataFrame, depth: int) -> DataFrame:
    """(place, leaf) -> prefix, n, digest: each level's nodes, from the blocks (prefixes of ``depth`` digits) up to the root (the empty prefix).

    An empty table has no nodes."""
    level = rows.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), _node(F.array_sort(F.collect_list(F.concat("place", "leaf")))).alias("digest"))
    out = level
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sum("n").alias("n"), _node(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(" "), x["digest"]))).alias("digest"))
        out = out.union(level)
    return out


def differing(have: DataFrame, want: DataFrame) -> DataFrame:
    """Blocks (the longest prefixes) whose digests differ between two node tables, or that only one has: prefix, have, want."""
    both = have.select("prefix", F.col("digest").alias("have")).join(want.select("prefix", F.col("digest").alias("want")), "prefix", "full")
    other = both.where(~F.col("have").eqNullSafe(F.col("want")))
    deepest = other.agg(F.max(F.length("prefix"))).first()[0]
    return other.where(F.length("prefix") == (deepest or 0))


def proof(rows: DataFrame, tree: DataFrame, depth: int, place: str) -> list[dict]:
    """What leads from a leaf to the root: of its block all leaves, then of each level the node's siblings, with their prefixes. Small: a block and sixteen nodes a level."""
    block = [r[0] for r in rows.where(F.substring("place", 1, depth) == place[:depth]).select(F.concat("place", "leaf").alias("x")).orderBy("x").collect()]
    steps: list[dict] = [{"prefix": place[:depth], "leaves": block}]
    for d in range(depth - 1, -1, -1):
        kids = tree.where((F.length("prefix") == d + 1) & F.col("prefix").startswith(place[:d])).orderBy("prefix").collect()
        steps.append({"prefix": place[:d], "children": [[r["prefix"], r["digest"]] for r in kids]})
    return steps


def proves(steps: list[dict], place: str, leaf: str, root: str) -> bool:
    """Whether a proof holds a leaf and leads to a root. Nothing of the table is needed."""

    def digest(parts: list[str]) -> str:
        return hashlib.sha256((NODE + "".join(parts)).encode()).hexdigest()

    if not steps or place + leaf not in steps[0]["leaves"]:
        return False
    now = digest(steps[0]["leaves"])
    for below, step in zip(steps, steps[1:], strict=False):
        if [below["prefix"], now] not in step["children"]:
            return False
        now = digest([f"{p} {d}" for p, d in step["children"]])
    return now == root
