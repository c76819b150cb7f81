"""A Merkle manifest of a dataset, its nodes in files instead of memory.

1. Leaves (digests of rows) are sorted by range into runs; the runs' sizes give each leaf its place in its source's tree.
2. The node store is a folder of Parquet levels. A level is made by one sequential scan of the one below, in which each
   three neighbours are hashed as they come by. Neighbours that a split of the files keeps apart, a few for each split, are
   put together by a small grouping.
3. Proofs are merge scans by coordinate, a band of levels at a time from the top: the nodes of a band and the proof of
   the band's top come sorted by block (three to the power of the band's height), so a task holds one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, release, shared_dir

#: Nodes that are hashed together, and the levels of a band: a block has FAN ** BAND leaves at most.
FAN, BAND = 3, 5
_NODE = "tree long, pos long, n long, hash string"
_NODE_ARROW = [("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())]


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | str = "text") -> Column:
    """The digest of a row of documents."""
    return F.sha2(F.concat(*(encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), encoded(F.col(text) if isinstance(text, str) else text)), 256)


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``by``, as column ``at``; written, in sorted runs. Equal rows are told apart at will.

    The runs' sizes are all that is put together in one place: as many rows as there are partitions."""
    runs = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_in", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_in", 33)), name)
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    before = sizes.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return runs.join(F.broadcast(before), "_run").withColumn("at", F.col("_before") + F.col("_in").bitwiseAND(F.lit((1 << 33) - 1))).drop("_run", "_in", "_before")


# ---------------------------------------------------------------- levels


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A level in order -> the next one. Children whose siblings aren't all beside them come out as they are, with their slot."""
    schema = pa.schema([*_NODE_ARROW, ("slot", pa.int64())])
    held: list[tuple] = []

    def put(rows: list[tuple], out: list[tuple]) -> None:
        tree, pos, n, _ = rows[0]
        parent, above = pos // FAN, -(-n // FAN)
        if len(rows) == min(FAN, n - FAN * parent):
            out.append((tree, parent, above, sha256("".join(r[3] for r in rows).encode()).hexdigest(), None))
        else:
            out.extend((tree, parent, above, r[3], r[1] % FAN) for r in rows)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(5)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, pos = batch.column("tree").to_numpy(), batch.column("pos").to_numpy()
        group = pos // FAN
        # a run of neighbours: one tree, one parent, places that follow each other
        new = np.flatnonzero((tree[1:] != tree[:-1]) | (group[1:] != group[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        rows = list(zip(tree.tolist(), pos.tolist(), batch.column("n").to_pylist(), batch.column("hash").to_pylist(), strict=True))
        out: list[tuple] = []
        bounds = [0, *new.tolist(), len(rows)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = rows[a:b]
            if held and held[-1][0] == part[0][0] and held[-1][1] + 1 == part[0][1] and held[-1][1] // FAN == part[0][1] // FAN:
                part = held + part
            elif held:
                put(held, out)
            held = part
            if b < len(rows):
                put(held, out)
                held = []
        if out:
            yield table(out)
    if held:
        out = []
        put(held, out)
        yield table(out)


class Store:
    """The levels of a set of trees, one folder each."""

    def __init__(self, leaves: DataFrame, carry: tuple[str, ...] = ()):
        """``leaves``: tree, pos (from 0 without gaps), n (leaves of the tree), hash; ``carry``: more columns of theirs."""
        self.spark, self.carry = leaves.sparkSession, carry
        self.path = f"{shared_dir(self.spark)}/palimpsest/merkle-{uuid.uuid4().hex}"
        self.level_0 = materialize(leaves.select("tree", "pos", "n", "hash", *carry).sortWithinPartitions("tree", "pos"), "leaves")
        self.height, self.written = 0, [self.level_0]
        most = self.level_0.agg(F.max("n")).first()[0] or 1
        while most > 1:
            self._grow()
            most = -(-most // FAN)

    def level(self, k: int) -> DataFrame:
        return self.level_0 if k == 0 else self.levels[k - 1]

    @property
    def levels(self) -> list[DataFrame]:
        return self.written[1:]

    def _grow(self) -> None:
        """One sequential scan of the highest level; trees of one node are done."""
        below = self.level(self.height).where("n > 1").select("tree", "pos", "n", "hash")
        scanned = materialize(below.mapInArrow(_joined, _NODE + ", slot long"), "merkle-scan")
        apart = scanned.where("slot is not null").groupBy("tree", "pos", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "hash"))).alias("kids"))
        whole = apart.select("tree", "pos", "n", F.sha2(F.array_join("kids.hash", ""), 256).alias("hash"))
        self.written.append(materialize(scanned.where("slot is null").select("tree", "pos", "n", "hash").union(whole), f"merkle-level-{self.height + 1}"))
        release(scanned)
        self.height += 1

    def roots(self) -> DataFrame:
        """(tree, hash), one row for each tree."""
        out = self.level_0.where("n = 1").select("tree", "hash")
        for x in self.levels:
            out = out.union(x.where("n = 1").select("tree", "hash"))
        return out

    def proofs(self, above: DataFrame | None = None, fold: str | None = None) -> DataFrame:
        """(tree, pos, carried columns, hash, steps): for each leaf the siblings before and after it, level by level up to the
        root, and then the steps of its tree in ``above`` (tree, steps). With ``fold``, the name of a carried column of
        digests, not the steps but proof_sha256, the digest of all siblings, and folded_root, the root they lead to from it."""
        size = FAN**BAND
        top = self.level_0.select("tree").distinct().withColumn("steps", F.array().cast(_STEPS)) if above is None else above
        bands = list(range(0, max(1, self.height), BAND))
        upper = None
        for base in reversed(bands):
            rows = self._rows(base, size)
            small = self.level(base).where(f"n <= {size}").select("tree").distinct().join(top, "tree").select("tree", F.lit(0).cast("long").alias("block"), "steps")
            heads = small if upper is None else small.union(upper.select("tree", F.col("pos").alias("block"), "steps"))
            more = [F.lit(None).cast(self.level_0.schema[c].dataType).alias(c) for c in self.carry] if base == 0 else []
            rows = rows.union(heads.select("tree", "block", F.lit(BAND).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("hash"), "steps", *more))
            dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")
            carry = self.carry if base == 0 else ()
            kinds = "".join(f", {c} {self.level_0.schema[c].dataType.simpleString()}" for c in carry)
            what = "proof_sha256 string, folded_root string" if fold and not base else f"steps {_STEPS}"
            got = dealt.mapInArrow(_merge_scan(carry, None if base else fold), f"tree long, pos long, hash string, {what}{kinds}")
            if base:
                got = materialize(got, "merkle-proofs")
                self.written.append(got)
            upper = got
        return upper

    def _rows(self, base: int, size: int) -> DataFrame:
        out = None
        for j in range(min(BAND, self.height - base + 1)):
            wanted = self.level(base + j) if base == 0 and j == 0 else self.level(base + j).where("n > 1")
            more = [] if base else [F.col(c) if j == 0 else F.lit(None).cast(self.level_0.schema[c].dataType).alias(c) for c in self.carry]
            block = F.expr(f"pos div {size // FAN**j}")
            part = wanted.select("tree", block.alias("block"), F.lit(j).alias("level"), "pos", "n", "hash", F.lit(None).cast(_STEPS).alias("steps"), *more)
            out = part if out is None else out.union(part)
        return out

    def release(self) -> None:
        release(*self.written)


_STEPS = "array<struct<before:string,after:string>>"


def folded(steps: list[dict], start: str) -> str:
    for s in steps:
        start = sha256(f"{s['before']}{start}{s['after']}".encode()).hexdigest()
    return start


def _merge_scan(carry: tuple[str, ...], fold: str | None):
    """Rows by block, highest level first -> the leaves of the block with their steps, or with what these lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, steps, nodes, leaves, out = None, [], {}, [], []
        schema = None

        def close() -> None:
            """Leaves come last, so the block's other levels are all there."""
            for row in leaves:
                nodes.setdefault(0, {})[row["pos"]] = row["hash"]
            shared: dict[tuple[int, int], list] = {}

            def way(level: int, pos: int, n: int) -> list:
                if level == BAND or n == 1:
                    return steps
                if (level, pos) not in shared:
                    beside, first = nodes[level], pos // FAN * FAN
                    before = "".join(beside[q] for q in range(first, pos))
                    after = "".join(beside[q] for q in range(pos + 1, min(first + FAN, n)))
                    shared[level, pos] = [{"before": before, "after": after}, *way(level + 1, pos // FAN, -(-n // FAN))]
                return shared[level, pos]

            for row in leaves:
                found = way(0, row["pos"], row["n"])
                what = {"steps": found} if fold is None else {"proof_sha256": sha256("".join(s["before"] + s["after"] for s in found).encode()).hexdigest(), "folded_root": folded(found, row[fold])}
                out.append({"tree": row["tree"], "pos": row["pos"], "hash": row["hash"]} | what | {c: row[c] for c in carry})

        for batch in batches:
            if schema is None:
                kinds = {f.name: f.type for f in batch.schema}
                steps_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                what = [("steps", steps_type)] if fold is None else [("proof_sha256", pa.string()), ("folded_root", pa.string())]
                schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("hash", pa.string()), *what, *((c, kinds[c]) for c in carry)])
            for row in batch.to_pylist():
                if (row["tree"], row["block"]) != block:
                    close()
                    block, steps, nodes, leaves = (row["tree"], row["block"]), [], {}, []
                    if len(out) >= 2048:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if row["level"] == BAND:
                    steps = row["steps"]
                elif row["level"]:
                    nodes.setdefault(row["level"], {})[row["pos"]] = row["hash"]
                else:
                    leaves.append(row)
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# ---------------------------------------------------------------- the manifest


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """documents -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``.

    ``seen`` is the text that a verifier is shown (default: the row's own). Nulls in any column are `-`; null sources are
    a source of their own, before all others. Rows of a source come by doc_id (null first) and then by leaf, so equal
    rows are neighbours with equal leaves, and which of them has which place can't be told. Other columns are ignored,
    whatever their names; an empty table has no root and no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("n_chars").cast("long").alias("n_chars"))
    seen = F.col("text") if seen is None else seen
    rows = materialize(docs.select("doc_id", "source", leaf().alias("hash"), leaf(seen).alias("seen")), "digests")
    placed = materialize(numbered(rows, ["source", "doc_id", "hash"], "leaf-runs"), "placed")
    sources = placed.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = materialize(numbered(sources, ["source"], "sources").withColumnRenamed("at", "tree"), "trees")
    # a hot source is a hot key of this join: small tables of sources are broadcast by their measured size, else Spark splits it
    leaves = placed.withColumnRenamed("source", "_of").join(trees, F.col("_of").eqNullSafe(F.col("source"))).select("tree", (F.col("at") - F.col("first")).alias("pos"), "n", "hash", "doc_id", "seen")
    by_source = Store(leaves, ("doc_id", "seen"))
    subroots = materialize(by_source.roots(), "subroots")
    total = trees.count()
    across = Store(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(total).cast("long").alias("n"), "hash"))
    found = across.roots().first()
    root = F.lit(found["hash"] if found else None).cast("string")
    tops = materialize(across.proofs().select(F.col("pos").alias("tree"), "steps"), "tops")
    proofs = by_source.proofs(tops, fold="seen").join(subroots.select("tree", F.col("hash").alias("subroot")), "tree")
    out = materialize(proofs.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root"), "manifest")
    release(rows, placed, trees, subroots, tops)
    by_source.release()
    across.release()
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """The contract's tampering: where 2 divides the CRC-32 of the decimal doc_id, the text loses its line ends."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
