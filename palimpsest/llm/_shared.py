"""What several operators use: written intermediate tables and vectorised byte hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that outlive any executor.

    The shuffle files behind it go when it is written, the table itself when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """The other side of a join of tables that grow: both are dealt to tasks by the key.

    Spark goes by the size of a written table's compressed files, and would send many times that through the driver."""
    return df.hint("merge")


def keyed(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id, text, rid (tells rows with one doc_id apart), and ``carry``, if given, as ``carried``."""
    more = [] if carry is None else [carry.alias("carried")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).withColumn("rid", F.xxhash64("doc_id", "text"))


def release(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing will read again: what came from them has to be written already."""
    for df in tables:
        _remove(df.sparkSession, df._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already; the folder's owner clears it
        pass


# ---------------------------------------------------------------- polynomial hashes modulo 2**64

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base ('up') or of its inverse ('down')."""
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 4096), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] is the hash of the first i bytes; two stretches are compared through :func:`stretch_hashes`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", len(data)), out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the stretch stands."""
    return (prefix[ends] - prefix[starts]) * powers("down", len(prefix))[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased. Long texts go block by block."""
    whole = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + _BLOCK)
        while end < len(whole) and not _SPACE[whole[end]]:
            end += 1
        out.append(_word_hashes(_LOWER[whole[at:end]]))
        at = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.uint64)


def _word_hashes(block: np.ndarray) -> np.ndarray:
    edge = np.ones(len(block) + 2, np.int8)
    edge[1:-1] = _SPACE[block]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    return mix(stretch_hashes(prefix_hashes(block), starts, ends) + (ends - starts).astype(np.uint64))


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words count as one shingle; none without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    span = min(width, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        total += words[k : k + len(total)] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return np.unique(mix(total + np.uint64(span)))


def utf8(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
