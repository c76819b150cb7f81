"""Packing: length buckets with the least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths, with the least padding in all.

    Dynamic programming over the last length of each bucket. With R and T, the rows and tokens up to a length, the padding of
    a bucket from after j to i is length(i) * (R(i) - R(j)) - (T(i) - T(j)): for each i the lowest of lines in length(i), one for
    each j, whose slopes -R(j) fall as j grows. So each layer keeps the lines' lower hull and walks it once: O(buckets * lengths),
    in whole numbers.
    """
    length, n = [int(x) for x in lengths], len(lengths)
    rows, tokens = [0], [0]
    for size, c in zip(length, counts, strict=True):
        rows.append(rows[-1] + int(c))
        tokens.append(tokens[-1] + size * int(c))
    best = [x * r - t for x, r, t in zip(length, rows[1:], tokens[1:], strict=True)]
    back: list[list[int]] = []
    for _ in range(min(buckets, n) - 1):
        new, arg = best.copy(), [-1] * n
        hull: list[tuple[int, int, int]] = []  # slope, height, j
        at = 0
        for i in range(n):
            # the line of j = i - 1, the last length of the bucket before
            if i:
                k, m = -rows[i], best[i - 1] + tokens[i]
                while len(hull) > 1 and (m - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - k):
                    hull.pop()
                hull.append((k, m, i - 1))
                at = min(at, len(hull) - 1)
                x = length[i]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                cost = x * rows[i + 1] - tokens[i + 1] + hull[at][0] * x + hull[at][1]
                if cost < new[i]:
                    new[i], arg[i] = cost, hull[at][2]
        best = new
        back.append(arg)
    # walk back, layer by layer
    bounds, i, k = [], n - 1, len(back) - 1
    while True:
        while k >= 0 and back[k][i] < 0:
            k -= 1
        bounds.append(length[i])
        if k < 0:
            break
        i, k = back[k][i], k - 1
    return sorted(bounds)


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, length=None, group: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, bucket_len, batch_size, batch_id, slot: a row for each row of ``docs``.

    ``length``: a column with the token count; words between white space if none is given. Null texts have no tokens
    and go to the first bucket. A batch holds ``token_budget // bucket_len`` rows of one bucket, one at least, each
    padded to ``bucket_len``; all batches of a bucket are full but the last. Bucket bounds come from the exact
    histogram of all rows, which the driver holds: it has no more lengths than the square root of twice the tokens. Rows are dealt to batches in the order of a hash, in
    groups of about ``group`` rows whose sizes are counted first, so a bucket may hold any share of the rows. Ties
    and repeated rows are rows like others; an empty table gives an empty table. Lengths are counted once and written,
    so the texts are read a single time.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) if length is None else F.coalesce(length, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("h"), *keep)
    rows = materialize(rows, "lengths")
    bins = rows.groupBy(F.col("n_tokens").alias("longest")).agg(F.count("*").alias("c")).orderBy("longest").collect()
    if not bins:
        empty = rows.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch_size"), F.lit("").alias("batch_id"), F.lit(0).cast("long").alias("slot"), *keep)
        return empty
    bounds = best_bounds(*(np.array([b[k] for b in bins], np.int64) for k in ("longest", "c")), buckets)
    sizes = {bound: max(1, token_budget // max(1, bound)) for bound in bounds}
    counts, below = {}, -1
    for bound in bounds:
        counts[bound] = sum(b["c"] for b in bins if below < b["longest"] <= bound)
        below = bound

    def by_bound(values: dict[int, int]):
        out = F.lit(values[bounds[-1]]).cast("long")
        for bound in reversed(bounds[:-1]):
            out = F.when(F.col("n_tokens") <= bound, F.lit(values[bound]).cast("long")).otherwise(out)
        return out

    rows = rows.withColumn("bucket_len", by_bound({b: b for b in bounds})).withColumn("batch_size", by_bound(sizes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h"), by_bound({b: -(-counts[b] // group) for b in bounds})).cast("long"))
    own = rows.groupBy("bucket_len", "part").agg(F.count("*").alias("c"))
    # a row for each group: a window over them is small, and by bucket
    starts = own.selectExpr("bucket_len", "part", "coalesce(sum(c) over (partition by bucket_len order by part rows between unbounded preceding and 1 preceding), 0) as start")
    placed = rows.selectExpr("*", "row_number() over (partition by bucket_len, part order by h, doc_id) - 1 as r").join(starts, ["bucket_len", "part"])
    at = F.col("start") + F.col("r")
    batch = F.floor(at / F.col("batch_size")).cast("long")
    return placed.select("doc_id", "n_tokens", "bucket_len", "batch_size", F.concat_ws("-", "bucket_len", batch).alias("batch_id"), (at - batch * F.col("batch_size")).cast("long").alias("slot"), *keep)
