"""Scalar functions of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes around a match in a snippet; names of the fields.
RADIUS = 56
FIELDS = {1: "title", 2: "summary", 3: "message"}


def field_name(field_id: Column) -> Column:
    out = F.lit("unknown")
    for k, name in FIELDS.items():
        out = F.when(field_id == k, name).otherwise(out)
    return out


def _inside(data: Column, at: Column) -> Column:
    """Whether a byte goes on with a character that began before it."""
    return F.coalesce(F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF"), F.lit(False))


def snippet(text: Column, pos: Column, size: Column, radius: int = RADIUS) -> Column:
    """``radius`` bytes around a match, widened to whole characters, dots where text is left out, on one line."""

    def of(x: Column) -> Column:
        data, p, n = x["data"], x["pos"], x["len"]
        total = F.octet_length(data)
        lo, hi = F.greatest(p - radius, F.lit(0)), F.least(p + n + radius, total)
        widen = lambda at, step: F.when(~_inside(data, at), at).when(~_inside(data, at + step), at + step).when(~_inside(data, at + 2 * step), at + 2 * step).otherwise(at + 3 * step)
        lo, hi = widen(lo, -1), widen(hi, 1)
        body = F.translate(F.decode(F.substring(data, (lo + 1).cast("int"), (hi - lo).cast("int")), "UTF-8"), "\n\r\t", "   ")
        return F.concat(F.when(lo > 0, "...").otherwise(""), body, F.when(hi < total, "...").otherwise(""))

    row = F.struct(F.encode(text, "UTF-8").alias("data"), pos.cast("int").alias("pos"), size.cast("int").alias("len"))
    return F.transform(F.array(row), of)[0]


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))


def content_digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def looks_like_uuid(x: Column) -> Column:
    return x.rlike(r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")


def richer_text(a: Column, b: Column) -> Column:
    """The longer one in bytes; the first on a tie; what there is if one is empty or null."""
    return F.when(F.coalesce(F.octet_length(b), F.lit(0)) > F.coalesce(F.octet_length(a), F.lit(0)), b).otherwise(F.nullif(a, F.lit("")))


def path_key(path: Column) -> Column:
    """Paths in the order of their parts."""
    return F.split(path, "/")
