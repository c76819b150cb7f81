"""Spans of merged conversations: titles, summaries and each text part of messages, all in Spark's own expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "archive string, conversation_id string, seq long, span_index long, record_kind int, field string, text string"
#: span_index is the conversation's place times this, plus the span's place in it.
STRIDE = 1 << 24
_SHAPE = "conversation struct<title variant, summary variant>, responses array<struct<response struct<message variant>>>"
_ROWS = "array<struct<record_kind: int, field: string, text: string>>"
#: How deep JSON may be nested, by Spark's reader.
DEEPEST = 1000


def message_parts(x: Any) -> Iterator[str]:
    """Texts of a message: a string, or the parts of an array; objects only if their type is text. Scalars give nothing."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, list):
        for part in x:
            yield from message_parts(part)
    elif isinstance(x, dict) and x.get("type") == "text" and isinstance(x.get("text"), str):
        yield x["text"]


def item_spans(item: dict) -> Iterator[tuple[int, str, str]]:
    """The spans of one item, plainly; ``spans`` gives the same for a table."""
    conv = item.get("conversation") or {}
    for name in ("title", "summary"):
        if isinstance(conv.get(name), str) and conv[name]:
            yield 1, name, conv[name]
    for r in item.get("responses") or []:
        for text in message_parts((r.get("response") or {}).get("message")):
            if text:
                yield 2, "message", text


def _string(x: Column) -> Column:
    """A variant's string; null if it is anything else."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _elements(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def flat_parts(message: Column) -> Column:
    """A message's parts, arrays in arrays laid out one level a step, until none is left; a message without any takes one step."""

    def nested(xs: Column) -> Column:
        return F.exists(xs, lambda x: _elements(x).isNotNull())

    def step(xs: Column) -> Column:
        return F.flatten(F.transform(xs, lambda x: F.coalesce(_elements(x), F.array(x))))

    steps = F.sequence(F.lit(1), F.when(nested(step(F.array(message))), DEEPEST).otherwise(1))
    return F.aggregate(steps, F.array(message), lambda xs, _: F.when(nested(xs), step(xs)).otherwise(xs))


def message_texts(message: Column) -> Column:
    """Variant -> texts of its parts, null for parts without."""
    text = lambda x: F.try_variant_get(x, "$.text", "variant")
    parts = F.transform(flat_parts(message), lambda x: F.coalesce(_string(x), F.when(F.try_variant_get(x, "$.type", "string") == "text", _string(text(x)))))
    return F.when(F.schema_of_variant(message) == "STRING", F.array(F.variant_get(message, "$", "string"))).otherwise(parts)


def spans(merged: DataFrame) -> DataFrame:
    """MERGED rows -> SPANS rows. Titles and messages are read as variants, so that values of any type in their places are told apart from
    strings; an item that can't be read is an error, not a loss. A conversation's spans are numbered in order."""
    whole = merged.select("service", "account", "seq", "id", F.from_json("item", _SHAPE, {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)}).alias("x"))
    conv = [F.struct(F.lit(1).alias("record_kind"), F.lit(n).alias("field"), _string(F.col(f"x.conversation.{n}")).alias("text")) for n in ("title", "summary")]
    own = F.transform("x.responses.response.message", lambda m: F.transform(message_texts(m), lambda t: F.struct(F.lit(2).alias("record_kind"), F.lit("message").alias("field"), t.alias("text"))))
    rows = F.filter(F.concat(F.array(*conv).cast(_ROWS), F.coalesce(F.flatten(own).cast(_ROWS), F.array().cast(_ROWS))), lambda s: s["text"] != "")
    out = whole.select("service", "account", "seq", "id", F.posexplode(rows).alias("k", "s"))
    return out.select(F.concat_ws("/", "service", "account").alias("archive"), F.col("id").alias("conversation_id"), "seq", (F.col("seq") * STRIDE + F.col("k")).alias("span_index"), "s.record_kind", "s.field", "s.text")
