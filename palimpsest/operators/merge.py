"""Overlapping dumps: identity, ordered merge, provenance.

An item is a JSON text {"conversation": {...}, "responses": [{"response": {...}, ...}], ...}. Items of one conversation are folded in the order
of ingest, since the result depends on it. A group is as large as a conversation has dumps.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batches_of, rows_of

ITEM = "service string, account string, seq long, export_index int, item string"
MERGED = "service string, account string, seq long, id string, export_indices array<int>, n_dumps int, item string"


def _atom_key(x: Any) -> str:
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, int):
        return ("i" if x < 1 << 63 else "u") + str(x)
    if isinstance(x, float):
        return f"f{x}"
    if isinstance(x, dict):
        return ",".join(f"{k}={_atom_key(v)}" for k, v in sorted(x.items()))
    return ",".join(map(_atom_key, x)) if isinstance(x, list) else str(x)


def time_key(x: Any) -> str | None:
    """What timestamps are compared by, as strings."""
    if x is None:
        return None
    if isinstance(x, str):
        return x
    return "bson:" + _atom_key(x["$date"]) if isinstance(x, dict) and "$date" in x else "other:" + _atom_key(x)


def modified(conversation: dict) -> str | None:
    return time_key(conversation.get("modify_time") if conversation.get("modify_time") is not None else conversation.get("create_time"))


def _size(x: Any) -> int:
    if x is None:
        return 0
    if isinstance(x, str):
        return len(x.encode())
    if isinstance(x, dict):
        return sum(len(k.encode()) + _size(v) for k, v in x.items())
    return sum(map(_size, x)) if isinstance(x, list) else 1


def _text(old: Any, new: Any, newer: bool) -> Any:
    if newer and new:
        return new
    return new if _size(new) > _size(old) else old


def _digest(x: Any) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def _merge_responses(have: list, more: list) -> list:
    """A new id is added; the same content completes the first of its id, a longer message takes its place, and a shorter one is kept beside it, once."""
    out = list(have)
    digests = [_digest(x) for x in out]
    there = Counter(digests)
    first: dict[Any, int] = {}
    for k, r in enumerate(out):
        if (i := (r.get("response") or {}).get("_id")) is not None:
            first.setdefault(i, k)

    def put(k: int, r: dict) -> None:
        d = _digest(r)
        if k < len(out):
            there[digests[k]] -= 1
            out[k], digests[k] = r, d
        else:
            out.append(r)
            digests.append(d)
        there[d] += 1

    for r in more:
        own = r.get("response") or {}
        k = first.get(own.get("_id")) if own.get("_id") is not None else None
        d = _digest(r)
        if k is None:
            if own.get("_id") is not None or not there[d]:
                first.setdefault(own.get("_id"), len(out))
                put(len(out), r)
        elif digests[k] == d or _digest(out[k].get("response")) == _digest(own):
            put(k, r | out[k])
        elif _size(own.get("message")) > _size((out[k].get("response") or {}).get("message")):
            put(k, out[k] | r)
        elif not there[d]:
            put(len(out), r)
    return out


def merge_items(have: dict, more: dict) -> dict:
    """One step of the fold: ``more`` was ingested later."""
    a, b = have.get("conversation") or {}, more.get("conversation") or {}
    one, two = modified(a), modified(b)
    newer = one is not None and two is not None and two > one
    conv = dict(a)
    for k, v in b.items():
        if k in ("title", "summary"):
            conv[k] = _text(conv.get(k), v, newer)
        elif v is not None and (conv.get(k) is None or newer):
            conv[k] = v
    rest = {k: v for k, v in have.items() if k not in ("conversation", "responses")}
    rest = ({k: v for k, v in more.items() if k not in ("conversation", "responses")} | rest) if not newer else rest | {k: v for k, v in more.items() if k not in ("conversation", "responses")}
    return {"conversation": conv, "responses": _merge_responses(have.get("responses") or [], more.get("responses") or []), **rest}


#: What a fold goes on from: a merged conversation, and the digests of the dumps that are in it.
STATE = MERGED + ", seen array<string>"
_KINDS = {"service": pa.string(), "account": pa.string(), "seq": pa.int64(), "id": pa.string(), "export_indices": pa.list_(pa.int32()), "n_dumps": pa.int32(), "item": pa.string(), "seen": pa.list_(pa.string())}


def fold(have: dict | None, dumps: list[dict]) -> dict:
    """A state (None: none yet) and further dumps (seq, export_index, item), in order -> the state after them. A dump that is the very
    same as one before, however long ago, only adds where it is from; so it is of no account how dumps are cut into batches."""
    item = json.loads(have["item"]) if have else None
    seen, indices = set(have["seen"]) if have else set(), list(have["export_indices"]) if have else []
    for x in dumps:
        if x["export_index"] not in indices:
            indices.append(x["export_index"])
        own = json.loads(x["item"])
        d = _digest(own)
        if item is None:
            item = own
        elif d not in seen:
            item = merge_items(item, own)
        seen.add(d)
    return {"seq": have["seq"] if have else dumps[0]["seq"], "export_indices": indices, "n_dumps": (have["n_dumps"] if have else 0) + len(dumps), "item": json.dumps(item, ensure_ascii=False), "seen": sorted(seen)}


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ({"service": r["service"], "account": r["account"], "id": r["id"]} | fold(r["have"], r["items"]) for batch in batches for r in rows_of(batch))
    yield from batches_of(own, pa.schema(list(_KINDS.items())))


def _grouped(items: DataFrame) -> DataFrame:
    own = F.get_json_object("item", "$.conversation.id")
    keyed = items.withColumn("id", own).withColumn("_alone", F.when(own.isNull(), F.col("seq")))
    return keyed.groupBy("service", "account", "id", "_alone").agg(F.array_sort(F.collect_list(F.struct("seq", "export_index", "item"))).alias("items"))


_HAVE = "struct<seq: bigint, export_indices: array<int>, n_dumps: int, item: string, seen: array<string>>"


def merge_states(items: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """ITEM rows (and the STATE of their conversations so far) -> STATE rows of the conversations in ``items``. Conversations without an id are merged with nothing."""
    grouped = _grouped(items)
    if state is None:
        rows = grouped.withColumn("have", F.lit(None).cast(_HAVE))
    else:
        have = state.where("id is not null").select("service", "account", "id", F.struct("seq", "export_indices", "n_dumps", "item", "seen").alias("have"))
        rows = grouped.join(have, ["service", "account", "id"], "left")
    return rows.select("service", "account", "id", "items", "have").mapInArrow(_folds, STATE)


def merge_conversations(items: DataFrame) -> DataFrame:
    """ITEM rows -> MERGED rows. Conversations without an id are merged with nothing."""
    return merge_states(items).drop("seen")


def merge_assets(assets: DataFrame) -> DataFrame:
    """(digest, uuid, relative_path, size, mtime, export_index, seq) -> one row for each digest: the first one's names, all places."""
    # a content may be at very many places of one export: these are one row before they are listed
    own = assets.groupBy("digest", "export_index").agg(F.min(F.struct("seq", "uuid", "relative_path", "size", "mtime")).alias("f"))
    out = own.groupBy("digest").agg(F.min("f").alias("f"), F.array_sort(F.collect_list(F.struct("f.seq", "export_index"))).alias("p"))
    return out.select("digest", "f.uuid", "f.relative_path", "f.size", "f.mtime", F.col("p.export_index").alias("export_indices"))
