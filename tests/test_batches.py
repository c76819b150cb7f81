"""Rows of Arrow batches are few at a time in Python."""

import json

import pyarrow as pa

from palimpsest.functions import batches
from palimpsest.operators import merge
from palimpsest.plans import queries
from palimpsest.sources import readers


def test_folds_end_batches_by_size(monkeypatch):
    monkeypatch.setattr(batches, "HELD", 5000)
    rows = [{"service": "s", "account": "a", "id": str(k), "have": None, "items": [{"seq": j, "export_index": j, "item": json.dumps({"conversation": {"id": str(k), "title": "t" * (1000 + j)}})} for j in range(3)]} for k in range(40)]
    out = list(merge._folds(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(out) >= 8 and max(b.num_rows for b in out) <= 5
    got = [r for b in out for r in b.to_pylist()]
    assert [r["id"] for r in got] == [str(k) for k in range(40)] and all(r["n_dumps"] == 3 and len(json.loads(r["item"])["conversation"]["title"]) == 1002 for r in got)


def test_parsed_items_end_batches_by_size(monkeypatch):
    monkeypatch.setattr(batches, "HELD", 5000)
    rows = [{"path": "p", "kind": "assistant", "key": "conversations", "place": k, "item": json.dumps({"conversation": {"id": str(k), "title": "t" * 900}, "responses": []})} for k in range(40)]
    out = list(readers._items(())(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(out) >= 7 and [r["place"] for b in out for r in b.to_pylist()] == list(range(40))


def test_session_logs_are_bounded(spark, monkeypatch):
    """More turns are more logs, not longer ones; the search finds the same."""
    at = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.search_scoped(spark, at).collect()))
    monkeypatch.setattr(queries, "LOG", 7)
    monkeypatch.setattr(queries, "_ROLES", ("assistant",))
    archives = queries._session_archives(spark, at)
    items = archives.spans("sessions", "assistant").groupBy("conversation_id").count()
    assert items.count() > 2 and items.where("count > 7").count() == 0
    assert sorted(map(tuple, queries.search_scoped(spark, at).collect())) == want
