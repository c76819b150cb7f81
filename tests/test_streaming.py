"""Dumps that come again, in any batching, as batches and as a stream with keyed state."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import merge
from palimpsest.streaming.ingest import read_keyed, start_keyed, upsert

SHORT, LONG, OTHER = "short", "a longer text", "what"


def dump(seq, export, conversation, *responses, **more):
    own = {"conversation": {"id": conversation, "title": f"t{export}"} | more, "responses": [{"response": {"_id": i, "message": m}} for i, m in responses]}
    return ("s", "a", seq, export, json.dumps(own))


#: A, B, A again; a shorter version after a longer one, twice; a newer dump before an older; conversations without an id.
DUMPS = [
    dump(0, 0, "x", ("1", SHORT)), dump(1, 1, "x", ("1", LONG)), dump(2, 0, "x", ("1", SHORT)), dump(3, 2, "y", ("1", LONG), modify_time="5"), dump(4, 3, "y", ("1", SHORT), modify_time="3"),
    dump(5, 3, "y", ("1", SHORT), modify_time="3"), dump(6, 1, None, ("1", OTHER)), dump(7, 1, None, ("1", OTHER)), dump(8, 4, "x", ("2", OTHER), ("1", SHORT)), dump(9, 5, "x", ("1", LONG)),
]


def plain(rows):
    return sorted((r.service, r.account, r.seq, r.id or "", tuple(r.export_indices), r.n_dumps, r.item) for r in rows)


def test_a_fold_cut_anywhere_is_the_fold():
    """All ways to cut the dumps of one conversation into batches."""
    own = [{"seq": d[2], "export_index": d[3], "item": d[4]} for d in DUMPS if json.loads(d[4])["conversation"]["id"] == "x"]
    whole = merge.fold(None, own)
    assert [r["response"]["message"] for r in json.loads(whole["item"])["responses"]] == [LONG, OTHER, SHORT]
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(own)), n) for n in range(len(own))):
        state, bounds = None, [0, *cuts, len(own)]
        for a, b in itertools.pairwise(bounds):
            state = merge.fold(state, own[a:b])
        assert state == whole


@pytest.mark.parametrize("cuts", [[10], [1, 2, 3, 10], [2, 7, 10]])
def test_upserts_equal_the_batch(spark, cuts):
    items = spark.createDataFrame(DUMPS, merge.ITEM)
    state, before = None, 0
    for cut in cuts:
        state = upsert(state, items.where(f"seq >= {before} and seq < {cut}"))
        before = cut
    assert plain(state.collect()) == plain(merge.merge_conversations(items).collect())


def test_keyed_state_equals_the_batch(spark, tmp_path):
    items = spark.createDataFrame(DUMPS, merge.ITEM)
    source, out, before = str(tmp_path / "in"), str(tmp_path / "out"), 0
    for cut in (2, 3, 7, 10):
        items.where(f"seq >= {before} and seq < {cut}").coalesce(1).write.mode("append").parquet(source)
        start_keyed(spark.readStream.schema(merge.ITEM).parquet(source), out, str(tmp_path / "check")).awaitTermination()
        before = cut
    assert plain(read_keyed(spark, out).collect()) == plain(merge.merge_conversations(items).collect())
    # a batch writes the conversations that it touches only
    touched = {r.batch: r.n for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(touched.values()) == [1, 1, 2, 2]
