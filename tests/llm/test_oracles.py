"""The queries with SQL against it, on tables and on rows with ties, copies, edits, nulls and long texts."""

import duckdb
import pytest
from conftest import SF

from palimpsest.llm.oracles import ORACLE_SQL
from palimpsest.llm.queries import QUERIES


def same(spark, folder, name, tables, pattern=""):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet{pattern}'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    expected = sorted(map(repr, want.fetchall()))
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    found = got.select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected and expected
    return found


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_tables(spark, name):
    same(spark, SF, name, ["conversations" if name == "op6_chat_format" else "documents"])


@pytest.mark.parametrize("name", ["op7_line_dedup", "op9_minhash"])
def test_made_documents(spark, corpus, name, tmp_path):
    base = "the quick brown fox jumps over it é"
    rows = {i: t for i, t in corpus if i is not None}
    rows |= {2000 + k: base[:k] + "#" + base[k:] + "\n\n" + base[k:] for k in range(0, 30, 3)} | {3000: base * 300, 3001: base * 300 + "!", 3002: "a b c d", 3003: "A B\tC\n\nD"}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = same(spark, str(tmp_path), name, ["documents"], "/*.parquet")
    assert any(r.n_removed for r in found) if name == "op7_line_dedup" else any(not r.kept for r in found)


def test_made_conversations(spark, tmp_path):
    """Snapshots of growing conversations, equal ones, ties of places, nulls, marks in texts, and one over two segments."""
    long = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|>") for k in range(600)]
    rows = [(c, *t) for c, n in ((1, 600), (2, 3), (3, 300), (4, 599), (5, 600)) for t in long[:n]]
    rows += [(6, 0, None, None), (7, 0, "user", None), (8, 0, None, ""), (9, 0, None, None), (9, 1, "user", "é"), (10, None, "user", "x"), (10, None, "user", "x"), (10, 0, None, "y"), (11, None, "user", "x"), (None, 0, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = same(spark, str(tmp_path), "op6_chat_format", ["conversations"], "/*.parquet")
    assert {r.conv_id for r in found} == {1, 7, 8, 9, 10} and max(r.segment for r in found) == 2
