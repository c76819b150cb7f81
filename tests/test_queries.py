"""Each query against its SQL in DuckDB."""

import datetime
import random
import sys

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: x.isoformat() if isinstance(x, datetime.datetime) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    found, expected = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), columns)
    assert found == expected and (expected or name == "snippet_groups")


def test_snippets_of_any_text(spark, tmp_path):
    """Characters of one to four bytes around the match, against brute force over bytes and against the SQL."""
    r = random.Random(9)
    say = lambda n: "".join(r.choice("ab é€\U0001f600\n\tß") for _ in range(n))
    texts = [say(r.choice((0, 3, 30, 56, 90))) + "thing" + say(r.choice((0, 3, 30, 56, 90))) for _ in range(200)] + ["thing", "no match é", "x" * 56 + "thing" + "y" * 56, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        data = text.encode()
        lo, hi = data.index(b"thing") - 56, data.index(b"thing") + 61
        lo, hi = max(lo, 0), min(hi, len(data))
        while lo > 0 and data[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        return "..." * (lo > 0) + data[lo:hi].decode().translate(dict.fromkeys(map(ord, "\n\r\t"), " ")) + "..." * (hi < len(data))

    want = {i: brute(t) for i, t in enumerate(texts) if t and "thing" in t}
    assert {x.doc_id: x.snippet for x in QUERIES["snippets_any_text"](spark, str(tmp_path)).collect()} == want
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(db.execute(ORACLE_SQL["snippets_any_text"]).fetchall()) == want


def test_entry(spark):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
