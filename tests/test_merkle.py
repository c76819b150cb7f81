"""The tree over an archive: its root, the blocks that differ, proofs."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.archive import Archives
from palimpsest.errors import ArchiveError
from palimpsest.operators import merkle


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"k{k}" if k else None, f"value {k}" if k % 7 else None) for k in range(500)] + [("k1", "value 1"), ("a", "1:b"), ("a1", ":b")]
    return spark.createDataFrame(rows, "key string, value string")


def tree(df, depth=2):
    return {(r.prefix, r.n, r.digest) for r in merkle.nodes(merkle.leaves(df, ["key"], ["value"]), depth).collect()}


def test_roots_do_not_depend_on_order(table):
    one = tree(table)
    assert one == tree(table.orderBy(F.rand(3)).repartition(7)) and len({p for p, _, _ in one}) == len(one)
    assert {n for p, n, _ in one if p == ""} == {503}
    assert not tree(table.where("false")) and len(tree(table, 0)) == 1


@pytest.mark.parametrize("change", ["key <> 'k33' or key is null", "true"])
def test_differences_are_found_block_by_block(spark, table, change):
    other = table.where(change) if change != "true" else table.withColumn("value", F.when(F.col("key") == "k33", "other").otherwise(F.col("value")))
    a, b = (merkle.nodes(merkle.leaves(x, ["key"], ["value"]), 2) for x in (table, other))
    place = merkle.leaves(table.where("key = 'k33'"), ["key"], ["value"]).first()["place"]
    assert [r.prefix for r in merkle.differing(a, b).collect()] == [place[:2]]
    assert merkle.differing(a, a).count() == 0


@pytest.mark.parametrize("depth", [0, 2, 3])
def test_proofs(table, depth):
    rows = merkle.leaves(table, ["key"], ["value"])
    nodes = merkle.nodes(rows, depth)
    root = nodes.where("prefix = ''").first()["digest"]
    own = merkle.leaves(table.where("key = 'k40'"), ["key"], ["value"]).first()
    steps = merkle.proof(rows, nodes, depth, own["place"])
    assert merkle.proves(steps, own["place"], own["leaf"], root) and len(steps) == depth + 1
    assert not merkle.proves(steps, own["place"], own["leaf"][::-1], root) and not merkle.proves(steps, own["place"], own["leaf"], root[::-1])
    bent = json.loads(json.dumps(steps))
    if depth:
        bent[1]["children"][0][1] = "0" * 64
        assert not merkle.proves(bent, own["place"], own["leaf"], root)


def test_depths():
    assert [merkle.depth_for(n) for n in (0, 1024, 1025, 1024 * 16, 1024 * 16 + 1)] == [0, 0, 1, 1, 2]


def test_archives_tell_what_was_changed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(20):
        (tmp_path / "a" / f"n{k}.md").write_text(f"# Note {k}\ntext\n")
    a = Archives(spark, f"{tmp_path}/archives")
    at = a.ingest(str(tmp_path / "a"), service="notes", account="me", kind="markdown")["output"]
    assert a.verify("notes", "me") and a.differing("notes", "me").count() == 0
    place, leaf, steps, root = a.proof("notes", "me", "n7.md")
    assert merkle.proves(steps, place, leaf, root)
    with pytest.raises(ArchiveError):
        a.proof("notes", "me", "none.md")
    reader = a.spans("notes", "me")  # planned on the version that the next ingest takes the place of
    (tmp_path / "a" / "n3.md").write_text("# Note 3\nchanged\n")
    a.ingest(str(tmp_path / "a"), service="notes", account="me", kind="markdown")
    assert reader.count() == 40 and a.verify("notes", "me")
    folder = f"{at}/versions/{(tmp_path / 'archives' / 'service=notes' / 'account=me' / 'CURRENT').read_text().strip()}"
    spark.read.parquet(f"{folder}/conversations").withColumn("item", F.when(F.col("id") == "n9.md", "{}").otherwise(F.col("item"))).write.parquet(f"{tmp_path}/bent")
    bent = spark.read.parquet(f"{tmp_path}/bent")
    bent.write.mode("overwrite").parquet(f"{folder}/conversations")
    assert not a.verify("notes", "me") and a.differing("notes", "me").count() == 1


def test_an_ingest_that_was_overtaken_writes_nothing(spark, tmp_path):
    a = Archives(spark, f"{tmp_path}/archives")
    (tmp_path / "x.md").write_text("# x\ny\n")
    at = a.ingest(str(tmp_path / "x.md"), service="notes", account="me", kind="markdown")["output"]
    with pytest.raises(ArchiveError, match="another ingest"):
        a._switch(at, "new", None)
