"""Asset bodies: stored once each, in parts, read back bit by bit."""

import hashlib
import os
import random

import pytest

from palimpsest.archive import Archives
from palimpsest.errors import ArchiveError
from palimpsest.operators.merge import merge_assets
from palimpsest.sources import assets
from palimpsest.sources.readers import skipped


def digest(body, size, fan):
    """The tree's digest, level by level."""
    level = [hashlib.sha256(body[k : k + size]).hexdigest() for k in range(0, max(len(body), 1), size)]
    while len(level) > 1:
        runs = [level[k : k + fan] for k in range(0, len(level), fan)]
        level = [r[0] if len(r) == 1 else "tree-" + hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return level[0]


def listed(spark, folder, export=0):
    return assets.listing(spark, str(folder)).selectExpr("*", f"{export} as export_index", f"cast({export} as long) as seq")


def test_bodies_in_trees(spark, tmp_path):
    """Empty, one-part and many-part bodies, copies under many names, odd names, images; both ways of reading; restored bit by bit."""
    r = random.Random(3)
    bodies = {f"u{k}": r.randbytes(n) for k, n in enumerate((0, 1, 99, 100, 101, 200, 900, 901, 1000, 8100, 8101, 12345))} | {f"copy {k}": b"same" * 60 for k in range(40)}
    for name, body in bodies.items():
        (tmp_path / "in" / "assets" / name).mkdir(parents=True)
        (tmp_path / "in" / "assets" / name / "content").write_bytes(body)
    (tmp_path / "in" / "photo \u00e9.JPG").write_bytes(bodies["u6"])
    (tmp_path / "in" / "notes.md").write_bytes(b"# no asset")
    (tmp_path / "in" / "node_modules").mkdir()
    (tmp_path / "in" / "node_modules" / "x.png").write_bytes(b"skipped")
    for through in ((), (str(tmp_path / "in"),)):
        work = tmp_path / f"work{len(through)}"
        rows, parts = assets.catalog(listed(spark, tmp_path / "in").where("size > 0" if through else "true"), str(work), size=100, fan=9, through=through)
        got = {x.relative_path: (x.digest, x.uuid, x.size) for x in rows.collect()}
        if through:  # Spark's reader has no row for an empty file
            bodies.pop("u0")
        want = {f"assets/{n}/content": (digest(b, 100, 9), n, len(b)) for n, b in bodies.items()}
        assert got == want | {"photo \u00e9.JPG": (digest(bodies["u6"], 100, 9),) * 2 + (900,)}
        stored = parts.collect()
        assert len({(x.digest, x.part) for x in stored}) == len(stored) == sum(max(1, -(-len(b) // 100)) for b in set(bodies.values()))
        assets.restore(parts.repartition(5, "part"), str(work / "out"), 100)
        assert {f: (work / "out" / f).read_bytes() for f in os.listdir(work / "out")} == {digest(b, 100, 9): b for b in bodies.values()}
        assert assets.part_digests(parts, fan=9).where("own <> digest").count() == 0
    more, parts = assets.catalog(listed(spark, tmp_path / "in", 1).where("size > 0"), str(tmp_path / "again"), rows, size=100, fan=9)
    assert parts.count() == 0 and {tuple(x.export_indices) for x in merge_assets(rows.union(more)).collect()} == {(0, 1)}


def test_changed_and_missing(spark, tmp_path):
    """A file that changes between the reads is an error; a folder without assets gives empty tables."""
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "notes.md").write_text("# n")
    rows, parts = assets.catalog(listed(spark, tmp_path / "none"), str(tmp_path / "w0"))
    assert rows.count() == 0 and parts.count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"before")
    _, parts = assets.catalog(listed(spark, tmp_path / "in"), str(tmp_path / "w1"))
    (tmp_path / "in" / "a.png").write_bytes(b"later!")
    with pytest.raises(Exception, match="changed while it was read"):
        parts.collect()


def test_skips(spark, tmp_path):
    """Asset files below skipped parts, runs of parts, absolute beginnings, or so named aren't listed, empty ones neither."""
    names = ("keep/a.png", "private/a.png", "x/private.d/a.png", "a/b/c.png", "a/x/b/c.png", "abs/e.png", "keep/named.png", "private/assets/u/content", "keep/assets/v/content")
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"" if name.endswith("content") else name.encode())
    skips = ("private", "a/b", str(tmp_path / "in" / "abs"), "named.png")
    got = {x.relative_path for x in assets.listing(spark, str(tmp_path / "in"), skips=skips).collect()}
    assert got == {n for n in names if not skipped(str(tmp_path / "in" / n), skips)} == {"keep/a.png", "x/private.d/a.png", "a/x/b/c.png", "keep/assets/v/content"}


def test_large_body_in_parts(spark, tmp_path):
    """A sparse file over 2 GB, which no value holds: parts alike, read by many tasks."""
    (tmp_path / "in").mkdir()
    n = (2 << 30) + (5 << 20) + 7
    with open(tmp_path / "in" / "big.gif", "wb") as f:
        f.seek(n - 1)
        f.write(b"x")
    own = listed(spark, tmp_path / "in")
    rows, _ = assets.catalog(own, str(tmp_path / "w"), own.sparkSession.createDataFrame([], "digest string"), size=16 << 20)
    zeros, last = hashlib.sha256(bytes(16 << 20)).hexdigest(), hashlib.sha256(bytes(n % (16 << 20) - 1) + b"x").hexdigest()
    assert [(x.size, x.digest) for x in rows.collect()] == [(n, "tree-" + hashlib.sha256((zeros * (n // (16 << 20)) + last).encode()).hexdigest())]


def test_archive_keeps_bodies_once(spark, tmp_path):
    """Two dumps with one asset in common: its body is stored once; changed parts are told; restored files are the bodies."""
    def dump(name, own):
        for uuid, body in own.items():
            (tmp_path / name / "assets" / uuid).mkdir(parents=True)
            (tmp_path / name / "assets" / uuid / "content").write_bytes(body)
        (tmp_path / name / "notes.md").write_text(f"# {name}")
        return str(tmp_path / name)

    a, long = Archives(spark, str(tmp_path / "archives"), part_bytes=1000), bytes(range(256)) * 20
    a.ingest(dump("one", {"u1": b"small", "u2": long}), service="s", account="a")
    a.ingest(dump("two", {"u3": long, "u4": b"other", "u5": b"other"}), service="s", account="a")
    got = {x.uuid: (x.digest, list(x.export_indices), x.relative_path) for x in a.assets("s", "a").collect()}
    assert {u: x[1:] for u, x in got.items()} == {"u1": ([0], "assets/u1/content"), "u2": ([0, 1], "assets/u2/content"), "u4": ([1], "assets/u4/content")}
    assert a.asset_bodies("s", "a").count() == 1 + 6 + 1 and a.broken_assets("s", "a").count() == 0
    a.restore_assets("s", "a", str(tmp_path / "out"), got["u2"][0])
    assert (tmp_path / "out" / got["u2"][0]).read_bytes() == long and len(os.listdir(tmp_path / "out")) == 1
    with pytest.raises(ArchiveError, match="no asset"):
        a.restore_assets("s", "a", str(tmp_path / "out"), "0" * 64)
    at = str(tmp_path / "archives" / "service=s" / "account=a")
    first = a._open(at)["versions"][0]
    kept = [(x.digest, x.part, bytes(x.body)) for x in spark.read.parquet(f"{at}/versions/{first}/asset_bodies").where("part <> 3").collect()]
    spark.createDataFrame(kept, assets.BODY).write.mode("overwrite").parquet(f"{at}/versions/{first}/asset_bodies")
    assert [x.digest for x in a.broken_assets("s", "a").collect()] == [got["u2"][0]]


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Any depth, links, hidden and empty files; the driver neither lists nor walks the folders."""
    for name, body in {"assets/u1/content": b"x", "a/b/c/d/e/f.png": b"yy", "top.JPG": b"z", "_hidden/p.png": b"h", ".dot/e.png": b"", "a/empty.gif": b"", "a/no.txt": b"t", "a b%20/é.png": b"w"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "l.png").write_bytes(b"1")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "else")
    monkeypatch.setattr(assets.os, "walk", None)
    got = assets.listing(spark, f"file://{tmp_path}/in")
    assert "BinaryFile" not in got._jdf.queryExecution().toString()
    rows = {r.relative_path: r for r in got.collect()}
    assert {k: r["size"] for k, r in rows.items()} == {"assets/u1/content": 1, "a/b/c/d/e/f.png": 2, "top.JPG": 1, ".dot/e.png": 0, "a/empty.gif": 0, "a b%20/é.png": 1, "link/l.png": 1}
    read = {r.path: r for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/in").collect()}
    assert all((r.path in read and read[r.path].modificationTime == r.mtime) == bool(r["size"]) for r in rows.values())
