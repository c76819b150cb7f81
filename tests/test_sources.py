"""Blocks of files and zips, and arrays read by many tasks."""

import json
import random
import zipfile

import pytest

from palimpsest.sources import arrays, blocks, readers


def dump(n, seed=1):
    """Conversations whose texts have all that could be taken for structure."""
    r = random.Random(seed)
    odd = ['"', "\\", '\\"', "[", "]", "{", "}", ",", ":", "é", "\U0001f600", "\n", "a", 'conversations":[', "\\\\\\"]
    say = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 30)))
    return [{"conversation": {"id": f"c{k}", "title": say(), say(): [say(), {"x": [1, [say()]]}]}, "responses": [{"response": {"_id": str(j), "message": say()}} for j in range(r.randint(0, 4))]} for k in range(n)]


def in_blocks(spark, files, size):
    rows = [(path, k, data[at : at + size]) for path, data in files.items() for k, at in enumerate(range(0, max(len(data), 1), size))]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, blocks.SCHEMA)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_states_and_cuts_compose(size):
    """Blocks of any size, down to one byte, give the pieces of the whole."""
    text = json.dumps({"a b": dump(6), "empty": [], "n": 3, 'odd"key\\': [1, "x,]", [2]], "o": {"p": [1, 2]}}, ensure_ascii=False, indent=1).encode()
    whole = arrays.cut(text, 0, 0, 2)
    state, depth, got, open_piece = 0, 0, [], None
    for at in range(0, len(text), size):
        part = text[at : at + size]
        ends, deltas, _ = arrays.summary(part)
        own = arrays.cut(part, state, depth, 2)
        if open_piece is not None:
            assert own[0][0] == open_piece[0]
            own[0] = (own[0][0], own[0][1], open_piece[2] + own[0][2])
        got += own[:-1]
        open_piece = own[-1]
        state, depth = ends[state], depth + deltas[state]
    assert got + [open_piece] == whole and (state, depth) == (0, 0)


@pytest.mark.parametrize("size", [1, 13, 100, 10_000])
def test_items_equal_the_whole_parse(spark, tmp_path, size):
    own, more = dump(40), dump(3, 2)
    if size == 1:
        own = own[:5]
    files = {
        "object.json": json.dumps({"conversations": own, "n": 1, "empty": [], "media, [posts]": [3, None, "x"], "o": {"a": [1, 2]}, 'q"\\': more}, ensure_ascii=False, indent=1).encode(),
        "array.json": json.dumps(more, ensure_ascii=False).encode(),
        "script.js": b"window.YTD.tweets.part0 = " + json.dumps([{"tweet": {"id_str": str(k)}} for k in range(9)]).encode() + b";",
        "mark.json": b"\xef\xbb\xbf [ 1 , [2, 3], \"],\" ] ",
        "none.json": b"",
        "hollow.json": b"[]",
    }
    found = arrays.items(in_blocks(spark, files, size), f"{tmp_path}/w").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.path, r.key or "", r.place)):
        by.setdefault((r.path, r.key), []).append((r.place, json.loads(r.item)))
    want = {("object.json", "conversations"): own, ("object.json", "media, [posts]"): [3, None, "x"], ("object.json", 'q"\\'): more, ("array.json", None): more, ("script.js", None): [{"tweet": {"id_str": str(k)}} for k in range(9)], ("mark.json", None): [1, [2, 3], "],"]}
    assert by == {k: list(enumerate(v)) for k, v in want.items()}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    own = dump(300)
    (tmp_path / "d.json").write_text(json.dumps({"conversations": own}, ensure_ascii=False))
    read = blocks.read_blocks(spark, f"{tmp_path}/d.json", block=2000, split=6000)
    assert read.rdd.getNumPartitions() > 10
    assert b"".join(r.body for r in sorted(read.collect(), key=lambda r: r.block)) == (tmp_path / "d.json").read_bytes()
    got = sorted(arrays.items(read, f"{tmp_path}/w").collect(), key=lambda r: r.place)
    assert [json.loads(r.item) for r in got] == own and {r.key for r in got} == {"conversations"}


def test_zips_are_read_entry_by_entry(spark, tmp_path):
    bodies = {f"d/{k}.json": random.Random(k).randbytes(k * 500) for k in range(20)} | {"empty.md": b"", "large.bin": bytes(50_000)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in bodies.items():
            z.writestr(name, body)
        z.mkdir("folder")
        z.writestr("nested.zip", b"PK")
        locked = zipfile.ZipInfo("locked.md")
        z.writestr(locked, b"secret")
        z.filelist[-1].flag_bits |= 1
    read = blocks.read_blocks(spark, f"{tmp_path}/z.zip", block=1024, split=4096)
    assert read.rdd.getNumPartitions() > 10
    got = {}
    for r in sorted(read.collect(), key=lambda r: (r.path, r.block)):
        got.setdefault(r.path.split("!/")[1], []).append(r.body)
    assert {k: b"".join(v) for k, v in got.items()} == bodies and len(got["large.bin"]) == 49
    assert {r.path.split("!/")[1] for r in blocks.read_blocks(spark, f"{tmp_path}/z.zip", entries="d/1*.json").collect()} == {n for n in bodies if n.startswith("d/1")}


def test_conditions_on_paths_choose_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(30):
            z.writestr(f"{k}.md", str(k))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = blocks.read_blocks(spark, f"{tmp_path}/z.zip", split=1)
        one = read.where(f"path = '{tmp_path}/z.zip!/7.md'")
        assert [r.body for r in one.collect()] == [b"7"] and one.rdd.getNumPartitions() == 1
        assert read.where("path like '%9.md'").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_entries_beyond_two_gigabytes(spark, tmp_path):
    """An entry of zeros, larger than any value can be; packed it is small."""
    size = (2 << 30) + 12345
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.bin", "w", force_zip64=True) as f:
        chunk = bytes(16 << 20)
        for _ in range(128):
            f.write(chunk)
        f.write(bytes(12345))
    read = blocks.read_blocks(spark, f"{tmp_path}/big.zip", block=32 << 20)
    assert read.selectExpr("sum(octet_length(body)) as n", "max(octet_length(body)) as m").first() == (size, 32 << 20)


def test_files_in_blocks_are_parsed_as_whole_ones(spark, tmp_path):
    """Every kind, by blocks of 300 bytes out of a zip, and each file whole: the same rows, in any order."""
    own = dump(30)
    trees = [{"conversation_id": f"t{k}", "title": "[x]", "mapping": {"a": {"parent": None, "children": ["b"]}, "b": {"parent": "a", "message": {"id": "m", "author": {"role": "user"}, "content": {"parts": [f"hello {k}"]}}}}, "current_node": "b"} for k in range(9)]
    posts = [{"data": [{"post": f"post {k} {{"}]} if k % 2 else {"timestamp": k, "content": "c"} for k in range(12)]
    files = {
        "export.json": json.dumps({"conversations": own, "media_posts": [{"a": 1}, {}], "tasks": [], "odd": [1, 2], "n": 7, "o": {"p": 1, "q": [2]}}, ensure_ascii=False),
        "conversations-1.json": json.dumps(trees),
        "your_facebook_activity/posts.json": json.dumps(posts),
        "tweets.js": "window.YTD.tweets.part0 = " + json.dumps([{"tweet": {"id_str": str(k), "full_text": "t" * 30}} for k in range(20)]),
        "note.md": "# Head\n" + "text " * 200,
        "s/chat_history.jsonl": "\n".join(json.dumps({"type": "user", "content": f"line {k}"}) for k in range(40)),
        "broken-conversations.json": json.dumps({"conversations": own})[:-400] + '"conversation"',
        "odd.txt": "x" * 900,
    }
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    path = f"{tmp_path}/z.zip"
    got = readers.read_files(spark, path, work=f"{tmp_path}/w", block=300).collect()
    whole = readers.parse_files(spark.createDataFrame([(f"{path}!/{n}", t.encode()) for n, t in files.items()], "path string, content binary")).collect()
    plain = lambda rows: sorted((r.path, r.kind, r.place, json.dumps(json.loads(r.item), sort_keys=True)) for r in rows if r.item and r.kind not in ("extra", "media_posts"))
    assert plain(got) == plain(whole) and {r[1] for r in plain(got)} == {"assistant", "mapping", "activity", "assigned", "markdown", "session"}
    assert [r.path for r in got if r.problem] == [f"{path}!/broken-conversations.json"] == [r.path for r in whole if r.problem]
    assert sorted(r.item for r in got if r.kind == "media_posts") == ['{"a": 1}']
    extra = [json.loads(r.item) for r in got if r.kind == "extra"]
    assert sorted(map(json.dumps, extra)) == sorted(map(json.dumps, [{"odd": [1]}, {"odd": [2]}, {"n": 7}, {"o": {"p": 1}}, {"o": {"q": [2]}}]))


def test_moved_exports_keep_their_ids():
    assert readers.relative("file:/a/b/n/x.md", ("/a/b",)) == "n/x.md" == readers.relative("/z.zip!/n/x.md")
    assert readers.relative("/a/b/x.md", ("/a/b/x.md", "/a")) == "x.md" and readers.relative("7.md") == "7.md"
