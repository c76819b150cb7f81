import io
import json
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest import cli, wire, zstd_file
from palimpsest.archive import Archives, hits_json, hits_text, totals
from palimpsest.errors import ArchiveError, BrokenInputs, CompressError, EmptyPattern, InvalidPattern, NoArchives, ScopeError, SourceError
from palimpsest.functions.text import snippet
from palimpsest.operators import index, merge, search
from palimpsest.operators.spans import item_spans
from palimpsest.plans.query import Flags, check_java, compile_query, first_match, matches, raw_query
from palimpsest.sources import parsers
from palimpsest.sources.discover import by_scope, discover, discover_home, infer_scope, payload, scoped_path, without_copies, without_unpacked
from palimpsest.sources.readers import skipped
from palimpsest.streaming.ingest import start, upsert
from palimpsest.wire import to_toon


@pytest.mark.parametrize(
    "pattern,want",
    [("a AND b", (("a", "b"),)), ("a b", (("a", "b"),)), ("a OR b", (("a",), ("b",))), ("a|b", (("a",), ("b",))), ('"a b"', (("a b",),)), ('a"b', (('a"b',),)), (" x  y|z ", (("x", "y"), ("z",))), ("/usr/Bin", (("/usr/Bin",),)), ("/", (("/",),)), ("and or", (("and", "or"),))],
)
def test_human_queries(pattern, want):
    assert compile_query(pattern).alternatives == want


@pytest.mark.parametrize("pattern", ["a || b", "a||b", "|", "OR a", "a AND", "AND a", "a AND AND b", "a OR", '"', '""', "/x/q", "/usr/bin"])
def test_bad_queries(pattern):
    with pytest.raises(InvalidPattern):
        compile_query(pattern)


@pytest.mark.parametrize("pattern", ["", "  ", "//i"])
def test_empty_queries(pattern):
    with pytest.raises(EmptyPattern):
        compile_query(pattern)


def test_regex_queries(spark):
    q = compile_query("/foo/img")
    assert q.kind == "regex" and q.body == "foo" and q.flags.ignore_case and q.flags.multi_line
    assert compile_query(" C.t ", Flags(fixed=True)).alternatives == (("C.t",),)
    for bad in (r"/a\Kb/", "/(?R)/"):
        with pytest.raises(InvalidPattern):
            compile_query(bad)
    with pytest.raises(InvalidPattern):
        check_java(spark, compile_query("/(/"))


MATCHES = [
    ("the lizard", "a lizard\nthe end", False, {}),
    ("the lizard", "a lizard is the end", True, {}),
    ('"hello world"', "hello\nworld", False, {}),
    ("/hello.world/s", "hello\nworld", False, {}),
    ("food", "Catfooding", True, {}),
    ("food", "Catfooding", False, {"word": True}),
    ("C.tfooding", "Catfooding", False, {"fixed": True}),
    ("/C.tfooding/", "Catfooding", True, {}),
    ("école", "l'ÉCOLE", True, {"ignore_case": True}),
    ("lizard the", "lizard\rthe", True, {}),
    ("a_b", "x a_b y", True, {"word": True}),
    ("b", "a_b", False, {"word": True}),
    ("/(?P<n>z)/", "xyz", True, {}),
]


@pytest.mark.parametrize("pattern,text,want,flags", MATCHES)
def test_matches(spark, pattern, text, want, flags):
    q = compile_query(pattern, Flags(**flags))
    row = spark.createDataFrame([(text,)], "text string").select(matches(F.col("text"), q).alias("m"), first_match(F.col("text"), q).alias("f")).first()
    assert row.m is want and (row.f is not None) is want


def test_places_are_bytes(spark):
    rows = [("😀😀 é lizard the", "lizard", 12, 6), ("ab\nxx lizard", "/l.z/", 6, 3), ("é\n b a", "a b", 3, 0), ("xx thing\nthing", "thing|xx thing", 0, 8)]
    for text, pattern, pos, size in rows:
        q = compile_query(pattern) if pattern != "thing|xx thing" else compile_query('thing OR "xx thing"')
        m = spark.createDataFrame([(text,)], "text string").select(first_match(F.col("text"), q).alias("m")).first().m
        assert (m.pos, m.len) == (pos, size), text


def test_snippets(spark):
    def brute(text, pos, n):
        b = text.encode()
        lo, hi = max(0, pos - 56), min(len(b), pos + n + 56)
        while lo > 0 and b[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(b) and b[hi] & 0xC0 == 0x80:
            hi += 1
        return "..." * (lo > 0) + b[lo:hi].decode().translate({10: " ", 13: " ", 9: " "}) + "..." * (hi < len(b))

    rows = [(pre + "HIT" + post, len(pre.encode()), 3) for pre in ("", "x" * 57, "é" * 30, "😀" * 15, "a" + "😀" * 15, "aa" + "😀" * 15, "aaa\n\t" + "€" * 20) for post in ("", "y\r" * 40, "é" * 31, "z" + "😀" * 15, "zz" + "€" * 20)]
    got = spark.createDataFrame(rows, "t string, p long, n long").select("t", "p", "n", snippet(F.col("t"), F.col("p"), F.col("n")).alias("s")).collect()
    assert all(r.s == brute(r.t, r.p, r.n) for r in got)


def spans_of(spark, rows):
    return spark.createDataFrame([(a, c, k, f, t) for k, (a, c, f, t) in enumerate(rows)], "archive string, conversation_id string, span_index long, field string, text string")


def test_groups(spark):
    spans = spans_of(spark, [("a-b/c", "1", "message", "same aaa"), ("a/c", "2", "message", "same aaa"), ("a/c", "2", "message", "same aaa"), ("a/c", None, "title", "same aaa"), ("a/c", None, "title", "same aaa"), ("a/c", "9", "message", "aaa " * 80)])
    q = compile_query("aaa")
    unique = search.unique_hits(search.hits(spans, q))
    assert unique.count() == 4
    got = search.report(spans, q).collect()
    assert [(g.snippet[:8], len(g.occurrences)) for g in got] == [("same aaa", 3), ("aaa aaa ", 1)]
    assert [(o.archive, o.conversation_id) for o in got[0].occurrences] == [("a/c", "2"), ("a/c", None), ("a-b/c", "1")]
    assert search.report(spans, q, 1).count() == 1 and search.report(spans, q, 0).count() == 2
    omitted = {r.archive: r.duplicate_omitted for r in search.duplicate_omitted(spans, q).collect()}
    assert omitted == {"a/c": 84 - 3, "a-b/c": 0}
    assert search.suppressed_clause(1, 2) == "1 group not shown, 2 duplicates omitted" and search.suppressed_clause(0, 0) == ""


def dump(*convs):
    return json.dumps({"conversations": [{"conversation": c, "responses": [{"response": r} for r in rs]} for c, rs in convs], "odd": 1}).encode()


def test_merge_is_an_ordered_fold():
    item = lambda mod, f: {"conversation": {"id": "c", "modify_time": mod, **({"f": f} if f else {})}, "responses": []}
    folded = merge.merge_items(merge.merge_items(item("1", "A"), item("3", None)), item("2", "B"))
    assert folded["conversation"]["f"] == "A"
    assert merge.time_key({"$date": {"$numberLong": "5"}}) == "bson:$numberLong=5" and merge.time_key(9) == "other:i9" and merge.time_key("2024") == "2024"
    long, short = ({"response": {"_id": "r", "message": m}} for m in ("longer text", "text"))
    assert [r["response"]["message"] for r in merge._merge_responses([short], [long])] == ["longer text"]
    assert len(merge._merge_responses([long], [short])) == 2 and len(merge._merge_responses(merge._merge_responses([long], [short]), [short])) == 2


def test_ingest_search_and_stats(spark, tmp_path):
    one, two = tmp_path / "one" / "backend.json", tmp_path / "two" / "backend.json"
    for p in (one, two):
        p.parent.mkdir()
    one.write_bytes(dump(({"id": "c1", "title": "First", "modify_time": "1", "gate": True}, [{"_id": "r1", "sender": "user", "message": "the lizard"}]), ({"id": "c2"}, [{"_id": "q", "message": [{"type": "text", "text": "a part"}, {"type": "image", "image_url": {"url": "hidden"}}]}])))
    two.write_bytes(dump(({"id": "c1", "title": "Second", "modify_time": "2"}, [{"_id": "r1", "sender": "user", "message": "the lizard"}, {"_id": "r2", "message": "more of the lizard\nhere"}])))
    (two.parent / "broken.json").write_text('{"conversations": [{"conversation": ')
    a = Archives(spark, str(tmp_path / "archives"))
    with pytest.raises(NoArchives):
        a.spans()
    with pytest.raises(BrokenInputs, match="broken.json"):
        a.ingest(str(one.parent), str(two.parent), service="assistant", account="me")
    assert a.list() == [] and not [p for p in (tmp_path / "archives").rglob("*.parquet")]
    got = a.ingest(str(one.parent), str(two.parent), service="assistant", account="me", skip_broken=True)
    assert len(got["problems"]) == 1 and got["exports"] == 2 and got["conversations"] == 2 and a.list() == ["assistant/me"]
    conv = {r.id: r for r in a.table(got["output"], "conversations").collect()}
    assert a.verify("assistant", "me") and list(conv["c1"].export_indices) == [0, 1] and json.loads(conv["c1"].item)["conversation"]["title"] == "Second"
    assert json.loads(conv["c1"].item)["conversation"]["gate"] is True and len(json.loads(conv["c1"].item)["responses"]) == 2
    (two.parent / "broken.json").unlink()
    again = a.ingest(str(two.parent), service="assistant", account="me")
    assert again["exports"] == 3 and again["conversations"] == 2
    found = a.search("lizard the")
    assert [r.snippet for r in found.collect()] == ["the lizard", "more of the lizard here"]
    assert a.search("hidden").count() == 0 and a.search("gate").count() == 0 and a.search("part", service="assistant", account="me").count() == 1
    assert json.loads(hits_json(found))["hits"][0]["occurrences"][0]["conversation_id"] == "c1" and "present in:" in hits_text(found)
    s = a.stats().first()
    assert (s.exports, s.conversations, s.titles) == (3, 2, 1)
    with pytest.raises(ScopeError):
        a.spans(service="assistant")
    assert to_toon({"hits": [{"a": 1, "b": "x, y"}]}) == 'hits[1]{a,b}:\n  1,"x, y"'


def test_parsers():
    one = lambda kind, data, path="d/x.json": list(parsers.PARSERS[kind](path, data if isinstance(data, bytes) else json.dumps(data).encode()))
    texts = lambda item: [t for _, _, t in item_spans(item)]
    chat = {"name": "N", "id": 5, "messages": [{"id": 1, "from": "A", "text": ["hi ", {"type": "bold", "text": "you"}]}]}
    assert texts(one("messenger", chat)[0]) == ["N", "hi you"]
    assert len(one("messenger", {"chats": {"list": [chat]}, "left_chats": {"list": [chat]}})) == 2
    with pytest.raises(SourceError):
        one("messenger", {"x": 1})
    tree = [{"title": "T", "conversation_id": "c", "current_node": "b", "mapping": {"a": {"parent": "b", "message": {"content": {"parts": ["one"]}}}, "b": {"parent": "a", "children": [], "message": {"author": {"role": "u"}, "content": {"parts": ["two", {"text": "!"}]}}}, "z": {"message": {"content": {"text": "off"}}}, "r": {"message": None}}}]
    assert texts(one("mapping", tree)[0]) == ["T", "one", "two!", "off"]
    post = [{"timestamp": 7, "title": "P", "data": [{"post": "body"}, {"deep": ["more"]}]}]
    assert texts(one("activity", post)[0]) == ["P", "body\nmore"] and one("activity", post)[0]["conversation"]["id"] == "d/x.json#7"
    js = b"window.YTD.tweets.part0 = " + json.dumps([{"tweet": {"id_str": "9", "full_text": "tw"}}, {"like": {"tweetId": "8", "fullText": "lk"}}, {"dmConversation": {"conversationId": "d", "messages": [{"messageCreate": {"text": "dm", "createdAt": "t"}}]}}, {"odd": 1}]).encode()
    assert [texts(x) for x in one("assigned", js)] == [["tw"], ["lk"], ["dm"]]
    note = b"---\ntitle: no\nn: 5\nok: true\n---\n#Head\nbody"
    item = one("markdown", note, "n/a.md")[0]
    assert texts(item) == ["Head", "#Head\nbody"] and item["conversation"]["n"] == 5 and item["conversation"]["ok"] is True
    assert one("markdown", b"\xff plain", "n/b.md")[0]["conversation"]["utf8_lossy"] is True
    assert texts(one("cards", [{"title": "C", "keys": ["a", "b"], "value": "v"}, {"title": "none"}])[0]) == ["C", "a, b", "v"]
    with pytest.raises(SourceError):
        one("cards", [{"x": 1}])
    assert texts(one("character", b'name = "N"\nkeys = ["k"]\nvalue = "v"', "c/stem.toml")[0]) == ["N", "k", "v"]
    with pytest.raises(SourceError, match="line 2"):
        one("session", b'{"type": "user", "content": "x"}\n{')
    session = one("session", b'{"type": "user", "content": "x", "z": 1}\n\n', "s/chat_history.jsonl")[0]
    assert session["conversation"]["id"] == "s" and session["responses"][0]["response"]["z"] == 1
    assert texts(parsers.overlay_summary(session, {"id": "i", "generated_title": "G"})) == ["G", "x"]
    db = sqlite3.connect(":memory:")
    db.execute("create table session_docs(session_id text, title text, content text, extra_col text)")
    db.execute("insert into session_docs values ('s', 't', 'c', 'e'), ('', 'x', 'y', 'z')")
    items = one("index", db.serialize(), "i.db")
    assert len(items) == 1 and texts(items[0]) == ["t", "c"] and items[0]["conversation"]["extra_col"] == "e"
    assert [parsers.stringify_id(x) for x in ("a", "", 3, 2.0, 2.5, True, None)] == ["a", None, "3", "2", None, None, None]


def test_zip_and_discovery(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("conversations-000.json", json.dumps([{"conversation_id": "c", "title": "Zipped", "mapping": {}}]))
        f.writestr("photo.bin", b"x")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.zip").write_bytes(z.getvalue())
    (tmp_path / "e" / "b.zip").write_bytes(z.getvalue())
    assert infer_scope(str(tmp_path / "e"))[0] == "mapping-assistant"
    a = Archives(spark, str(tmp_path / "out"))
    a.ingest(str(tmp_path / "e" / "a.zip"), service="s", account="a")
    assert a.search("zipped", Flags(ignore_case=True)).count() == 1
    assert without_copies([str(tmp_path / "e" / n) for n in ("a.zip", "b.zip")]) == [str(tmp_path / "e" / "a.zip")]
    for bad in ("", "..", "a/b"):
        with pytest.raises(ScopeError):
            scoped_path("r", "s", bad)
    assert skipped("/x/node_modules/y") and skipped("/h/a/b/c", ("a/b",)) and not skipped("/h/a/c", ("a/b",))


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("s", "a", k, k // 3, json.dumps({"conversation": {"id": f"c{k % 3}", "title": "t" * k, "modify_time": str(k)}, "responses": [{"response": {"_id": f"r{k}", "message": f"m{k}"}}]})) for k in range(9)]
    items = spark.createDataFrame(rows, merge.ITEM)
    whole = sorted(map(str, merge.merge_conversations(items).collect()))
    state = None
    for k in range(3):
        state = upsert(state, items.where(F.col("export_index") == k))
    assert sorted(map(str, state.drop("seen").collect())) == whole
    for k in range(3):
        items.where(F.col("export_index") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark.readStream.schema(merge.ITEM).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "state" / "v2")).drop("seen").collect())) == whole


def test_assets_merge(spark):
    rows = [("d", "u1", "p1", 3, 0, 0, 1), ("d", "u2", "p2", 3, 0, 1, 2), ("e", "u3", "p3", 3, 0, 1, 3), ("d", "u1", "p1", 3, 0, 0, 4)]
    got = {r.digest: (r.uuid, list(r.export_indices)) for r in merge.merge_assets(spark.createDataFrame(rows, "digest string, uuid string, relative_path string, size long, mtime long, export_index int, seq long")).collect()}
    assert got == {"d": ("u1", [0, 1]), "e": ("u3", [1])}


def test_archive_switches_at_once(spark, tmp_path):
    """A failed ingest leaves the old version; another version and a missing table are errors; broken archives are passed over in a search of all."""
    log = tmp_path / "s" / "chat_history.jsonl"
    log.parent.mkdir()
    log.write_text('{"type": "user", "content": "one lizard"}\n')
    a = Archives(spark, str(tmp_path / "archives"))
    at = a.ingest(str(log.parent), service="sessions", account="x")["output"]
    (tmp_path / "bad.jsonl").write_text("{")
    with pytest.raises(BrokenInputs):
        a.ingest(str(tmp_path / "bad.jsonl"), service="sessions", account="x")
    assert a.search("lizard").count() == 1 and len(list((tmp_path / "archives").rglob("manifest.json"))) == 1
    a.ingest(str(log.parent), service="sessions", account="y")
    manifest = next((tmp_path / "archives" / "service=sessions" / "account=y").rglob("manifest.json"))
    manifest.write_text('{"version": 99}')
    for crc in manifest.parent.glob(".manifest*.crc"):
        crc.unlink()
    assert a.search("lizard").count() == 1 and len(a.unreadable) == 1
    with pytest.raises(ArchiveError, match="version 99"):
        a.search("lizard", service="sessions", account="y")
    with pytest.raises(ArchiveError):
        a.table(at + "x", "spans")


def test_tables_beside_conversations(spark, tmp_path):
    """Tables of a dump, account and payment files, other line files of a session, and assets, each once."""
    home = tmp_path / "dump"
    (home / "assets" / "11111111-1111-1111-1111-111111111111").mkdir(parents=True)
    (home / "assets" / "11111111-1111-1111-1111-111111111111" / "content").write_bytes(b"body")
    (home / "backend.json").write_text(json.dumps({"conversations": [{"conversation": {"id": "c"}, "responses": []}], "media_posts": [{"m": 1}], "projects": [], "tasks": [{"t": 1}, {"t": 2}], "odd": 3}))
    (home / "mgmt-auth-api.json").write_text(json.dumps({"user": {"xUsername": "me"}, "secret": "hide"}))
    a = Archives(spark, str(tmp_path / "archives"))
    at = a.ingest(str(home))["output"]
    assert at.endswith("service=assistant/account=me")
    assert sorted((r.kind, r.value) for r in a.table(at, "tagged").collect()) == [("auth", '{"user": {"xUsername": "me"}, "secret": "hide"}'), ("extra", '{"odd": 3}'), ("media_posts", '{"m": 1}'), ("tasks", '{"t": 1}'), ("tasks", '{"t": 2}')]
    a.ingest(str(home))
    got = a.assets("assistant", "me").collect()
    assert len(got) == 1 and got[0].uuid == "11111111-1111-1111-1111-111111111111" and list(got[0].export_indices) == [0, 1]
    assert a.search("hide").count() == 0
    log = tmp_path / "log"
    log.mkdir()
    (log / "chat_history.jsonl").write_text('{"type": "user", "content": "hello"}\n')
    (log / "events.jsonl").write_text('{"type": "x", "content": "left over"}\n')
    (log / "summary.json").write_text('{"id": "named", "generated_title": "Title"}')
    at = a.ingest(str(log), service="sessions", account="z")["output"]
    assert [r.id for r in a.table(at, "conversations").collect()] == ["named"] and [r.kind for r in a.table(at, "tagged").collect()] == ["leftover"]
    assert a.search("left").count() == 0


def test_discovery(spark, tmp_path):
    home = tmp_path / "home"
    (home / "a" / "deep").mkdir(parents=True)
    (home / ".hidden").mkdir()
    tree = json.dumps([{"conversation_id": "c", "title": "Walked", "mapping": {}}])
    (home / "a" / "conversations-000.json").write_text(tree)
    (home / "a" / "deep" / "note.md").write_text("# n")
    (home / ".hidden" / "conversations.json").write_text(tree)
    with zipfile.ZipFile(home / "z.zip", "w") as f:
        f.writestr("conversations-000.json", tree)
    assert discover_home(str(home)) == [str(home / "a" / "conversations-000.json"), str(home / "z.zip")]
    assert discover_home(str(home), depth=0) == [str(home / "z.zip")]
    assert discover(str(home / "a")) == ("mapping", [home / "a" / "conversations-000.json"])
    assert payload(str(home / "a")) == payload(str(home / "z.zip"))
    assert without_unpacked([str(home / "a"), str(home / "z.zip")]) == [str(home / "a")] and len(without_unpacked([str(home / "a"), str(home / "a")])) == 2
    assert by_scope(discover_home(str(home))) == {("mapping-assistant", "a"): [str(home / "a" / "conversations-000.json")], ("mapping-assistant", "home"): [str(home / "z.zip")]}
    reports = Archives(spark, str(tmp_path / "out")).ingest_home(str(home))
    assert totals(reports) == {"archives": 2, "exports": 2, "conversations": 2}
    for bad in ("gone", "a/deep/x.bin"):
        (home / "a" / "deep" / "x.bin").write_bytes(b"?")
        with pytest.raises(SourceError):
            discover(str(home / bad))
    chats = tmp_path / "chats"
    for name in ("one", "two"):
        (chats / name).mkdir(parents=True)
        (chats / name / "result.json").write_text(json.dumps({"personal_information": {"username": "@" + name}, "chats": {"list": []}}))
    with pytest.raises(ScopeError, match="several accounts"):
        infer_scope(str(chats))


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "s" / "chat_history.jsonl"
    log.parent.mkdir()
    log.write_text('{"type": "user", "content": "one lizard"}\n{"type": "user", "content": "two lizards"}\n')
    env = {"HOME": str(tmp_path), "PALIMPSEST_ARCHIVE_DIR": str(tmp_path / "archives")}

    def out(*args, code=0, source=None):
        sink = io.StringIO()
        assert cli.run(list(args), spark, sink, source, env) == code
        return sink.getvalue()

    assert "1 exports, 1 conversations" in out("ingest", "--service", "sessions", "--account", "me", str(log.parent))
    text = out("search", "lizard", "-m", "1")
    assert "message: one lizard" in text and "1 group not shown" in text and "sessions/me  s  message" in text
    assert out("search", "lizard", "sessions/me").startswith("sessions/me\n") and "sessions/me  s" not in out("search", "lizard", "sessions/me")
    assert len(json.loads(out("search", "LIZARD", "-i", "--format", "json"))["hits"]) == 2
    assert out("search", "two", "--format", "toon").startswith("hits[1]:")
    assert "messages: 2" in out("stats", "sessions/me") and json.loads(out("stats", "--format", "json"))[0]["messages"] == 2
    assert json.loads(out("acp", source=io.StringIO('{"jsonrpc":"2.0","id":1,"method":"list_archives"}\n')))["result"] == {"archives": ["sessions/me"]}
    out("search", "lizard", "--service", "sessions", code=1)
    out("search", "   ", code=1)
    out("ingest", "--service", "s", "--account", "a", code=1)
    assert "empty" in capsys.readouterr().err
    data = tmp_path / "data.txt"
    data.write_text("abc" * 1000)
    assert out("compress", str(data), "--level", "5").strip() == f"{data}.zst" and data.exists()
    packed = (tmp_path / "data.txt.zst").read_bytes()
    data.unlink()
    out("decompress", f"{data}.zst")
    assert data.read_text() == "abc" * 1000 and len(packed) < 100
    out("compress", f"{data}.zst", code=1)
    out("decompress", str(data), code=1)
    (tmp_path / "junk.zst").write_bytes(b"junk")
    with pytest.raises(CompressError):
        zstd_file.decompress(str(tmp_path / "junk.zst"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_text("x" * 500)
    assert out("bench", str(tmp_path / "b")).count("\n") == 24


def test_status_events(spark, tmp_path):
    a, seen = Archives(spark, str(tmp_path / "archives")), []
    for name, text in (("m", "lizard"), ("n", "none")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "chat_history.jsonl").write_text(json.dumps({"type": "user", "content": text}) + "\n")
        a.ingest(str(tmp_path / name), service="sessions", account=name)
    a.search("lizard", status=seen.append)
    assert seen == [{"event": "starting", "archives": 2}, {"event": "archive", "archive": "sessions/m", "done": 1, "of": 2, "unique_hits": 1}, {"event": "archive", "archive": "sessions/n", "done": 2, "of": 2, "unique_hits": 1}]


def test_wire():
    assert wire.accepted(None) == wire.accepted("*/*") == wire.accepted("application/json, application/toon") == wire.JSON
    assert wire.accepted("application/toon") == wire.accepted("application/json;q=0.5, application/toon;q=0.9") == wire.TOON
    assert to_toon({"a": {"b": [1, 2]}, "c": [], "d": "5", "rows": [{"x": 1, "y": None}, {"x": 2, "y": "p q"}]}) == 'a:\n  b[2]: 1,2\nc[0]:\nd: "5"\nrows[2]{x,y}:\n  1,null\n  2,p q'
    assert to_toon([{"a": [1]}, "x"]) == "[2]:\n  - a[1]: 1\n  - x"


def test_postings_of_long_texts(spark):
    """Offsets against a plain scan, for texts with many blocks of tokens, with marks and letters of several bytes."""
    texts = ["", " ", "one", "é, ß!", "  a bé\n" * 3000, "x" * 10]
    got = index.postings(spark.createDataFrame([("a", k, t) for k, t in enumerate(texts)], "archive string, span_index long, text string")).collect()
    want = [(m[0], k, len(t[: m.start()].encode())) for k, t in enumerate(texts) for m in re.finditer(r"[a-zéß0-9]+", t)]
    assert sorted((r.term, r.span_index, r.byte_off) for r in got) == sorted(want)
