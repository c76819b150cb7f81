import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.archive import Archives
from palimpsest.operators.merge import ITEM, MERGED, merge_conversations
from palimpsest.operators.spans import STRIDE, item_spans, spans

COLUMNS = [c.split()[0] for c in MERGED.split(", ")]


def rows_of(items):
    return [("s", "a", k, str(k), [0], 1, json.dumps(x, ensure_ascii=False)) for k, x in enumerate(items)]


def both(spark, items):
    want = sorted((k, k * STRIDE + n, *s) for k, x in enumerate(items) for n, s in enumerate(item_spans(x)))
    return sorted(tuple(r) for r in spans(spark.createDataFrame(rows_of(items), MERGED)).select("seq", "span_index", "record_kind", "field", "text").collect()), want


def message(value):
    return {"response": {"message": value, "odd": {"a": [1]}}}


def test_spans_tell_types_apart(spark):
    """Titles that aren't strings, scalars, nulls, parts in arrays in arrays, very long texts, numbers that JSON doesn't have."""
    deep = "bottom"
    for _ in range(300):
        deep = [deep, []]
    items = [
        {"conversation": {"title": "t", "summary": 5}, "responses": [message("a"), message(["x", ["y", [{"type": "text", "text": "z"}, {"type": "image", "text": "no"}, 7, None, True]], ""])]},
        {"conversation": None, "responses": None},
        {},
        {"conversation": {"title": ""}, "responses": [{"response": None}, {"x": 1}, {"response": {}}]},
        {"conversation": {"title": ["no"], "summary": "true"}, "responses": [message("123"), message(["2024-01-01", "null"]), message({"type": ["text"], "text": "no"}), message({"type": "text", "text": ["no"]})]},
        {"conversation": {"title": "odd", "x": float("nan"), "y": float("-inf"), "n": 10**60}, "responses": [message(deep), message(10**50), message([[], [[]], {"type": "text", "text": "q\u0000\U0001f600"}])]},
        {"conversation": {"title": "long"}, "responses": [message("é" * 3_000_000), message("after")]},
    ]
    got, want = both(spark, items)
    assert got == want and len(want) == 15


def test_spans_of_random_values(spark):
    rng = random.Random(5)

    def value(depth):
        k = rng.randrange(9 if depth else 6)
        if k < 6:
            return [None, True, 3, 1.5, "w" * rng.randrange(3), "text"][k]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if k < 8 else {n: value(depth - 1) for n in rng.sample(["type", "text", "x"], 2)} | ({"type": "text"} if rng.random() < 0.6 else {})

    items = [{"conversation": {"title": value(2), "summary": value(1)}, "responses": [message(value(4)) for _ in range(rng.randrange(5))]} for _ in range(400)]
    got, want = both(spark, items)
    assert got == want and len(want) > 300


def test_spans_need_no_python(spark):
    plan = spans(spark.range(1).selectExpr("'s' service", "'a' account", "id seq", "'i' id", "'{}' item"))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


def write_dump(path, conversations):
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps({"conversations": [{"conversation": {k: v for k, v in (("id", i), ("title", t), ("modify_time", m)) if v is not None}, "responses": [{"response": {"_id": r, "message": x}} for r, x in rs]} for i, t, m, rs in conversations]}))
    return str(path)


def files(at):
    return {str(p): p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet") if "bucket=" in str(p)}


def same_as_one_fold(spark, a, at):
    """The archive is what one fold over all of its dumps gives, its spans are those of its conversations, its tree is theirs."""
    items = a.table(at, "items").select(*[c.split()[0] for c in ITEM.split(", ")])
    want = sorted(map(str, merge_conversations(items).select(*COLUMNS).collect()))
    got = a.table(at, "conversations").select(*COLUMNS)
    assert sorted(map(str, got.collect())) == want
    assert sorted(map(str, a.spans("s", "a").collect())) == sorted(map(str, spans(got).collect()))
    assert a.verify("s", "a") and a.differing("s", "a").count() == 0
    return len(want)


def test_an_ingest_writes_touched_buckets_only(spark, tmp_path):
    """Ten conversations in a new dump: at most ten buckets, and no file of another; with ids that are new, that repeat, and none."""
    a = Archives(spark, f"{tmp_path}/archives", buckets=64)
    first = write_dump(tmp_path / "d" / "1.json", [(f"c{k}", f"title {k}", "1", [("r", f"lizard {k}")]) for k in range(300)] + [(None, "nameless", None, [("r", "alone")])] * 3)
    one = a.ingest(first, service="s", account="a", kind="assistant")
    at = one["output"]
    assert one["conversations"] == 303 and one["buckets_written"] > 50 and same_as_one_fold(spark, a, at) == 303
    before = files(at)
    second = write_dump(tmp_path / "d" / "2.json", [(f"c{k}", f"newer {k}", "2", [("r", f"lizard {k}"), ("q", "gecko")]) for k in range(8)] + [("new", "fresh", None, [("r", "gecko")]), (None, "other", None, [("r", "gecko")])])
    two = a.ingest(second, service="s", account="a", kind="assistant")
    assert two["conversations"] == 305 and two["exports"] == 2 and two["buckets_written"] <= 10
    after = files(at)
    assert before.items() <= after.items()  # nothing of the version before was touched
    written = {p.split("bucket=")[1].split("/")[0] for p in after.keys() - before.keys()}
    assert len(written) == two["buckets_written"]
    assert same_as_one_fold(spark, a, at) == 305
    groups = {r.text: r.n for r in a.search("gecko OR lizard", None, 0, "s", "a").select("text", F.size("occurrences").alias("n")).collect()}
    assert len(groups) == 301 and groups["gecko"] == 10
    # titles that were replaced aren't found in buckets that have newer ones, though the older index knows them
    assert a.search('"title 3"', service="s", account="a").where("text = 'title 3'").count() == 0 and a.search('"newer 3"', service="s", account="a").count() == 1
    found = a.search("lizard", None, 0, "s", "a").count()
    place, leaf, steps, root = a.proof("s", "a", "c200")
    from palimpsest.operators import merkle

    assert found == 300 and merkle.proves(steps, place, leaf, root)


def test_buckets_that_no_reader_can_need_go(spark, tmp_path):
    """Two versions stay readable; of older ones those buckets stay that a later version still holds, and the dumps."""
    a = Archives(spark, f"{tmp_path}/archives", buckets=8)
    at = None
    for k in range(4):
        rows = [(f"c{n}", f"t{k}", str(k), [(f"r{k}", f"word{k}")]) for n in (range(40) if k == 0 else range(2))]
        reader = a.spans("s", "a") if k else None
        at = a.ingest(write_dump(tmp_path / "d" / f"{k}.json", rows), service="s", account="a", kind="assistant")["output"]
        if reader is not None:
            assert reader.where("text = 't0'").count() == (40 if k == 1 else 38)
        assert same_as_one_fold(spark, a, at) == 40
    folders = sorted(Path(f"{at}/versions").iterdir())
    assert len(folders) == 4 and sum((f / "manifest.json").exists() for f in folders) == 2
    held = [{p.name for p in f.glob("conversations/bucket=*")} for f in folders]
    first = max(held, key=len)  # what later dumps never touched
    assert len(first) >= 6 and sorted(map(len, held))[0] == 0
    assert all((f / "items").exists() for f in folders)
    # the very same dump again changes only where it is from
    again = a.ingest(str(tmp_path / "d" / "3.json"), service="s", account="a", kind="assistant")
    assert again["conversations"] == 40 and again["exports"] == 5 and same_as_one_fold(spark, a, at) == 40


def test_an_empty_dump_adds_nothing(spark, tmp_path):
    a = Archives(spark, f"{tmp_path}/archives", buckets=8)
    got = a.ingest(write_dump(tmp_path / "d" / "0.json", []), service="s", account="a", kind="assistant")
    assert got["conversations"] == 0 and got["buckets_written"] == 0 and a.spans("s", "a").count() == 0 and a.verify("s", "a")
    got = a.ingest(write_dump(tmp_path / "d" / "1.json", [("c", "t", None, [])]), service="s", account="a", kind="assistant")
    assert got["conversations"] == 1 and a.search("t", service="s", account="a").count() == 1


def test_a_large_dump_is_no_task_of_its_own(spark, tmp_path, monkeypatch):
    """Its file is written by many tasks, and its items are numbered by ranges: in order of their places, without a window over the dump."""
    from palimpsest.plans.queries import _one_dump

    writes, write = {}, Archives._write
    monkeypatch.setattr(Archives, "_write", lambda self, df, path, by=None: writes.update({path.rsplit("/", 1)[-1]: df._jdf.queryExecution().executedPlan().toString()}) or write(self, df, path, by))
    items = [{"conversation": {"id": f"c{k}"}, "responses": [{"response": {"_id": "1", "message": f"é{k}"}}]} for k in range(3000)]
    rows = spark.createDataFrame([(json.dumps(x, ensure_ascii=False),) for x in items], "value string").repartition(7)
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dump", "")
    path = _one_dump(spark, rows, f"file://{tmp_path}/d", '"odd":1,', ',"x":[]')
    stages = [tasks.getStageInfo(s).numTasks for j in tasks.getJobIdsForGroup("dump") for s in tasks.getJobInfo(j).stageIds if tasks.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages.count(7) >= 2  # lines, and their copying
    read = json.loads(Path(path).read_text())
    assert read["odd"] == 1 and read["x"] == [] and sorted(x["conversation"]["id"] for x in read["conversations"]) == sorted(x["conversation"]["id"] for x in items)
    archives = Archives(spark, str(tmp_path / "archives"), buckets=2)
    archives.ingest(path, service="s", account="a", kind="assistant")
    got = archives.table(str(tmp_path / "archives/service=s/account=a"), "items").orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(len(got))) and len(got) == 3000
    assert [json.loads(r["item"])["conversation"]["id"] for r in got] == [x["conversation"]["id"] for x in read["conversations"]]
    assert "rangepartitioning(export_index" in writes["ranged"] and "row_number" not in writes["items"]
    assert json.loads(Path(_one_dump(spark, rows.limit(0), f"file://{tmp_path}/none")).read_text()) == {"conversations": []}
