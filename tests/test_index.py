"""The persistent index, late-materialised reports: the same rows as a scan, and less read."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.archive import Archives
from palimpsest.operators import index, search
from palimpsest.plans.query import Flags, compile_query

SPANS = "archive string, conversation_id string, span_index long, field string, text string"


@pytest.mark.parametrize("values", [[], [0], [127, 128, 0, 2**14, 2**35, 2**62, 1], list(range(300))])
def test_varints(values):
    assert index.from_varints(index.to_varints(np.array(values, np.int64))[0]).tolist() == values


def test_blocks_round_trip():
    """Two blocks, of three spans and of one."""
    spans, lists = [3, 4, 900, 2**40], [[0, 5], [7], [1, 2, 10**9], [0]]
    own, places = index.encode(np.array(spans), np.array([len(x) for x in lists]), np.array(sum(lists, [])), np.array([0, 3]))
    assert [index.decode_spans(x).tolist() for x in own] == [spans[:3], spans[3:]]
    assert [x.tolist() for k, n in ((0, 3), (1, 1)) for x in index.decode_places(places[k], n)] == lists
    assert len(own[0]) == 4 and len(places[0]) < 14


def test_places_are_bytes():
    text = "Ünï x² 中文, ab́c İK \U0001f600 z"
    found, at = index.token_places(text)
    assert found == ["Ünï", "x²", "中文", "ab", "c", "İK", "z"]
    assert [text.encode()[a:].decode()[: len(t)] for t, a in zip(found, at, strict=True)] == found


def test_ranges():
    assert index.ranges([1, 2, 3, 50, 51, 900], 3) == [(1, 3), (50, 51), (900, 900)]
    assert index.ranges([1, 9], 1) == [(1, 9)] and index.ranges([5], 4) == [(5, 5)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Spans of words with case, accents, superscripts, underscores, and characters whose case folds oddly."""
    r = random.Random(4)
    words = ["the", "The", "lizard", "Lizards", "wizard", "x²", "x", "foo_bar", "foo", "bar", "café", "CAFÉ", "ſtraße", "STRASSE", "Kelvin", "İstanbul", "istanbul", "中文", "a.b", "C++", "naïve", "rare"]
    rows = [("s/a" if k % 3 else "s/b", f"c{k % 40}", k, "message", "\n".join(" ".join(r.choice(words[:-1]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 3)))) for k in range(1500)]
    rows += [("s/a", "c", 2000, "message", None), ("s/a", "c", 2001, "message", ""), ("s/a", "c", 2002, "message", "!!! ..."), ("s/b", None, 2003, "title", "one rare thing"), ("s/b", "c1", 2004, "message", "rarely"), ("s/b", "c1", 2005, "message", "one rare thing")]
    path = str(tmp_path_factory.mktemp("index"))
    spans = spark.createDataFrame(rows, SPANS).repartition(3)
    spans.sort("span_index").coalesce(1).write.option("parquet.block.size", "2048").parquet(f"{path}/spans")
    return spark.read.parquet(f"{path}/spans"), index.build(spans, f"{path}/index", block=64), rows


QUERIES = [
    ("lizard", {}), ("izard", {}), ("rare", {}), ("rare", {"word": True}), ("LIZARD", {"ignore_case": True}), ("wizard", {"word": True, "ignore_case": True}), ("x", {"word": True}), ("foo_bar", {}), ("oo_ba", {}), ("foo", {"word": True}),
    ('"the lizard"', {}), ('"rd the wiz"', {}), ("lizard café", {}), ("rare thing OR 中", {}), ("strasse", {"ignore_case": True}), ("ſTRAßE", {"ignore_case": True}), ("STRA", {"ignore_case": True}), ("kelvin", {"ignore_case": True}), ("istanbul", {"ignore_case": True}), ("C++", {}), ("a.b", {}), ("!!!", {}), ("/l.z/", {}), ("absent", {}), ("absent OR rare", {}), ("the", {}),
]


@pytest.mark.parametrize("share,most,step", [(1e9, 20_000, 1), (0.25, 20_000, 5), (1e9, 0, 7)])
def test_a_search_over_the_index_is_the_search(made, share, most, step):
    spans, terms, _ = made
    for pattern, flags in QUERIES[::step]:
        q = compile_query(pattern, Flags(**flags))
        own = index.TermIndex(terms.spark, terms.path, share=share, most=most, ranges=4)
        want = sorted(map(tuple, search.hits(spans, q).select("span_index", "pos", "len").collect()))
        got = sorted(map(tuple, search.hits(own.narrowed(spans, q), q).select("span_index", "pos", "len").collect()))
        assert got == want, (pattern, flags)
        assert pattern in ("absent", "x", "STRA") or want or own.estimate is not None


def test_blocks_hold_every_place(made):
    _, terms, rows = made
    want = {(t, i, tuple(at)) for _, _, i, _, text in rows for t, at in _grouped(text).items()}
    got = {(r.term, r.span_index, tuple(r.offsets)) for r in terms.places().collect()}
    assert got == want
    blocks = terms.spark.read.parquet(f"{terms.path}/postings").where("term = 'the'").orderBy("archive", "first_span").collect()
    assert len(blocks) > 4 and all(b.n_spans <= 64 for b in blocks)  # a frequent term has many
    assert all(a.last_span < b.first_span for a, b in zip(blocks, blocks[1:], strict=False) if a.archive == b.archive)


def _grouped(text):
    out = {}
    for m in re.finditer(r"[^\W_]+", text or ""):
        out.setdefault(m[0], []).append(len(text[: m.start()].encode()))
    return out


def scanned(df):
    """Rows that the scans of a plan gave, after it ran."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_a_search_by_index_reads_few_row_groups(made):
    spans, terms, _ = made
    q = compile_query("rare")
    everything, few = scanned(search.hits(spans, q)), scanned(search.hits(terms.narrowed(spans, q), q))
    assert everything > 1000 and 0 < few < everything / 4


def test_archives_write_and_use_their_index(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(30):
        (tmp_path / "a" / f"note{k}.md").write_text(f"# Note {k}\nsome words {'zebra' if k == 7 else ''} end\n")
    archives = Archives(spark, f"{tmp_path}/archives")
    archives.ingest(str(tmp_path / "a"), service="notes", account="me", kind="markdown")
    q = compile_query("zebra")
    assert archives.spans("notes", "me").count() > archives.spans("notes", "me", q).count() == 1
    assert [len(r.occurrences) for r in archives.search("zebra", service="notes", account="me").collect()] == [1]
    assert archives.search("zebra OR Note").count() >= 30
    assert archives.omitted("zebra") == 0


def test_reports_fetch_texts_last(spark):
    """A cap sorts digests and order keys; texts come after it, by a join on the groups that are shown."""
    rows = [("s/a", f"c{k}", k, "message", f"common text {k % 5}") for k in range(400)] + [("s/b", "d", 1000, "title", "common text 3")]
    spans = spark.createDataFrame(rows, SPANS)
    q = compile_query("common")
    got = search.report(spans, q, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("GlobalLimit") :].split("Join")[0]
    assert "snippet" not in below and "collect_list" not in below
    assert [(r.text, len(r.occurrences)) for r in got.collect()] == [("common text 0", 80), ("common text 1", 80)]
    parts = search.report_segments(spans, q, 4, size=30).collect()
    assert [(r.text, r.segment, len(r.occurrences)) for r in parts if r.ord == parts[-1].ord] == [("common text 3", 0, 30), (None, 1, 30), (None, 2, 21)]
    whole = {r.text: [tuple(o) for o in r.occurrences] for r in search.report(spans, q, 0).collect()}
    cut = [tuple(o) for r in parts if r.ord == parts[-1].ord for o in r.occurrences]
    assert whole["common text 3"] == cut and cut[-1] == ("s/b", "d", "title") and len(whole) == 5
    assert search.report(spans.where(F.lit(False)), q, 2).count() == 0


def _coded(rows, size=64):
    """Blocks of (archive, span, text) rows, made a chunk a batch and merged."""
    batches = [pa.RecordBatch.from_pylist([dict(zip(("archive", "span_index", "text"), r, strict=True)) for r in part]) for part in rows]
    chunks = pa.Table.from_batches(b for batch in batches for b in index._staged(size)(iter([batch])))
    return chunks, list(index._blocks(size)(iter(chunks.sort_by([(c, "ascending") for c in ("fold", "term", "archive", "first_span")]).combine_chunks().to_batches())))


def test_what_is_decoded_at_once_is_bounded(monkeypatch):
    """A batch of long blocks gives many small ones, with the same places."""
    texts = [("s", k, "the cat " * 50 + f"w{k}") for k in range(300)]
    _, blocks = _coded([texts])
    want = [r for b in blocks for part in index._place_rows(iter([b])) for r in part.to_pylist()]
    monkeypatch.setattr(index, "DECODED", 1000)
    parts = [part for b in blocks for part in index._place_rows(iter([b]))]
    assert len(parts) > 5 and max(len(p.column("offsets").flatten()) for p in parts) <= 64 * 50
    assert [r for p in parts for r in p.to_pylist()] == want and len(want) == 900
    assert sum(p.num_rows for b in blocks for p in index._span_rows(iter([b]))) == 900


def test_terms_are_coded_before_they_are_shuffled():
    """A row for each term of a chunk, not of each span; chunks whose spans lie between each other's are merged to blocks in order."""
    texts = [("s", k, f"the cat {k % 3}") for k in range(200)]
    chunks, blocks = _coded([texts[::2], texts[1::2]])
    assert chunks.num_rows == 2 * (2 * 2 + 3)
    rows = [r for b in blocks for r in b.to_pylist() if r["term"] == "the"]
    assert [r["n_spans"] for r in rows] == [64, 64, 64, 8] and [index.decode_spans(r["spans"])[0] for r in rows] == [0, 64, 128, 192]


def test_sums_of_terms(spark):
    """Spans that are several rows, or have no number, count as distinct numbers do; places aren't rows on the way."""
    rows = [("s", "c", 1, "m", "a b a"), ("s", "c", 2, "m", "a é a"), ("s", "c", 2, "m", "b a"), ("s", "c", None, "m", "a"), ("s", "c", 3, "m", None)]
    got = {r.term: tuple(r)[1:] for r in index.term_sums(spark.createDataFrame(rows, SPANS)).collect()}
    assert got == {"a": ("a", 6, 2, 1, 4 + 5 + 2, 5), "b": ("b", 2, 2, 1, 2, 2), "é": ("é", 1, 1, 2, 2, 2)}
    plan = index.term_sums(spark.createDataFrame(rows[:2], SPANS))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
