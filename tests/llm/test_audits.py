"""Merkle manifest, source divergence and SimHash, against brute force in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import SF

from palimpsest.llm import divergence, manifest, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, hash string, fp long, a string, value long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows(corpus):
    """The shared corpus with languages and sources: a hot one, null ones, empty ones, and rows twice."""
    r = random.Random(3)
    sources = ["hot", "hot", "hot", "a", "b", "Ä", "z", "", None]
    out = [(i, t, r.choice(["en", "en", "fr", "", None]), r.choice(sources), r.choice([None, 0, len(t or "")])) for i, t in corpus]
    out += [(5000 + k, "common words in many documents " * 3 + f"own{k % 7} Ünï {'rare ' * (k % 5)}", r.choice(["en", "fr"]), r.choice(sources), k) for k in range(60)]
    return out + [out[5], out[5], (None, None, None, None, None), (6000, "alone", "xx", "only", 5)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 2, "x", 3) for r in rows], SCHEMA)


def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


# ---------------------------------------------------------------- op11


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def tree(level):
    """The root, and for each leaf the siblings before and after it, level by level."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            first = p // 3 * 3
            ways[k].append((level[first:p], level[p + 1 : first + 3]))
        level, at = [h(*level[k : k + 3]) for k in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], ways


def merkle(rows):
    by, out = defaultdict(list), []
    for i, text, lang, source, n in rows:
        shown = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        by[source].append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, n, shown)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    for s, top in zip(names, tops, strict=True):
        for (known, i, own, shown), way in zip(sorted(by[s]), trees[s][1], strict=True):
            steps, now = way + top, shown
            for before, after in steps:
                now = h(*before, now, *after)
            out.append((i if known else None, own, trees[s][0], root, h(*(x for b, a in steps for x in b + a)), now, now == root))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x) for x in r)


def merkle_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=key)


@pytest.mark.parametrize("given", ["made", "real", "large"])
def test_manifest(spark, rows, given):
    rows = {"made": lambda: rows, "real": lambda: real(spark), "large": lambda: [(k, f"line\n{k}" if k % 3 else "x", "en", "hot" if k % 4 else f"s{k % 40:02}", k) for k in range(2600)]}[given]()
    got = merkle_rows(manifest.manifest(table(spark, rows).repartition(5), seen=manifest.tampered_text()))
    assert got == sorted(merkle(rows), key=key)
    assert any(r[6] for r in got) and (given == "made" or not all(r[6] for r in got))


def test_manifest_does_not_depend_on_partitions_or_splits(spark, rows):
    """Small splits cut neighbours apart on every level."""
    rows = [(k, f"text {k}", "en", "one" if k < 900 else "two", k) for k in range(1000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle_rows(manifest.manifest(table(spark, rows).repartition(13)))
    finally:
        for k, v in zip(("files.maxPartitionBytes", "files.openCostInBytes", "adaptive.coalescePartitions.enabled"), before, strict=True):
            spark.conf.set(f"spark.sql.{k}", v)
    assert {r[:5] for r in got} == {r[:5] for r in merkle(rows)} and all(r[6] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_manifests(spark, n):
    rows = [(k, "t", None, "s", None) for k in range(n)]
    assert merkle_rows(manifest.manifest(table(spark, rows))) == merkle(rows) if n else not manifest.manifest(table(spark, rows)).count()


# ---------------------------------------------------------------- op12


def diverge(rows, least=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, count, groups = Counter(), Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall(low(text))
        df.update({(lang, t) for t in found})
        count.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        mine = sorted(s for x, s in groups if x == lang)

        def shares(of, kept=kept):
            total = sum(of.values())
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        counts = {s: {t: count[lang, s, t] for t in kept} for s in mine}
        p = {s: shares(counts[s]) for s in mine}
        q = shares({t: sum(counts[s][t] for s in mine) for t in kept})
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in mine:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pair, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("given", ["made", "real", "none"])
def test_divergence(spark, rows, given):
    rows = {"made": rows, "real": real(spark), "none": []}[given]
    got = divergence.audit(table(spark, rows).repartition(4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == diverge(rows)


def test_divergence_counts_beyond_a_long_product(spark):
    from pyspark.sql import functions as F

    cases = [(9_223_372_034, 9_999_999_999_999, 7), (4_000_000_000_000_000_000, 4_100_000_000_000_000_000, 10_000_000), (0, 5, 3)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    text = ("Wörter und ÄMTER, " * 400 + "a-b").encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "_CHUNK", 100)
    assert divergence.term_counts(text) == whole and whole["wörter".encode()] == 400 and whole["ÄMTER".lower().replace("ä", "Ä").encode()] == 400


# ---------------------------------------------------------------- op13


def simprint(text):
    words = WORD.findall(low(text))
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def classes(values, radius=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def simhashed(rows):
    prints = [(i, simprint(t)) for i, t, *_ in rows]
    of, least = classes({v for _, v in prints}), {}
    for i, v in prints:
        if i is not None:
            least[of[v]] = min(i, least.get(of[v], i))
    return sorted(((i, f"{v:016x}", least.get(of[v])) for i, v in prints), key=key)


@pytest.mark.parametrize("given", ["made", "real", "none"])
def test_simhash(spark, rows, given):
    rows = {"made": rows, "real": real(spark), "none": []}[given]
    got = simhash.near_duplicates(table(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=key) == simhashed(rows)


def test_spark_hashes_alike(spark):
    """The fixed seed is that of Spark's own function."""
    texts = ["a b c d", "ünï", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) as h").collect()
    assert [r.h % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    text = " ".join(f"Word{k % 37}" for k in range(900))
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text.encode(), simhash.Params()) == simprint(text)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_masks_cover_every_pair(k):
    """Any four differing bits are left out by some mask."""
    masks = simhash.mask_set(4, k)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 34 for m in masks)
    left = np.array([[not m >> b & 1 for b in range(64)] for m in masks])
    for a, b in combinations(range(64), 2):
        two = left[:, a] & left[:, b]
        pairs = left[two].astype(int)
        assert (pairs.T @ pairs > 0).all()


def test_free_bits_have_a_bound():
    """After four sets a bucket has at most 2 ** 12 nodes, whatever the data."""
    free = [~m & (2**64 - 1) for m in simhash.mask_set(4, 0)]
    for k in (1, 2, 3):
        free = {f & ~m for f in free for m in simhash.mask_set(4, k)}
    assert max(f.bit_count() for f in free) <= 12


@pytest.mark.parametrize("most", [2, 5, 4096])
def test_links_join_what_all_pairs_join(spark, most):
    """Clusters, chains and strangers; small buckets make all sets of masks deal anew."""
    r = random.Random(most)
    values = {0, 2**64 - 1}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            if r.random() < 0.3:
                x = r.getrandbits(64)
    values |= {r.getrandbits(64) for _ in range(100)}
    of = classes(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long").repartition(4)
    links = [(x.u % 2**64, x.v % 2**64) for x in simhash.near_links(nodes, simhash.Params(most=most)).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {v: v for v in values}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        parent[find(a)] = find(b)
    assert {frozenset(w for w in values if find(w) == find(v)) for v in values} == {frozenset(w for w in values if of[w] == of[v]) for v in values}
