"""The fixed results, against brute force in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF, make

from palimpsest.llm import bpe, imatch, line_dedup, minhash, quality_rules, suffix_dedup
from palimpsest.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """Brute force: doc_id -> component, rows with one doc_id being one document."""
    sets, parent = [(i, shingles(t)) for i, t in rows if i is not None], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in sets}


def table(spark, name):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("real", [False, True])
def test_minhash_is_exact(spark, corpus, real):
    rows = table(spark, "documents") if real else corpus
    got = minhash.near_duplicates(make(spark, rows), minhash.Params(block=3)).collect()
    want = components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t)), want[i], want[i] == i) for i, t in rows if i is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None) and len(got) == len(rows)


def test_minhash_settles_inside_buckets(spark):
    """A chain whose links aren't with the bucket's smallest node."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        words = list(base)
        for j in range(k + 1):
            words[7 * j] = f"v{j}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(spark, rows), minhash.Params(block=4)).collect()}
    assert got == components(rows)


def repeats(rows, length, of=bytes):
    where = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - length + 1):
            where[of(b[i : i + length])] += 1
    out = []
    for d, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if where[of(b[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((rows[d][0], len(b), sum(gone), spans, sha(kept)))
    return out


@pytest.mark.parametrize("most,length,gram", [(32_768, 400, 64), (2, 400, 64), (32_768, 60, 16), (3, 60, 16)])
def test_suffix_dedup_is_exact(spark, corpus, most, length, gram):
    got = suffix_dedup.remove_repeats(make(spark, corpus), length, gram, most).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got), key=lambda x: str(x)) == sorted(repeats(corpus, length), key=lambda x: str(x)), key


@pytest.mark.parametrize("most", [32_768, 2])
def test_suffix_dedup_of_short_periods(spark, most):
    """A short line again and again, over about 400 bytes: one place is seen from several anchors."""
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = []
    for k, (period, size) in enumerate([(39, 429), (39, 400), (39, 438), (39, 439), (39, 440), (20, 415), (100, 430), (130, 520), (7, 403)]):
        line = say(period - 1) + "\n"
        rows.append((k, say(500) + (line * 30)[:size] + say(569)))
    got = suffix_dedup.remove_repeats(make(spark, rows), most=most).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got) == sorted(repeats(rows, 400))


def test_suffix_dedup_of_whole_characters(spark):
    """Cuts inside code points take the code point with them; a replacement character stays."""
    r = random.Random(3)
    shared = "".join(r.choice("éßñ€") for _ in range(300))
    rows = [(k, chr(0xE0 + k) + "\ufffd" + shared[k:] + chr(0x100 + k) + "end") for k in range(4)]
    got = {x.doc_id: bytes(x.kept).decode() for x in suffix_dedup.remove_repeats(make(spark, rows), characters=True).collect()}
    for k, t in rows:
        assert "\ufffd" in got[k] and len(got[k]) < 20 and all(c in t for c in got[k])


def test_shared_grams_of_short_passages(spark):
    """A passage of 300 bytes in two documents is told of and stays; the others share nothing."""
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = say(300)
    rows = [(1, say(800) + shared + say(90)), (2, shared + say(500)), (3, say(1500)), (4, None), (5, ""), (6, shared[:100])]
    got = {x.doc_id: (x.n_shared > 0, x.n_removed) for x in suffix_dedup.remove_repeats(make(spark, rows), passage=288).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (False, 0)}


@pytest.mark.parametrize("most", [32_768, 2])
def test_suffix_dedup_of_runs(spark, most):
    """Between random words, runs of every short period, some bytes under and over the length."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    say = lambda: " ".join(word() for _ in range(100))
    rows = [(k, f"{say()} {(word() * 9)[:period] * 400}"[: 700 + size] + " " + say()) for k, (period, size) in enumerate((p, n) for p in (1, 2, 3, 5, 8, 13, 24) for n in range(-300, 60, 30))]
    rows.append((1000, say() + " " + "teteber " * 50 + say()))
    got = suffix_dedup.remove_repeats(make(spark, rows), most=most).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got) == sorted(repeats(rows, 400))
    assert [r.n_removed for r in got if r.doc_id == 1000] == [0]


def test_suffix_dedup_real(spark):
    """All of sf0.01; strings by their 64-bit hashes in the brute force, for its memory."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got) == sorted(repeats(rows, 400, hash))


@pytest.mark.parametrize("slab", [7, 10**6])
def test_surroundings_against_plain_search(slab):
    """Groups of surroundings with few letters: what repeats in another of the group, at one distance from the anchor."""
    r = random.Random(1)
    for _ in range(100):
        groups = []
        for _ in range(r.randint(1, 5)):
            core, base = bytes(r.choice(b"ab") for _ in range(4)), bytes(r.choice(b"abc") for _ in range(30))
            own = set()
            for _ in range(r.randint(2, 9)):
                full, n = bytearray(base), r.randint(0, 8)
                full[r.randint(0, 29)] = r.choice(b"abcd")
                own.add((bytes(full[8 - n : 8]) + core + bytes(full[8 : 8 + r.randint(8, 18)]), n))
            groups.append(sorted(own))
        flat = [x for g in groups for x in g]
        who, at = suffix_dedup._Surroundings([t for t, _ in flat], [n for _, n in flat], [len(g) for g in groups]).repeated(12, slab)
        want = [[n - a for a in range(n, -1, -1) if len(t) >= n - a + 12 and any(o is not x and o[1] >= a and o[0][o[1] - a : o[1] - a + 12] == t[n - a : n - a + 12] for o in g)] for g in groups for x in g for t, n in [x]]
        assert list(zip(who.tolist(), at.tolist(), strict=True)) == [(k, x) for k, own in enumerate(want) for x in own]


def test_bpe_matches_the_library(spark, corpus):
    from tokenizers import Tokenizer

    odd = ["ΑΣ Σ İstanbul ǅ é ﬁ  x\u0085y\u001cz​ 　 I'LL don't 1234 ½ ٣", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> <|endoftext|>", "aaaaaaaaaaaaaaaaa !!!!!!!! \U0001f600\U0001f600", "".join(map(chr, range(1, 0x500)))]
    rows = [*table(spark, "documents"), *corpus, *((10_000 + k, t) for k, t in enumerate(odd))]
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(tok.decode(ids, skip_special_tokens=False))))
    enc = bpe.encode(make(spark, rows), tokenizer_path())
    got = [tuple(r) for r in bpe.digests(enc).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    again = {(r.doc_id, sha(r.decoded)) for r in bpe.decode(enc, tokenizer_path()).collect()}
    assert again == {(i, d) for i, _, _, d in want}


def test_bpe_forgets_when_full(spark):
    small = bpe.WordBpe(tokenizer_path(), max_words=5)
    big = bpe.WordBpe(tokenizer_path())
    texts = ["one two three four five six", "seven eight nine <|endoftext|> ten one", "two eleven"]
    assert list(small.encode_batch(texts[:1])) + list(small.encode_batch(texts[1:])) == list(big.encode_batch(texts))


def brute_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(windows)
    hit = {k for i, w in enumerate(windows) if c[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("real", [False, True])
def test_quality_statistics(spark, corpus, real):
    rows = table(spark, "documents") if real else [*corpus, (1000, "a b c a b c"), (1001, "a a a"), (1002, "a a a a"), (1003, "x # $$ | <b>\nx\n \nx\r\nx")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.quality_rules(make(spark, rows), labels).collect()
    want = [(i, *brute_stats(t)) for i, t in rows]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("real", [False, True])
def test_fingerprint_rows(spark, corpus, real):
    rows = table(spark, "documents") if real else [x for x in corpus if x[0] not in (903, 10, None)]
    got = imatch.fingerprints(make(spark, rows)).collect()
    down = sorted(rows, key=lambda x: -x[0])
    want = {}
    for k, (i, t) in enumerate(down):
        t, nxt = t or "", down[(k + 1) % len(down)][1] or ""
        want[i] = (len(t), sha(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]))
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    prints = defaultdict(set)
    for r in got:
        prints[dict(rows)[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    if real:
        assert sum(r.near_edited > r.near_next for r in got) > 0.8 * len(got)


def test_fingerprint_buckets_and_ties(spark, corpus):
    docs = make(spark, corpus).select("doc_id", "text")
    few = sorted(map(str, imatch.with_next(docs, per_bucket=7).where("own = 1").select("doc_id", "text", "next_text").collect()))
    one = sorted(map(str, imatch.with_next(docs, per_bucket=10**6).where("own = 1").select("doc_id", "text", "next_text").collect()))
    assert few == one and len(few) == len(corpus)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(spark, rows, least=16):
    keyed = {(r.doc_id, r.rid): r.text for r in make(spark, rows).selectExpr("doc_id", "text", "xxhash64(doc_id, text) as rid").collect()}
    seen, out = [], {}
    for k in sorted(keyed, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        kept = []
        for line in (keyed[k] or "").split("\n"):
            if not WORD.search(line):
                kept.append(line)
                continue
            if not any(line == s or (len(line) >= least and len(s) >= least and distance_one(line, s)) for s in seen):
                kept.append(line)
            seen.append(line)
        out[k] = None if keyed[k] is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("most", [64, 1])
def test_line_dedup(spark, corpus, most):
    base = "the quick brown fox jumps over it"
    rows = [*corpus[:120], *((2000 + k, base[:k] + "#" + base[k:]) for k in range(0, 30, 3)), *((2100 + k, base[:k] + "#" + base[k + 1 :]) for k in range(0, 30, 3)), (2200, base), (2201, base + "\n\n" + base[:-1]), (2203, base[1:]), (2204, "short"), (2205, "shorx\nshort")]
    want = brute_lines(spark, rows)
    got = line_dedup.dedup_lines(make(spark, rows), most=most).collect()
    assert {(r.doc_id, r.rid): r.text for r in got} == want and len(got) == len(rows)


def test_empty_tables(spark):
    none = make(spark, [])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert bpe.encode(none, tokenizer_path()).count() == 0
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert imatch.fingerprints(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
