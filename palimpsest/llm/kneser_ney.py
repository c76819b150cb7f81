"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Words that make a given share of a language's trusted tokens are its vocabulary, all others are one unknown word; so a
vocabulary has no more words than one divided by the share, whatever the corpus's size, and is sent to all tasks with
what is known of each word (its lowest-order probability, and the weight of its successors). The counts of word pairs
grow with the corpus. They stay in shards by a hash of language and pair, counted over all trusted documents but a
held-out tenth. Documents' distinct pairs, with their counts, are joined with the shards, and the losses of a
document's pairs are summed. A pair of any frequency is spread like others: its shard gets a document's pair once.
Thresholds are quantiles, by language, of the perplexity of the held-out trusted documents.

Rows that go to the shards hold the pairs of a batch of documents, sorted and compressed, not a pair each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mix, release

BOS, EOS, UNK = 0, 1, 2
_FIRST = 3
_BITS = 21  # of a word's number
_SHARDS = 8  # of a language, at least: small models are spread over tasks too


def _plain(word: str) -> str:
    """A word without one final full stop or comma, and without the capital of a sentence's first word."""
    if len(word) > 1 and word[-1] in ".,":
        word = word[:-1]
    return word.lower() if word[:1].isupper() and (len(word) == 1 or word[1:].islower()) else word


def _spellings(word: str) -> list[str]:
    first = word[:1].upper() + word[1:]
    return [x + end for x in ((word, first) if _plain(first) == word else (word,)) for end in ("", ".", ",") if _plain(x + end) == word]


# ---------------------------------------------------------------- blobs of pairs


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed; each in as few bytes an entry as its largest value needs."""
    parts = [len(arrays[0]).to_bytes(4, "little")]
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
        raw = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()  # byte by byte, which packs better
        body = pa.compress(raw, codec="zstd", asbytes=True)
        parts += [bytes([width]), len(body).to_bytes(4, "little"), body]
    return b"".join(parts)


def _unpack(data: bytes, n_arrays: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n_arrays):
        width, size = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
        raw = pa.decompress(data[at + 5 : at + 5 + size], decompressed_size=n * width, codec="zstd", asbytes=True)
        out.append(np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel().astype(np.int64))
        at += 5 + size
    return out


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its keys, which stay in order."""
    own = (mix(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    edge = np.searchsorted(own[order], np.arange(shards + 1))
    for k in range(shards):
        if edge[k] < edge[k + 1]:
            yield k, order[edge[k] : edge[k + 1]]


# ---------------------------------------------------------------- vocabulary


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw.setdefault(lang, Counter()).update(text.split())
        for lang, found in raw.items():
            own: Counter = Counter()
            for w, c in found.items():
                own[_plain(w)] += c
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "word", "c"])


class Vocabulary:
    """Words of each language in order of their numbers, their spellings, and how many words were left out."""

    def __init__(self, words: dict[str, list[str]], rare: dict[str, int], shards: dict[str, int]):
        self.words, self.rare, self.shards = words, rare, shards
        self._spelled: dict[str, dict[str, int]] = {}

    def __getstate__(self):
        return self.words, self.rare, self.shards

    def __setstate__(self, state):
        self.__init__(*state)

    def size(self, lang: str) -> int:
        return len(self.words[lang]) + _FIRST

    def ids(self, lang: str, text: str) -> np.ndarray:
        """BOS, the words' numbers, EOS."""
        if lang not in self._spelled:
            self._spelled[lang] = {x: i + _FIRST for i, w in enumerate(self.words[lang]) for x in _spellings(w)}
        get, words = self._spelled[lang].get, text.split()
        out = np.full(len(words) + 2, EOS, np.int64)
        out[0] = BOS
        out[1:-1] = [get(w, UNK) for w in words]
        return out


def vocabulary(trusted: DataFrame, share: float, least: int, per_shard: int) -> Vocabulary:
    """From the words of all trusted text. What is collected has at most 1 / share words a language."""
    counts = materialize(trusted.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    judged = counts.join(F.broadcast(totals), "lang").withColumn("known", F.col("c") >= F.greatest(F.lit(least).cast("double"), F.col("total") * share))
    words: dict[str, list[str]] = {}
    for batch in judged.where("known").select("lang", "word").orderBy("lang", "word").toArrow().to_batches():
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True):
            words.setdefault(lang, []).append(word)
    rare, shards = {}, {}
    for r in judged.groupBy("lang").agg(F.sum((~F.col("known")).cast("long")).alias("rare"), F.first("total").alias("total")).collect():
        if r["lang"] in words:
            rare[r["lang"]] = max(1, r["rare"])
            # a language has no more different pairs than tokens, and none beyond its vocabulary's square
            shards[r["lang"]] = max(_SHARDS, -(-min(r["total"], (len(words[r["lang"]]) + _FIRST) ** 2) // per_shard))
    release(counts)
    return Vocabulary(words, rare, shards)


# ---------------------------------------------------------------- counts of pairs


def _count_pairs(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            rows = []
            for lang in set(langs) & vocab.words.keys():
                seqs = [vocab.ids(lang, t) for own, t in zip(langs, texts, strict=True) if own == lang]
                keys, c = np.unique(np.concatenate([s[:-1] << _BITS | s[1:] for s in seqs]), return_counts=True)
                rows += [(lang, k, _pack(keys[at], c[at])) for k, at in _by_shard(keys, vocab.shards[lang])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "shard", "pairs"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of equal keys in sorted rows, streamed: one row at a time is held."""
    from itertools import groupby

    rows = ({n: batch.column(n)[i].as_py() for n in batch.schema.names} for batch in batches for i in range(batch.num_rows))
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, sorted."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    found, back = np.unique(k, return_inverse=True)
    return found, np.bincount(back, c, len(found)).astype(np.int64)


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (lang, shard), rows in _runs(batches, ("lang", "shard")):
        keys, counts, held = [], [], 0
        for r in rows:
            k, c = _unpack(r["pairs"], 2)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 4_000_000 and len(keys) > 1:  # as many as a shard's different pairs stay
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], 0
        k, c = _merge(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shard], pa.int32()), pa.array([_pack(k, c)], pa.binary())], names=["lang", "shard", "pairs"])


_STATS = pa.schema([("lang", pa.string()), ("id", pa.int32()), ("n", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("before", pa.int64()), ("c3", pa.int64()), ("c4", pa.int64())])


def _word_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of a shard: tokens that follow it, different followers by count 1, 2 and more, different words before
    it; and pairs of count 3 and 4 that begin with it."""
    for batch in batches:
        for row in batch.to_pylist():
            k, c = _unpack(row["pairs"], 2)
            v, w = k >> _BITS, k & (1 << _BITS) - 1
            size = int(max(v.max(), w.max())) + 1
            cols = [np.bincount(v, c, size), *(np.bincount(v[c == n], minlength=size) for n in (1, 2)), np.bincount(v[c > 2], minlength=size), np.bincount(w, minlength=size), *(np.bincount(v[c == n], minlength=size) for n in (3, 4))]
            at = np.flatnonzero((cols[0] > 0) | (cols[4] > 0))
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(at), pa.string()), pa.array(at, pa.int32()), *(pa.array(x[at].astype(np.int64)) for x in cols)], schema=_STATS)


def _discount(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The discounts of modified Kneser-Ney for counts 0, 1, 2 and more, from how many n-grams occur once to four times."""
    n1, n2, n3, n4 = (max(1, int(n)) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


class Language:
    """What is known of each word of a language: lowest-order probability, tokens that follow, weight of the lower order."""

    def __init__(self, size: int, rare: int, stats: dict[str, np.ndarray]):
        def full(name: str) -> np.ndarray:
            out = np.zeros(size)
            out[stats["id"]] = stats[name]
            return out

        n, n1, n2, n3 = (full(x) for x in ("n", "n1", "n2", "n3"))
        self.discount = _discount(n1.sum(), n2.sum(), stats["c3"].sum(), stats["c4"].sum())
        self.total = n
        self.weight = np.where(n > 0, (n1 * self.discount[1] + n2 * self.discount[2] + n3 * self.discount[3]) / np.maximum(n, 1), 1)
        before = full("before")
        low = _discount(*((before == k).sum() for k in (1, 2, 3, 4)))
        taken = low[np.minimum(before, 3).astype(int)]
        self.low = (before - taken) / max(1, before.sum()) + taken.sum() / max(1, before.sum()) / size
        self.low = np.maximum(self.low, 0.01 / size)
        self.rare = max(1, rare)

    def losses(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """-log P of each pair, from its count in the trusted text."""
        v, w = keys >> _BITS, keys & (1 << _BITS) - 1
        p = (counts - self.discount[np.minimum(counts, 3)]) / np.maximum(self.total[v], 1) + self.weight[v] * self.low[w]
        return -np.log(np.where(w == UNK, p / self.rare, p))  # an unknown word is one of as many as were left out


class Model:
    def __init__(self, vocab: Vocabulary, pairs: DataFrame, languages: dict[str, Language]):
        self.vocab, self.pairs, self.languages = vocab, pairs, languages


def train(trusted: DataFrame, share: float = 5e-6, least: int = 2, per_shard: int = 4_000_000) -> Model:
    """(lang, text) -> model. Rows without lang or text are left out; a language needs a word that is there ``least`` times.

    Pairs are written in shards of about ``per_shard`` different ones; what is collected has a row for each vocabulary word.
    """
    trusted = trusted.where("lang is not null and text is not null").select("lang", "text")
    vocab = vocabulary(trusted, share, least, per_shard)
    sent = trusted.sparkSession.sparkContext.broadcast(vocab)
    parts = trusted.mapInArrow(_count_pairs(sent), "lang string, shard int, pairs binary")
    pairs = materialize(parts.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(_merge_pairs, "lang string, shard int, pairs binary"), "pairs")
    sent.destroy()
    ddl = ", ".join(f"{f.name} {'string' if f.name == 'lang' else 'int' if f.name == 'id' else 'long'}" for f in _STATS)
    stats = pairs.mapInArrow(_word_stats, ddl).groupBy("lang", "id").agg(*(F.sum(c).alias(c) for c in _STATS.names[2:])).toArrow()
    langs = np.array(stats.column("lang").to_pylist(), object)
    columns = {c: stats.column(c).to_numpy() for c in _STATS.names[1:]}
    languages = {k: Language(vocab.size(k), vocab.rare[k], {c: x[langs == k] for c, x in columns.items()}) for k in vocab.words}
    return Model(vocab, pairs, languages)


# ---------------------------------------------------------------- losses of documents


def _ask(sent):
    """Of each batch of documents and shard: its pairs, the document of each, and how often it has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value[0]
        for b in batches:
            langs, texts, rids = b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("rid").to_numpy()
            rows = []
            for lang in set(langs) & vocab.words.keys():
                at, seqs, size = [], [], 0
                last = max(i for i, own in enumerate(langs) if own == lang)
                for i, own in enumerate(langs):
                    if own == lang:
                        at.append(i)
                        seqs.append(vocab.ids(lang, texts[i] or ""))
                        size += len(seqs[-1])
                        if size > 4_000_000 or len(seqs) == 1 << 16 or i == last:  # a document's number has 16 bits
                            doc = np.repeat(np.arange(len(seqs)), [len(s) - 1 for s in seqs])
                            keys = np.concatenate([s[:-1] << _BITS | s[1:] for s in seqs])
                            both, c = np.unique(keys << 16 | doc, return_counts=True)
                            keys, doc, own_rids = both >> 16, both & 0xFFFF, rids[at]
                            for k, x in _by_shard(keys, vocab.shards[lang]):
                                docs, local = np.unique(doc[x], return_inverse=True)
                                rows.append((lang, k, _pack(keys[x] >> _BITS, keys[x] & (1 << _BITS) - 1, local, c[x]), own_rids[docs].tobytes()))
                            at, seqs, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["lang", "shard", "pairs", "rids"])

    return run


_SUMS = pa.schema([("rid", pa.int64()), ("loss", pa.float64()), ("n", pa.int64())])


def _answer(sent):
    """The shard's counts come first (no rids), then what is asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value[1]
        for (lang, _), rows in _runs(batches, ("lang", "shard")):
            known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r in rows:
                if r["rids"] is None:
                    known, counts = _unpack(r["pairs"], 2)
                    continue
                v, w, doc, c = _unpack(r["pairs"], 4)
                keys, found = v << _BITS | w, np.zeros(len(v), np.int64)
                if len(known):
                    at = np.searchsorted(known, keys)
                    at[at == len(known)] = 0
                    found = np.where(known[at] == keys, counts[at], 0)
                rids = np.frombuffer(r["rids"], np.int64)
                loss = np.bincount(doc, languages[lang].losses(keys, found) * c, len(rids))
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(loss), pa.array(np.bincount(doc, c, len(rids)).astype(np.int64))], schema=_SUMS)

    return run


def losses(docs: DataFrame, model: Model, slices: int = 2) -> DataFrame:
    """(rid, lang, text) -> rid, n_tokens, loss for the rows whose language has a model: the sum of -log P.

    Rows with one rid are summed up. The documents are asked for in ``slices``, one after the other and all of them, so that
    only one slice's pairs are on disk.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.vocab, model.languages))
    done = []
    shards = model.pairs.select("lang", "shard", "pairs", F.lit(None).cast("binary").alias("rids"))
    for k in range(slices):
        own = docs.where(F.pmod(F.xxhash64(F.lit(11), "rid"), F.lit(slices)) == k)
        asked = own.where(F.col("lang").isin(*model.vocab.words)).select("rid", "lang", "text").mapInArrow(_ask(sent), "lang string, shard int, pairs binary, rids binary")
        met = asked.unionByName(shards).repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("rids").isNotNull())
        sums = met.mapInArrow(_answer(sent), "rid long, loss double, n long").groupBy("rid").agg(F.sum("loss").alias("loss"), (F.sum("n") - 1).alias("n_tokens"))
        done.append(materialize(sums, "losses"))
    sent.destroy()
    out = reduce(DataFrame.unionByName, done)
    out._slices = done
    return out


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, prior_tokens: float = 20.0, share: float = 5e-6, per_shard: int = 4_000_000, slices: int = 2) -> DataFrame:
    """(doc_id, lang, text, ...), (doc_id, quality, toxic, ...) -> doc_id, lang, n_tokens, perplexity, threshold, kept.

    Trusted are documents labelled quality 1 and toxic 0. A tenth of them, by a hash of the text, sets the thresholds, and
    all others train the model; equal texts are on one side. Perplexity is drawn to the language's mean as ``prior_tokens`` more
    tokens would, so that a short text isn't judged by a few words. A document is kept unless its perplexity is over
    the ``quantile`` of its language's held-out documents (of all its trusted ones, if none is held out). Documents whose language
    is null or has no trusted word twice have perplexity and threshold null and are kept. Null texts are empty. A row
    for each row of ``docs``; rows with one doc_id share a label, and equal rows have equal results. Other columns
    are ignored; without labels, or without rows, nothing is judged.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "lang", "text"))
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(10)) == 0
    # one shuffle of the texts, whatever the size; two passes read what it gives
    trusted = materialize(docs.select("doc_id", "lang", "text").where(~held).join(ids.hint("merge"), "doc_id", "left_semi").select("lang", "text"), "trusted")
    model = train(trusted, share, per_shard=per_shard)
    release(trusted)
    if not model.vocab.words:
        return docs.select("doc_id", "lang", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    sums = losses(docs, model, slices)
    release(model.pairs)
    known = F.col("lang").isin(*model.vocab.words)
    rows = docs.select("doc_id", "lang", "rid", held.alias("held"), F.when(~known, F.regexp_count("text", F.lit(r"\S+")).cast("long")).alias("n"))
    # equal rows have one rid, and their sums are as many times one's
    copies = rows.groupBy("rid").agg(F.count("*").alias("copies"))
    joined = rows.join(sums.join(copies, "rid"), "rid", "left").select("doc_id", "lang", "held", F.coalesce(((F.col("n_tokens") + 1) / F.col("copies") - 1).cast("long"), "n").alias("n_tokens"), (F.col("loss") / F.col("copies")).alias("loss"))
    scores = materialize(joined, "scores")
    release(*sums._slices)
    judged = scores.where("loss is not null").join(ids, "doc_id", "left_semi")
    mean = judged.groupBy("lang").agg((F.sum("loss") / F.sum(F.col("n_tokens") + 1)).alias("mean"))
    drawn = F.exp((F.col("loss") + prior_tokens * F.col("mean")) / (F.col("n_tokens") + 1 + prior_tokens))
    at = judged.join(F.broadcast(mean), "lang").withColumn("p", drawn)
    # a row for each language with a model
    limits = at.groupBy("lang").agg(F.coalesce(F.percentile_approx(F.when(F.col("held"), F.col("p")), quantile, 10_000), F.percentile_approx("p", quantile, 10_000)).alias("threshold"), F.first("mean").alias("mean"))
    out = scores.join(F.broadcast(limits), "lang", "left").select("doc_id", "lang", "n_tokens", drawn.alias("perplexity"), "threshold")
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns. Rows with one doc_id go if one of them is rejected."""
    bad = quality(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad_id"], "left_anti")
