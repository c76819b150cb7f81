"""Byte-pair encoding and decoding with a tokenizer file, merged in batched numpy rounds.

The words of a batch that aren't known yet lie behind each other in one flat array of symbols. A round looks up the
rank of each pair whose symbols changed, by binary search over the sorted pair keys, finds the lowest rank of each
word, merges all its places at once and closes the gaps. It ends when no word has a pair with a rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = np.iinfo(np.int32).max


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(own))
    return [table[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC and lower case, a split pattern, byte level, merges with a word-end mark."""

    def __init__(self, path: str, max_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path} isn't a tokenizer of the word-end kind")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = np.int64(max(self.names) + 1)
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.known: dict[str, tuple[bytes, str]] = {}
        self.max_words = max_words

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words in one array, and where each word starts (and the last one ends)."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank = np.full(len(sym), _NONE, np.int32)  # of a symbol and the next of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            idle = np.repeat(least == _NONE, sizes)
            if idle.any():
                done_sym.append(sym[idle])
                done_word.append(word[idle])
                go = ~idle
                sym, word, rank = sym[go], word[go], rank[go]
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run of one symbol: every second place, from its left
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))
                begin = at[np.concatenate(([True], np.diff(at) != 1))]
                at = at[(at - begin[run - 1]) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            dirty = np.zeros(len(sym), bool)
            dirty[at] = True
            sym, word, rank, dirty = sym[keep], word[keep], rank[keep], dirty[keep]
            dirty[:-1] |= dirty[1:]
            look = np.flatnonzero(dirty)
            rank[look] = _NONE
            look = look[look + 1 < len(sym)]
            look = look[word[look] == word[look + 1]]
            rank[look] = self.rank(sym[look], sym[look + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.max_words:
            self.known.clear()
            new = list(words)
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            sym, at = self.merge([w.encode() for w in part])
            raw, ids, bounds, names = sym.astype("<u4").tobytes(), sym.tolist(), at.tolist(), self.names
            for i, w in enumerate(part):
                b, e = bounds[i], bounds[i + 1]
                self.known[w] = raw[4 * b : 4 * e], " ".join([names[x] for x in ids[b:e]])

    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens among them as they are."""
        if self.specials and self.specials.search(text):
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letter by letter: no special form at a word's end
            text = text.replace("Σ", "σ")
        return self.words(text.lower())

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text: ids as little-endian 32-bit integers, and the decoded text."""
        for name, i in self.special.items():
            self.known.setdefault(name, (i.to_bytes(4, "little"), name))
        at = 0
        while at < len(texts):
            pieces, words, size = [], set(), 0
            while at < len(texts) and size < 4_000_000:
                pieces.append(self.pieces(texts[at]))
                words.update(pieces[-1])
                size += len(texts[at])
                at += 1
            self.learn(words - self.special.keys())
            for name, i in self.special.items():
                self.known.setdefault(name, (i.to_bytes(4, "little"), name))
            known = self.known
            for own in pieces:
                got = [known[w] for w in own]
                yield b"".join([x[0] for x in got]), " ".join([x[1] for x in got])


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded: a row for each row.

    Ids are those of the tokenizer file without added special tokens; the strings of special tokens in a text give
    their ids. ``decoded`` is the tokens' decoded form, special tokens included. Null texts are empty and give no ids.
    Other columns are ignored, whatever their names. The file must be readable at ``path`` on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):  # bounded output batches
                end, size = at, 0
                while end < len(texts) and size < 8_000_000:
                    size += len(texts[end])
                    end += 1
                got = list(bpe.encode_batch(texts[at:end]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, end - at), pa.array([len(x[0]) // 4 for x in got], pa.int64()), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at = end

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, decoded: ids as :func:`encode` gives them, back to the tokens' text. Null: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tokenizer(path).names
        for batch in batches:
            text = [" ".join([names[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
