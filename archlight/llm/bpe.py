"""Byte-level BPE by a pair occurrence index, and its decoding.

Texts are cut into words by the vocabulary's own pattern. The words of a block that are not known yet are laid end to
end in one symbol sequence; an index maps every adjacent pair that has a merge rank to all its positions. Active ranks
are taken in ascending order from a heap: all positions of the pair are merged from left to right, and the lists of
the pairs that appear beside them get the new positions. Words are independent of each other, so the lowest active
rank of the block is the next merge of every word that holds it. Encoded words are kept for the next blocks.

Null text counts as empty. Rows keep their multiplicity; ``doc_id`` may be null. A text may be of any length; equal pairs
that overlap are merged from the left. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Twice, batch, map_arrow, texts_of

#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker knows: met once lately, and more often.
FRESH_WORDS, KNOWN_WORDS = 200_000, 400_000
#: Bytes of texts that are encoded at once: their words, ids and decoded texts are held in Python.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        sign = byte_signs()
        back = {s: b for b, s in sign.items()}
        self.of_byte = [vocab[sign[b]] for b in range(256)]
        #: pair key -> (rank, merged token)
        self.merge = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = vocab | self.special
        self.bytes_of = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = name.encode() if name in self.special else bytes(back[c] for c in name)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.known = Twice(FRESH_WORDS, KNOWN_WORDS)  # word -> ids, little-endian unsigned 32-bit

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special strings stand alone."""
        if not self.cut or not any(s in text for s in self.special):
            return self.words.findall(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.words.findall(part))]

    def learn(self, new: list[str]) -> list[bytes]:
        """Ids of new words."""
        plain = [w for w in new if w not in self.special]
        found = dict(zip(plain, merge_all(plain, self.of_byte, self.merge))) | {w: np.array([i], "<u4").tobytes() for w, i in self.special.items()}
        return [found[w] for w in new]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        known = self.known.resolve(set().union(*cut), self.learn)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def merge_all(words: list[str], of_byte: list[int], merge: dict[int, tuple[int, int]]) -> list[bytes]:
    """Token ids of each word, as little-endian unsigned 32-bit integers, by the pair occurrence index over all of them."""
    if not words:
        return []
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) + 1 for d in data])
    first = np.array([*of_byte, -1], dtype=np.int64)
    raw = np.full(int(ends[-1]), 256, dtype=np.int64)  # 256 between words
    inside = np.ones(len(raw), dtype=bool)
    inside[ends - 1] = False
    raw[inside] = np.frombuffer(b"".join(data), np.uint8)
    start = first[raw]
    where, ranks = first_pairs(start, merge)
    sym: list[int] = start.tolist()
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap = list(ranks)
    heapq.heapify(heap)
    push, pop, get = heapq.heappush, heapq.heappop, merge.get
    while heap:
        key = ranks.pop(pop(heap))
        a, b, new = key >> 20, key & 0xFFFFF, merge[key][1]
        left = new << 20
        positions = where.pop(key)
        positions.sort()
        for p in positions:
            q = nxt[p]
            if sym[p] != a or sym[q] != b:
                continue  # one of the two has gone into another merge
            sym[p], sym[q] = new, -2
            after = nxt[p] = nxt[q]
            prv[after] = p
            x = sym[prv[p]]
            if x >= 0 and p:
                pair = x << 20 | new
                if pair in where:
                    where[pair].append(prv[p])
                elif (found := get(pair)) is not None:
                    where[pair] = [prv[p]]
                    ranks[found[0]] = pair
                    push(heap, found[0])
            x = sym[after]
            if x >= 0:
                pair = left | x
                if pair in where:
                    where[pair].append(p)
                elif (found := get(pair)) is not None:
                    where[pair] = [p]
                    ranks[found[0]] = pair
                    push(heap, found[0])
    last = np.array(sym, dtype=np.int64)
    kept = np.cumsum(last >= 0)[ends - 1]
    ids = last[last >= 0].astype("<u4").tobytes()
    kept = (kept * 4).tolist()
    return [ids[i:j] for i, j in zip([0, *kept], kept)]


def first_pairs(start: np.ndarray, merge: dict[int, tuple[int, int]]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """The index of the pairs of single bytes: pair -> positions, and rank -> pair."""
    at = np.flatnonzero((start[:-1] >= 0) & (start[1:] >= 0))
    keys = start[at] << 20 | start[at + 1]
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    where, ranks = {}, {}
    for i, j, key in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], keys[cuts].tolist()):
        if key in merge:
            where[key] = at[i:j].tolist()
            ranks[merge[key][0]] = key
    return where, ranks


def blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ids and texts in slices of rows with at most ``BLOCK`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > BLOCK:
            yield b.slice(start, k - start)
            start, held = k, 0
        held += n
    if len(sizes) > start:
        yield b.slice(start)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = pa.schema(fields + [("ids", pa.binary()), ("decoded", pa.string())] * keep_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(vocabulary_path)
        for b in (x for whole in batches for x in blocks(whole)):
            found = vocabulary.encode_batch(texts_of(b.column(1)))
            texts = [vocabulary.decode(ids) for ids in found]
            raw = [ids.tobytes() for ids in found]
            yield batch(
                out,
                {
                    "doc_id": b.column(0),
                    "n_tokens": [len(ids) for ids in found],
                    "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                    "ids": raw,
                    "decoded": texts,
                },
            )

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, SCHEMA + ", ids binary, decoded string" * keep_ids)
