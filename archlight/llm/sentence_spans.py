"""Substring dedup by sliding sentence spans.

Sentences end after stops that white space follows and at line ends. A sentence of more than ``WINDOW`` words is cut
further, at words that the words alone choose: of every ``WINDOW`` neighbours inside the sentence a cut stands before
the one with the smallest hash, the first of equal ones. So cuts fall alike in every copy of a passage, whatever stands
before it and wherever in a sentence it begins, but for its first and last ``WINDOW`` - 1 words. Every run of ``SPAN``
consecutive pieces is hashed, however short they are. Any 51 words hold a whole run: a cut that all copies share lies in
the first 15, and a run from there has 24 words at most, 39 in all, before the last 7.

Runs are posted under 96 bits. A task sorts its own posts and sends on only the first occurrence of each run in some
hundred thousand of them; the others are not first anywhere and stay. So a run that very many documents hold meets in
one task only once for each such part. A run occurs *first* in the row with the smallest ``(k1, k2)`` and there at its
smallest place, where ``k1`` is the id (null: the smallest 64-bit number) and ``k2`` comes from the text's hash. All pieces that any other
occurrence of a repeated run covers are removed, each with the white space behind it.

Null text counts as empty and stays null. Rows that share an id are different documents, in the order of ``k2``; rows
that agree in id and text are one document and keep or lose the same. An empty table gives an empty result. A text may
be of any length. Other columns are ignored by ``find`` and ``report``; ``remove`` gives them back unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Recent, boxed, map_arrow

SPAN = 3
WINDOW = 8
#: Posts that a task sorts at once.
PART = 400_000
KNOWN_WORDS = 150_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
STOPS = np.frombuffer(b".!?", np.uint8)
BASES = [int(x) * 2 + 1 for x in np.random.default_rng(20_240_307).integers(1, 2**62, 2)]


#: Hashes of words, 16 bytes each.
KNOWN = Recent(KNOWN_WORDS, lambda word: hashlib.md5(word, usedforsecurity=False).digest())


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A text's words and the pieces they make: ``cuts`` are the words that pieces begin with, and the number of words."""

    def __init__(self, data: bytes) -> None:
        blank = BLANK[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        self.begin, stop = edge[::2], edge[1::2]
        n = len(self.begin)
        self.hashes = np.frombuffer(b"".join(map(KNOWN.__getitem__, data.split())), ">u8").reshape(-1, 2).astype(np.uint64)
        if not n:
            self.cuts = np.zeros(1, np.int64)
            return
        raw = np.frombuffer(data, np.uint8)
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        starts = np.ones(n, bool)
        starts[1:] = np.isin(raw[stop[:-1] - 1], STOPS) | (lines[self.begin[1:]] > lines[stop[:-1]])
        if n > WINDOW:
            sentence = np.cumsum(starts)
            view = np.lib.stride_tricks.sliding_window_view(self.hashes[:, 0], WINDOW)
            inside = np.flatnonzero(sentence[WINDOW - 1 :] == sentence[: n - WINDOW + 1])
            # a sentence of WINDOW words is one piece
            inside = inside[np.bincount(sentence)[sentence[inside]] > WINDOW]
            starts[inside + view[inside].argmin(axis=1)] = True
        self.cuts = np.append(np.flatnonzero(starts), n)

    def runs(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """First pieces of the runs and the pieces behind their last ones."""
        count = len(self.cuts) - 1
        if count < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.arange(count - span + 1)
        return first, first + span

    def digests(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Both halves of the runs' hashes."""
        a, b = self.cuts[first], self.cuts[end]
        room = 1 << max(12, len(self.hashes).bit_length())
        out = []
        for k, base in enumerate(BASES):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes[:, k] * powers(base, room)[: len(self.hashes)], dtype=np.uint64)))
            out.append(mix((sums[b] - sums[a]) * powers(pow(base, -1, 2**64), room)[a] + (b - a).astype(np.uint64)).view(np.int64))
        return out


def identity(docs: DataFrame, *more: str) -> DataFrame:
    """``k1, k2, text``: the order of rows, also of those with null and repeated ids."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k2 = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"), k2.alias("k2"), text.alias("text"), *more)


#: A run's first piece and its number of pieces in one number.
BITS = 10
POST = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("later", pa.bool_())])
POSTS = "h1 long, h2 int, k1 long, k2 long, at long, later boolean"
MARK = pa.schema([POST.field(k) for k in ("k1", "k2", "at")])


def not_first_here(columns: list[np.ndarray]) -> np.ndarray:
    """Which posts another place of their run stands before; rows that agree in id and text are one place."""
    by = np.argsort(columns[0], kind="stable")
    h = columns[0][by]
    twice = np.zeros(len(by), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[:-1] |= twice[1:]
    some = by[twice]
    some = some[np.lexsort([c[some] for c in columns[4::-1]])]
    h1, h2, *place = (c[some] for c in columns)
    same = np.zeros(len(some), bool)
    same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
    later = np.zeros(len(by), bool)
    for c in place:
        later[some] |= c != c[begin]
    return later


def posts(docs: DataFrame, span: int) -> DataFrame:
    """``h1, h2, k1, k2, at, later``: runs that are first in their part of a task; those that are not, as later, go by their document, not by their run."""

    def told(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        later = not_first_here(columns)
        columns[0][later] = mix((columns[2][later] ^ columns[3][later]).view(np.uint64)).view(np.int64)
        columns[1][later] = 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, later], POST)], schema=POST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            for k1, k2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                pieces = Pieces(text.encode())
                first, end = pieces.runs(span)
                if len(first):
                    h1, h2 = pieces.digests(first, end)
                    held.append([h1, (h2 >> 32).astype(np.int32), np.full(len(first), k1), np.full(len(first), k2), first << BITS | end - first])
                    size += len(first)
                if size >= PART:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return map_arrow(identity(docs).select("k1", "k2", "text"), work, POSTS)


def not_first(posted: DataFrame) -> DataFrame:
    """``k1, k2, at`` of the posts that are not the first of their run, by one shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        for part in batches:
            if not part.num_rows:
                continue
            columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            later = columns[5].copy()  # these come last
            n = int(len(later) - later.sum())
            if n:
                h1, h2 = columns[0][:n], columns[1][:n]
                new = np.ones(n, bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                if head is not None:
                    new[0] = (h1[0], h2[0]) != head[:2]
                begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                for c, own in zip(columns[2:5], head[2:] if head else (0, 0, 0)):
                    later[:n] |= c[:n] != np.where(begin < 0, own, c[np.maximum(begin, 0)])
                last = int(begin[-1])
                head = tuple(c[last] for c in columns[:5]) if last >= 0 else head
            yield pa.RecordBatch.from_arrays([pa.array(c[later], f.type) for c, f in zip(columns[2:5], MARK)], schema=MARK)

    dealt = posted.repartition("h1", "h2").sortWithinPartitions("later", "h1", "h2", "k1", "k2", "at")
    return map_arrow(dealt.select(*POST.names), work, "k1 long, k2 long, at long")


def find(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``k1, k2, gone``: for each document that loses pieces, the runs that cover them: first pieces and numbers of pieces."""
    return not_first(posts(docs, span)).groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))


def left_of(text: str, gone: np.ndarray) -> tuple[int, str]:
    """Pieces removed, and the text without them and the white space behind them."""
    data = text.encode()
    pieces = Pieces(data)
    change = np.zeros(len(pieces.cuts), np.int64)
    first = gone >> BITS
    np.add.at(change, first, 1)
    np.add.at(change, first + (gone & (1 << BITS) - 1), -1)
    out = np.cumsum(change[:-1]) > 0
    at = np.append(pieces.begin[pieces.cuts[:-1]], len(data))
    kept = [data[: at[0]], *(data[i:j] for i, j, x in zip(at[:-1].tolist(), at[1:].tolist(), out.tolist()) if not x)]
    return int(out.sum()), b"".join(kept).decode()


def applied(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``row, n_removed, removed_chars, cleaned`` for every row of the frame ``docs`` of ``row, doc_id, text``."""
    own = identity(docs, "row", F.col("text").isNull().alias("none"))
    joined = own.join(find(docs, span), ["k1", "k2"], "left")
    kind = dict(docs.dtypes)["row"]
    out = pa.schema([("n_removed", pa.int64()), ("removed_chars", pa.int64()), ("cleaned", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            gone = part.column(3)
            ends, values, any_ = gone.offsets.to_numpy(), gone.values.to_numpy(), gone.is_valid().to_numpy(zero_copy_only=False)
            rows = []
            for i, (text, none) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                lost, left = left_of(text, values[ends[i] : ends[i + 1]]) if any_[i] else (0, text)
                rows.append((lost, len(text) - len(left), None if none else left))
            told = list(zip(*rows)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(told, out))], names=["row", *out.names])

    return map_arrow(joined.select("row", "text", "none", "gone"), work, f"row {kind}, n_removed long, removed_chars long, cleaned string")


def remove(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """All columns of ``docs`` with repeated pieces removed from ``text`` and ``n_chars`` counted anew where there is one."""
    row = F.col("row")
    own = boxed(docs).select("row", row["doc_id"].alias("doc_id"), row["text"].alias("text"))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return applied(own, span).select(*(new.get(c, row[c]).alias(c) for c in docs.columns))


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_removed, removed_chars, text`` for every document; ``n_removed`` counts pieces."""
    own = docs.select(F.col("doc_id").cast("long").alias("row"), "doc_id", "text")
    return applied(own, span).select(F.col("row").alias("doc_id"), "n_removed", "removed_chars", F.col("cleaned").alias("text"))


SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, text, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)) AS r,
    dense_rank() OVER (ORDER BY doc_id NULLS FIRST, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT), coalesce(text, '')) AS o FROM documents
), g AS (
  SELECT r, o, regexp_extract_all(t, '{WORD}{SPACE}*') AS gs FROM d
), w AS (
  SELECT r, o, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS i FROM g
), s AS (
  SELECT *, regexp_extract(g, '{WORD}') AS word, CASE WHEN i = 0 OR regexp_matches(lag(g) OVER p, '[.!?]{SPACE}+$|\n') THEN 1 ELSE 0 END AS start FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
), n AS (
  SELECT *, sum(start) OVER (PARTITION BY r ORDER BY i) AS sentence FROM s
), k AS (
  SELECT *, count(*) OVER (PARTITION BY r, sentence) AS size, count(*) OVER b AS many, min(substr(md5(word), 1, 16) || lpad(i::VARCHAR, 9, '0')) OVER b AS low
  FROM n WINDOW b AS (PARTITION BY r, sentence ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), c AS (
  SELECT r, i FROM k WHERE start = 1 UNION SELECT r, substr(low, 17)::BIGINT FROM k WHERE many = {WINDOW} AND size > {WINDOW}
), p AS (
  SELECT r, i AS a, row_number() OVER v - 1 AS pos, count(*) OVER (PARTITION BY r) AS pieces, lead(i) OVER v AS b FROM c WINDOW v AS (PARTITION BY r ORDER BY i)
), q AS (
  SELECT p.r, g.o, a, pos, pieces, coalesce(b, len(gs)) AS b, array_to_string(gs[a + 1 : coalesce(b, len(gs))], '') AS piece, gs FROM p JOIN g USING (r)
), runs AS (
  SELECT x.r, x.o, x.pos, y.pos AS last, x.a, y.b, x.gs FROM q x JOIN q y ON x.r = y.r AND y.pos = x.pos + {SPAN - 1}
), h AS (
  SELECT *, array_to_string(list_transform(gs[a + 1 : b], lambda x: regexp_extract(x, '{WORD}')), ' ') AS run FROM runs
), z AS (
  SELECT r, pos, last, (o, pos) <> min((o, pos)) OVER (PARTITION BY run) AS later FROM h
), gone AS (
  SELECT DISTINCT q.r, q.pos FROM q JOIN z ON q.r = z.r AND later AND q.pos BETWEEN z.pos AND z.last
), kept AS (
  SELECT q.r, count(gone.pos) AS lost, string_agg(CASE WHEN gone.pos IS NULL THEN piece ELSE '' END, '' ORDER BY q.pos) AS rest FROM q LEFT JOIN gone USING (r, pos) GROUP BY q.r
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed,
  CAST(CASE WHEN lost > 0 THEN length(t) - length(regexp_extract(t, '^{SPACE}*')) - length(rest) ELSE 0 END AS BIGINT) AS removed_chars,
  CASE WHEN lost > 0 THEN regexp_extract(t, '^{SPACE}*') || rest ELSE text END AS text
FROM d LEFT JOIN kept USING (r)
"""
