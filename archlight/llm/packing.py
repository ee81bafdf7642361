"""Packing of token sequences: sum-of-squares bin packing of document pieces.

Documents are tokenised, closed by id 0 and cut into pieces only where longer than a sequence. Full pieces fill a
sequence each. The others are dealt into groups of about ``GROUP`` pieces by a hash, so that no task takes more as the
input grows, and every group is packed by the sum-of-squares rule: a piece goes where the sum, over all residual gaps,
of the squared number of open bins with that gap becomes smallest; a new bin is one of the choices. Pieces of a group
come longest first, ties by document and piece.

White space never belongs to a token of the vocabulary, so ids are kept per run of other characters and only new runs
are given to the library, without the stops and commas at their end. Null text counts as empty (one piece with id 0). A
text may be of any length. Repeated rows each get their own pieces; between gaps of equal cost the smallest is taken, a
used bin before a new one. Documents with null ids are packed as well. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Twice, batch, map_arrow, settle, texts_of

CAPACITY = 2048
END = 0
#: Pieces to a packing group.
GROUP = 16_384
#: Runs that a Python worker knows: met once lately, and more often.
FRESH_RUNS, KNOWN_RUNS = 200_000, 400_000
#: The vocabulary writes lower case only; its special strings, which are told by this beginning, are matched before.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPECIAL = b"<|"
PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


class Runs:
    """Ids of white-space separated runs, by the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known = Twice(FRESH_RUNS, KNOWN_RUNS)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        cut = [(r if SPECIAL in r else r.translate(LOWER)).split() for r in raw]
        known = self.known.resolve(set().union(*cut), self.learn)
        return [b"".join(map(known.__getitem__, runs)) for runs in cut]

    def learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of new runs. Stops and commas behind a letter or digit are a word of their own, so a run with and without them shares its ids."""
        bodies = [b if b and b[-1] in PLAIN else r for r in new for b in (r.rstrip(b".,"),)]
        asked = list({*bodies, *(r[len(b) :] for r, b in zip(new, bodies) if len(b) < len(r))})
        found: dict[bytes, bytes] = {}
        letters = [r for r in asked if r.decode().isalpha()]
        for part in parts_of(letters):
            found.update(self.together(part))
        for part in parts_of([r for r in asked if r not in found]):
            found.update((r, np.array(e.ids, "<u4").tobytes()) for r, e in zip(part, self.library.encode_batch_fast([r.decode() for r in part], add_special_tokens=False)))
        return [found[b] + found[r[len(b) :]] if len(b) < len(r) else found[r] for r, b in zip(new, bodies)]


    def together(self, letters: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs of letters by one call for all; nothing if the library makes more words of them than there are."""
        told = self.library.encode(b" ".join(letters).decode(), add_special_tokens=False)
        ids, word = np.array(told.ids, "<u4"), np.array(told.word_ids)
        ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(ids))
        if len(ends) != len(letters):
            return {}
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return dict(zip(letters, (raw[i:j] for i, j in zip([0, *ends], ends))))


def parts_of(runs: list[bytes], size: int = 4096) -> Iterator[list[bytes]]:
    return (runs[i : i + size] for i in range(0, len(runs), size))


@lru_cache(maxsize=2)
def load(path: str) -> Runs:
    return Runs(path)


def cut_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, copy``; copy tells rows apart that agree in all else."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("copy", pa.int64())])
    end = np.array([END], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        runs, seen = load(vocabulary_path), 0
        for b in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), runs.encode_batch(texts_of(b.column(1)))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), seen))
                    seen += 1
            yield batch(out, dict(zip(out.names, zip(*rows))) if rows else {k: [] for k in out.names})

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length, taken in the given order."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full and empty bins do not count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # the change of the sum of squares if the piece goes to gap h: the count at h falls, that at h - size grows
        gaps = open_bins[size:capacity]
        change = np.where(gaps > 0, 2 * (open_bins[: capacity - size] - gaps + 1), np.iinfo(np.int64).max)
        if len(change) and gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]  # a bin that becomes full is no longer counted
        best = int(change.argmin()) if len(change) else 0
        fresh = 2 * int(open_bins[capacity - size]) + 1 if size < capacity else 0
        if len(change) and change[best] <= fresh and gaps[best] > 0:
            gap = size + best
            bin_ = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, bin_, used = capacity, used, used + 1
        bins[i], offsets[i] = bin_, capacity - gap
        rest = gap - size
        if rest:
            stacks[rest].append(bin_)
            open_bins[rest] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to cut pieces. ``pieces`` is read several times and should be settled."""
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    groups = max(1, -(-n // group))
    dealt = short.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = sum_of_squares(part["length"].to_numpy(), capacity)
        # numbers of different groups interleave, so none can meet
        return part.assign(sequence_id=bins * groups + part["bin_group"], offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    packed = dealt.groupBy("bin_group").applyInPandas(work, schema)
    # a full piece is its own sequence, with a negative number that its partition and place in it give
    full = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    return pack(settle(cut_pieces(docs, vocabulary_path, capacity), "pieces"), capacity, group)
