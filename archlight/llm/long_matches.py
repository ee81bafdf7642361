"""Suffix-array dedup with a run-length index: removes every byte that a 200-byte string covers which starts elsewhere too.

1. *Anchors.* Of the ``GRAM``-byte strings in every window the one with the smallest hash is an anchor (winnowing), so
   equal windows have the same anchor at the same place. Anchors are counted over all documents; those that occur
   again go on, with the first place that holds them as their route. Whole copies are found by hashes of their texts:
   all of their bytes go, and one of them goes on for the sake of others.
2. *Cold anchors* (at most ``limit`` occurrences). The bytes that windows with the anchor can reach are sent to the
   route. Strings that overlap in a document are joined, so that no byte meets itself. Each block of strings gets
   a run-compressed Burrows-Wheeler transform. At run ends the text position and the length of the match with the
   neighbour in suffix order are sampled; between samples a match shortens by one with every byte, so one stream over
   the text gives the matching statistics of all positions. Windows of 200 bytes and more are marked.
3. *Hot anchors* would fill one block without bound, so the exact rest goes another way, by 128-bit hashes of their
   windows. The documents of an anchor are split into groups of about ``SPLIT``; a window that two documents of a group
   hold is repeated for all of them. What is single in its group is counted over the groups by an aggregation that gets
   one row of each group for a window, repeated or not, and then joined back. So a group's size is bounded, however many
   documents hold a window.

A route is a stretch of a document, told by a hash of its identity and place, so null and shared ids spread like others.

Null text counts as empty and loses nothing; so do texts under 200 bytes. Rows agreeing in id and text are two
documents and lose everything from 200 bytes on; their anchors count once. Rows that share only an id are different
documents. A null id keeps its row. A text may be of any length. An empty table gives an empty result. Other columns
are ignored by ``report`` and given back by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, boxed, forget, keyed, map_arrow, settle, unboxed

LENGTH = 200
GRAM = 100
HOT = 1024
#: Documents of a hot anchor to a group.
SPLIT = 4096
#: Bytes of a block of strings, unless a single route holds more.
BLOCK = 1 << 20

_drawn = np.random.default_rng(77_003_141)
VALUES = _drawn.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_drawn.integers(1, 2**63)) * 2 + 1
#: For the second half of a window's hash.
OTHER_VALUES = _drawn.integers(0, 2**64, 256, dtype=np.uint64)
OTHER_BASE = int(_drawn.integers(1, 2**63)) * 2 + 1
WIDE = np.dtype([("a", "<u8"), ("b", "<u8")])


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(data: bytes, values: np.ndarray = VALUES, base: int = BASE) -> np.ndarray:
    """Prefix sums of the bytes' values times the powers of the base."""
    room = 1 << max(12, len(data).bit_length())
    terms = values[np.frombuffer(data, np.uint8)] * powers(base, room)[: len(data)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))


def grams(prefix: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    n = len(prefix) - size
    room = 1 << max(12, (len(prefix) - 1).bit_length())
    return mix((prefix[size:] - prefix[:n]) * powers(pow(base, -1, 2**64), room)[:n])


def windows_of(data: bytes) -> np.ndarray:
    """Both halves of the hash of every window."""
    out = np.empty(len(data) - LENGTH + 1, WIDE)
    out["a"] = grams(sums(data), LENGTH)
    out["b"] = grams(sums(data, OTHER_VALUES, OTHER_BASE), LENGTH, OTHER_BASE)
    return out


def wide(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), WIDE)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The extreme of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def winnow(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, hashes of all grams, the smallest hash in every window, and the anchors' positions."""
    prefix = sums(data)
    h = grams(prefix, GRAM)
    width = LENGTH - GRAM + 1
    low = sliding(h, width, np.minimum)
    # a gram is an anchor if the largest minimum of the windows around it is its own hash
    edge = np.zeros(width - 1, np.uint64)
    high = sliding(np.concatenate((edge, low, edge)), width, np.maximum)
    return prefix, h, low, np.flatnonzero(high == h)


def anchors(keys: DataFrame) -> DataFrame:
    """``a, k1, k2, pos`` of every anchor of the texts in ``k1, k2, text``."""
    out = pa.schema([("a", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            found, counts = [], np.zeros(len(k1), np.int64)
            for i, text in enumerate(b.column(2).to_pylist()):
                data = text.encode()
                if len(data) < LENGTH:
                    continue
                _, h, _, at = winnow(data)
                found.append((h[at].view(np.int64), at.astype(np.int32)))
                counts[i] = len(at)
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            pos = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int32)
            yield batch(out, {"a": a, "k1": np.repeat(k1, counts), "k2": np.repeat(k2, counts), "pos": pos})

    return map_arrow(keys.select("k1", "k2", "text"), work, "a long, k1 long, k2 long, pos int")


def spans_of(starts: np.ndarray) -> np.ndarray:
    """Joined ``[from, to)`` spans of the windows that start at the given ascending positions."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + LENGTH)))
    return np.stack((starts[new], starts[np.append(new[1:], len(starts)) - 1] + LENGTH), axis=1)


def join_spans(spans: np.ndarray) -> np.ndarray:
    """Spans with those that touch or overlap joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > top[:-1])))
    return np.stack((spans[new, 0], top[np.append(new[1:], len(spans)) - 1]), axis=1)


def pieces(candidates: DataFrame, limit: int = HOT) -> DataFrame:
    """What goes to routes and to hot anchors: ``hot, r, sub, k1, k2, start, data``.

    Cold rows hold bytes of a document, hot ones hashes of its windows and, as ``start``, the number of the anchor's groups.
    """
    out = pa.schema([("hot", pa.bool_()), ("r", pa.int64()), ("sub", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("data", pa.binary())])

    share = SPLIT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, text, pos, a, n, route in zip(*(b.column(i).to_pylist() for i in range(7))):
                data = text.encode()
                p, first = np.unique(np.array(pos, np.int64), return_index=True)
                a, n, route = (np.array(x, np.int64)[first] for x in (a, n, route))
                cold = n <= limit
                for r in np.unique(route[cold]).tolist():
                    at = p[cold & (route == r)]
                    reach = np.stack((np.maximum(at - (LENGTH - GRAM), 0), np.minimum(at + LENGTH, len(data))), axis=1)
                    rows += [(False, r, 0, k1, k2, i, data[i:j]) for i, j in join_spans(reach).tolist()]
                if not cold.all():
                    _, h, low, _ = winnow(data)
                    windows = windows_of(data)
                    for key in np.unique(a[~cold]).tolist():
                        own = p[a == key]
                        # a window that holds its anchor twice is one window
                        mine = np.unique(np.concatenate([np.flatnonzero(low[max(0, at - (LENGTH - GRAM)) : at + 1] == h[at]) + max(0, at - (LENGTH - GRAM)) for at in own.tolist()]))
                        of = -(-int(n[a == key][0]) // share)
                        sub = int(mix(np.array([k1, k2], np.int64).view(np.uint64)).sum() % np.uint64(of))
                        rows.append((True, key, sub, k1, k2, of, windows[mine].tobytes()))
            yield batch(out, dict(zip(out.names, zip(*rows))) if rows else {k: [] for k in out.names})

    return map_arrow(candidates.select("k1", "k2", "text", "pos", "a", "n", "route"), work, "hot boolean, r long, sub int, k1 long, k2 long, start long, data binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal leading columns together, from batches in that order."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def recount(hot: DataFrame) -> DataFrame:
    """``k1, k2, data``: for each document the hashes of its windows at hot anchors that occur again."""
    counted = settle(counted_in_groups(hot), "counted")
    single = counted.where("data is null")
    again = settle(single.groupBy("a", "b").agg(F.sum(F.when(F.col("repeated"), 2).otherwise(1)).alias("n")).where("n > 1").select("a", "b"), "windows")
    # written, so that the join meets two fresh sides
    met = single.where("not repeated").join(again, ["a", "b"]).select("k1", "k2", "a", "b")
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.empty(b.num_rows, WIDE)
            h["a"], h["b"] = (b.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            raw, size = h.tobytes(), WIDE.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], schema=out)

    return counted.where("data is not null").select("k1", "k2", "data").unionByName(map_arrow(met, packed, "k1 long, k2 long, data binary"))


def counted_in_groups(hot: DataFrame) -> DataFrame:
    """``k1, k2, data, a, b, repeated``: windows that a group of documents repeats, by document, and rows without ``data`` for other groups.

    Where an anchor has several groups, the latter are one row for each window of a group: of its document if it is
    single there, else marked as repeated.
    """
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("repeated", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            h = wide([row[5] for row in group])
            by = np.lexsort((h["b"], h["a"]))
            equal = h[by][1:] == h[by][:-1]
            hit = np.zeros(len(h), bool)
            hit[by[1:]] |= equal
            hit[by[:-1]] |= equal
            ends = np.cumsum([len(row[5]) // WIDE.itemsize for row in group])
            found = [(row[2], row[3], np.unique(h[i:j][hit[i:j]]).tobytes()) for row, i, j in zip(group, [0, *ends[:-1]], ends) if hit[i:j].any()]
            none = [None] * len(found)
            columns = [*(list(c) for c in (zip(*found) if found else ([], [], []))), none, none, none]
            if group[0][4] > 1:
                owner = np.searchsorted(ends, np.flatnonzero(~hit), side="right")
                first = by[np.concatenate(([True], ~equal))]  # one of each window
                twice = first[hit[first]]
                k1, k2 = (np.array([row[i] for row in group], np.int64) for i in (2, 3))
                one, rows = h[~hit], len(owner) + len(twice)
                more = [[*k1[owner].tolist(), *[None] * len(twice)], [*k2[owner].tolist(), *[None] * len(twice)], [None] * rows]
                more += [[*one[c].view(np.int64).tolist(), *h[twice][c].view(np.int64).tolist()] for c in ("a", "b")] + [[False] * len(owner) + [True] * len(twice)]
                columns = [x + y for x, y in zip(columns, more)]
            yield batch(out, dict(zip(out.names, columns)))

    dealt = hot.select("r", "sub", "k1", "k2", "start", "data").repartition(F.col("r"), F.col("sub")).sortWithinPartitions("r", "sub")
    return map_arrow(dealt, work, "k1 long, k2 long, data binary, a long, b long, repeated boolean")


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several strings, with samples at run ends.

    ``heads`` and ``ends`` are pairs of arrays: text positions in ascending order, and the length of the match with the
    previous or next suffix in order.
    """

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) + 1 for s in strings])
        self.begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        stop = self.begin + sizes - 1
        text = np.zeros(int(sizes.sum()), np.int64)  # 0 ends a string; bytes count from 1
        inside = np.ones(len(text), bool)
        inside[stop] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.text, self.left = text, np.repeat(stop, sizes) - np.arange(len(text))  # bytes to the string's end
        order = self.suffixes()
        before = text[order - 1]
        # each string's first suffix has the end mark of another before it, which is equal to none
        alone = before == 0
        change = (before[1:] != before[:-1]) | alone[1:] | alone[:-1]
        at = np.flatnonzero(change)
        match = self.match(order[at], order[at + 1])
        self.runs = len(at) + 1
        self.heads = self.sampled(np.append(order[at + 1], order[0]), np.append(match, 0))
        self.ends = self.sampled(np.append(order[at], order[-1]), np.append(match, 0))

    @staticmethod
    def sampled(positions: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(positions, kind="stable")
        return positions[by], match[by]

    def suffixes(self) -> np.ndarray:
        """All suffixes in order, end marks by position: seven symbols at once, then by doubling within equal ranks."""
        n, depth = len(self.text), 7
        padded = np.concatenate((self.text, np.zeros(depth, np.int64)))
        key = np.zeros(n, np.int64)
        live = np.ones(n, bool)
        for k in range(depth):
            live &= self.left > k - 1
            key = key << 9 | np.where(live, padded[k : k + n], 0)
        order = np.argsort(key, kind="stable")  # end marks by position
        sorted_key = key[order]
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        new |= self.left[order] < depth  # the end mark is among the symbols: no two are equal
        new[1:] |= self.left[order][:-1] < depth
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        while True:
            same = ~new
            same[:-1] |= ~new[1:]
            at = np.flatnonzero(same)
            if not len(at):
                return order
            part = order[at]
            pair = start[at] * (n + 2) + rank[np.minimum(part + depth, n)] + 1
            by = np.argsort(pair)
            part, pair = part[by], pair[by]
            order[at] = part
            fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
            new[at] = fresh
            start[at] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            rank[part] = start[at]
            depth *= 2

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the match at two positions, up to LENGTH more than a window could need."""
        top = np.minimum(np.minimum(self.left[a], self.left[b]), 1 << 30)
        total, todo = np.zeros(len(a), np.int64), np.arange(len(a))
        step, span = 16, np.arange(16)
        while len(todo):
            x, y = a[todo] + total[todo], b[todo] + total[todo]
            n = len(self.text) - 1
            equal = self.text[np.minimum(x[:, None] + span, n)] == self.text[np.minimum(y[:, None] + span, n)]
            run = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
            total[todo] = np.minimum(total[todo] + run, top[todo])
            todo = todo[(run == step) & (total[todo] < top[todo])]
        return total

    def statistics(self) -> np.ndarray:
        """The longest match elsewhere of every text position, streamed from the samples."""
        here = np.arange(len(self.text))
        best = np.zeros(len(self.text), np.int64)
        for positions, match in (self.heads, self.ends):
            k = np.searchsorted(positions, here, side="right") - 1
            found = np.where(k >= 0, match[k] - (here - positions[k]), 0)
            best = np.maximum(best, found)
        return best


def long_matches(strings: list[bytes]) -> list[np.ndarray]:
    """Start positions, in each string, of LENGTH-byte windows that occur again in any of them."""
    distinct: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        distinct.setdefault(s, []).append(i)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    texts = list(distinct)
    index = RunLengthIndex(texts) if len(texts) > 1 or any(len(s) > LENGTH for s in texts) else None
    found = index.statistics() >= LENGTH if index else None
    for k, s in enumerate(texts):
        if len(distinct[s]) > 1:
            hit = np.arange(max(0, len(s) - LENGTH + 1))
        elif index:
            hit = np.flatnonzero(found[index.begin[k] : index.begin[k] + len(s)])
        else:
            continue
        for i in distinct[s]:
            out[i] = hit
    return out


def mark(cold: DataFrame) -> DataFrame:
    """``k1, k2, data``: spans of each document that its routes find repeated, as pairs of 64-bit numbers."""
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # strings of one document that overlap, from several routes of the block, become one
        rows = sorted({row[1:] for row in rows}, key=lambda r: r[:3])
        joined: list[list] = []
        for k1, k2, start, data in rows:
            if joined and joined[-1][:2] == [k1, k2] and start <= joined[-1][2] + len(joined[-1][3]):
                last = joined[-1]
                last[3] += data[last[2] + len(last[3]) - start :] if start + len(data) > last[2] + len(last[3]) else b""
            else:
                joined.append([k1, k2, start, data])
        done = [(k1, k2, (spans_of(hit) + start).astype("<i8").tobytes()) for (k1, k2, start, _), hit in zip(joined, long_matches([j[3] for j in joined])) if len(hit)]
        return batch(out, dict(zip(out.names, zip(*done))) if done else {k: [] for k in out.names})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in grouped(batches, 1):
            more = sum(len(row[4]) for row in group)
            if held and size + more > BLOCK:
                yield solve(held)
                held, size = [], 0
            held += group
            size += more
        if held:
            yield solve(held)

    dealt = cold.select("r", "k1", "k2", "start", "data").repartition(F.col("r")).sortWithinPartitions("r", "k1", "k2", "start")
    return map_arrow(dealt, work, "k1 long, k2 long, data binary")


def cover(marked: DataFrame, full: bool) -> DataFrame:
    """Applies the marks: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, in full, ``k1, k2`` and the ``kept`` text."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string()), ("k1", pa.int64()), ("k2", pa.int64())] * full)

    def one(text: str, cold: list[bytes] | None, hot: list[bytes] | None) -> tuple:
        data = text.encode()
        spans = np.frombuffer(b"".join(cold or []), "<i8").reshape(-1, 2)
        if hot:
            windows, found = windows_of(data), wide(hot)
            some = np.flatnonzero(np.isin(windows["a"], found["a"]))
            starts = some[np.isin(windows[some], found)]
            spans = np.concatenate((spans, spans_of(starts)))
        spans = join_spans(spans)
        edges = [0, *spans.reshape(-1).tolist(), len(data)]
        kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
        return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(*row) for row in zip(*(b.column(i).to_pylist() for i in range(1, 4)))]
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            yield batch(out, {"doc_id": b.column(0), "k1": b.column(4), "k2": b.column(5)} | ({k: list(v) for k, v in zip(names, zip(*found))} if found else {k: [] for k in names}))

    return map_arrow(marked.select("doc_id", "text", "cold", "hot", "k1", "k2"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, k1 long, k2 long" * full)


def report(docs: DataFrame, limit: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    found = candidates(docs.select("doc_id", "text"))
    whole = F.when(F.col("copies") > 1, 1).otherwise(0).cast("long")
    sha = F.when(F.col("copies") > 1, F.sha2(F.lit(""), 256)).otherwise(F.col("sha"))
    known = found.where("copies > 1 or text is null").select("doc_id", "n_bytes", (whole * F.col("n_bytes")).alias("n_removed"), whole.alias("n_spans"), sha.alias("kept_sha256"))
    return cover(marks(found, limit), False).unionByName(known)


def candidates(docs: DataFrame) -> DataFrame:
    """Every row with ``copies``, the number of rows that have its whole text, 1 for texts under LENGTH bytes.

    Rows with an anchor that occurs again keep their text and get ``pos, a, n, route`` of these anchors; of copies only
    those with the smallest id do, for the sake of other documents.
    """
    keys = keyed(docs)
    # the route is the smallest place that holds the anchor: a document and a stretch of it
    found = settle(anchors(keys).withColumn("place", F.xxhash64("k1", "k2", F.shiftright("pos", 11))), "anchors")
    count = F.when(F.min("k2") == F.max("k2"), 1).otherwise(F.count(F.lit(1)))  # of one text, as copies go on as one
    again = found.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), count.alias("n"), F.min("place").alias("route")).where("rows > 1").drop("rows")
    # written, so that the join meets two fresh sides and a frequent anchor can be split; rows that agree in id and text list their anchors once
    again = settle(again, "again")
    listed = found.drop("place").join(again, "a").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "a", "n", "route")).alias("x"))
    whole = ["k2", "crc", "n_bytes"]
    marked = keys.select("k1", "k2", F.crc32("text").alias("crc"), F.octet_length("text").alias("n_bytes")).where(F.col("n_bytes") >= LENGTH)
    groups = marked.groupBy(*whole).agg(F.count(F.lit(1)).alias("copies"), F.min("k1").alias("lead")).where("copies > 1")
    copied = marked.join(groups, whole).groupBy("k1", "k2").agg(F.max("copies").alias("copies"), F.min("lead").alias("lead"))
    own = keyed(docs, "doc_id").join(listed.join(copied, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    hit = F.col("x").isNotNull() & (F.coalesce("lead", "k1") == F.col("k1"))
    out = settle(
        own.select(
            "k1",
            "k2",
            F.col("doc_id").cast("long").alias("doc_id"),
            F.when(hit, F.col("text")).alias("text"),
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
            F.when(~hit & F.col("copies").isNull(), F.sha2("text", 256)).alias("sha"),
            *(F.when(hit, F.col(f"x.{c}")).alias(c) for c in ("pos", "a", "n", "route")),
        ),
        "candidates",
    )
    forget(found, again)
    return out


def marks(found: DataFrame, limit: int = HOT) -> DataFrame:
    """Candidates that are no copies, with what was found repeated in them: ``cold`` spans and ``hot`` window hashes."""
    some = found.where("text is not null")
    sent = settle(pieces(some, limit), "pieces")
    left = some.where("copies = 1")
    hot = recount(sent.where("hot")).groupBy("k1", "k2").agg(F.collect_list("data").alias("hot"))
    cold = mark(sent.where("not hot")).groupBy("k1", "k2").agg(F.collect_list("data").alias("cold"))
    both = cold.join(hot, ["k1", "k2"], "full")
    return left.select("k1", "k2", "doc_id", "text").join(both, ["k1", "k2"], "left")


def remove(docs: DataFrame, limit: int = HOT) -> DataFrame:
    """All columns of ``docs`` with repeated bytes removed from ``text`` and ``n_chars`` counted anew where there is one.

    A cut may fall inside a character; what is left of it goes as well.
    """
    found = candidates(docs.select("doc_id", "text"))
    cut = cover(marks(found, limit), True).where("n_removed > 0").select("k1", "k2", "kept")
    cut = cut.unionByName(found.where("copies > 1").select("k1", "k2", F.lit("").alias("kept"))).groupBy("k1", "k2").agg(F.min("kept").alias("kept"))
    row = F.col("row")
    own = boxed(docs).select("row", F.coalesce(row["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(F.coalesce(row["text"], F.lit(""))).alias("k2"))
    return unboxed(own.join(cut, ["k1", "k2"], "left"), docs.columns, F.coalesce(F.col("kept"), row["text"]))
