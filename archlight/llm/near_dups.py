"""MinHash near-dedup by a signature-coordinate inverted join.

Every document's set of 5-word shingles gets a signature of ``COORDINATES`` minima. Equal sets are one class and only
their first document goes on. All coordinates are stored as one byte each; the first ``PREFIX`` are posted as well, by
their whole 64-bit value: two sets of similarity 0.85 share none of them with probability 0.15 ** 12, under 2e-10. In a
posting list the collisions of two signatures are counted block by block of coordinates; a pair that can no longer
reach the threshold is skipped, as is one whose set sizes alone exclude the similarity, or that shares an earlier
posted coordinate and so meets in that list. Pairs at or above ``least(percent)`` collisions are candidates (a pair at
the similarity asked falls below with probability about 1e-6). All links are confirmed on full sets.

No list gives all its pairs. In the first round a list of g classes gives the at most g - 1 edges of a maximum
spanning forest over the counted collisions. Confirmed edges make components. In the second round only lists that
still hold several components are read again. A list is cut into blocks of about ``LIST`` classes and ``WEIGHT``
shingles, those of its largest component apart from the others, and pairs of blocks are tiles. A tile first tells
which of its classes are in a candidate pair across components; only these get their sets, once for a tile. There the
intersections of a set with all others come from merging the postings of its shingles, components are united as links
are found, and a tile gives at most one link for each union. So every link that could join two components is tried, a
tile's memory is bounded, and no pairs are written but confirmed ones.

Lists beyond ``LIST`` classes whose members differ in the next coordinate are posted again under pairs of coordinates,
and once more under triples. Such a list is not read itself, so a pair that shares only that coordinate, or only the
two of a list split again, meets nowhere. At similarity 0.85 a pair is missed with probability below 2e-10 where its
lists are unsplit, 9e-9 after one split and 3e-7 after two (at most one or two of 12 shared), which is the last depth:
at any size below the 1e-6 of the threshold.

Words are runs of other than the six ASCII white-space characters, A-Z lower-cased. Fewer than five words are one
shingle; no words give the empty set, which is linked with nothing. Null text counts as empty. A null id keeps its
row with a null component and is linked with nothing. Rows that share an id are one node, whatever their texts: a class
has a hash of its set as its key, so that an id may have any number of classes, and the classes of an id are linked. A
text may be of any length: its signature is taken in blocks. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, batch, boxed, forget, map_arrow, settle, texts_of, unboxed

SHINGLE = 5
COORDINATES = 512
PREFIX = 12
PERCENT = 85
LIST = 1024
#: Shingles in a block of a list: 4 MB of sets.
WEIGHT = 1 << 19
DEPTH = 3
#: Coordinates counted before pairs that cannot reach the threshold any more are skipped.
STEPS = (64, 128, 256, 512)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KNOWN_WORDS = 150_000

_drawn = np.random.default_rng(20_240_229)
WEIGHTS = _drawn.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSTED = _drawn.integers(1, 2**63, PREFIX, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the coordinates that are not posted one half hashes the lower 32 bits of a shingle, the other half the upper ones.
HALF = (COORDINATES - PREFIX) // 2
FACTORS = _drawn.integers(1, 2**31, (2, HALF), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _drawn.integers(0, 2**32, (2, HALF), dtype=np.uint32)
FOLD = np.uint32(0x9E3779B1)
WIDE_FOLD = np.uint64(0x9E3779B97F4A7C15)


def hashed(word: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(word)


#: Hashes of words as eight bytes each.
KNOWN = Recent(KNOWN_WORDS, hashed)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(KNOWN.__getitem__, words)), dtype=">u8").astype(np.uint64)
    k = min(len(h), SHINGLE)
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * WEIGHTS[i]
    return np.unique(mix(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest 64-bit hash of every posted coordinate over a non-empty set."""
    return np.array([(found * f).min() for f in POSTED], np.uint64)


def signature(found: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """One byte of the smallest hash of every coordinate over a non-empty set, the posted ones first."""
    low = np.full((2, HALF), np.iinfo(np.uint32).max, dtype=np.uint32)
    halves = found.view(np.uint32).reshape(-1, 2)
    for at in range(0, len(found), 512):
        for k in (0, 1):
            part = np.ascontiguousarray(halves[at : at + 512, k])
            low[k] = np.minimum(low[k], (part[:, None] * FACTORS[k] + SHIFTS[k]).min(axis=0))
    return np.concatenate(((posted * WIDE_FOLD) >> np.uint64(56), (low.reshape(-1) * FOLD) >> np.uint32(24))).astype(np.uint8)


def least(percent: int) -> int:
    """Collisions that a pair at the similarity has but in one of a million cases: 4.9 standard deviations below the mean."""
    p = percent / 100 + (1 - percent / 100) / 256
    return round(COORDINATES * p - 4.9 * math.sqrt(COORDINATES * p * (1 - p)))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n, a, b, sig, keys``: set size, two set checksums, the signature, a byte for each coordinate, and the posted minima."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                s = shingles(text)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, None, None))
                    continue
                sums, posted = np.array([s.sum(), mix(s).sum()], np.uint64).view(np.int64).tolist(), minima(s)
                rows.append((doc_id, len(s), *sums, signature(s, posted).tobytes(), posted.view(np.int64).tolist()))
            yield batch(out, dict(zip(out.names, zip(*rows))) if rows else {k: [] for k in out.names})

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "doc_id long, n long, a long, b long, sig binary, keys array<long>")


def class_key() -> Column:
    """A class's key from the checksums and the size of its set."""
    return F.xxhash64("a", "b", "n")


def leaders(rows: DataFrame) -> DataFrame:
    """``c, id, n, sig, keys, rows`` of every class: its key, its smallest id and how many rows have its set; copies meet before the shuffle."""
    linked = rows.where("n > 0 and doc_id is not null")
    first = linked.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("m"), F.count(F.lit(1)).alias("rows"))
    return first.select(class_key().alias("c"), F.col("m.doc_id").alias("id"), "n", "m.sig", "m.keys", "rows")


def classes(rows: DataFrame) -> DataFrame:
    """``doc_id, n, c`` of all rows: ``c`` is the key of the set, null for empty sets and null ids."""
    return rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), class_key()).alias("c"))


def shared_ids(ranked: DataFrame) -> DataFrame:
    """``doc_id, low, high`` of ids with several rows: the smallest and the largest of their classes."""
    ids = ranked.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("low"), F.max("c").alias("high"))
    return ids.where("rows > 1").drop("rows")


def repeated(posts: DataFrame) -> DataFrame:
    """Postings in lists of two classes or more, with the list's size and how its members spread in the next coordinate."""
    lists = posts.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.approx_count_distinct("probe", 0.1).alias("spread")).where("size > 1")
    return settle(posts.join(settle(lists, "sizes"), "h").drop("probe"), "lists")


def post(members: DataFrame) -> DataFrame:
    """``h, first, j, c, n, size``: lists of at most LIST classes, or dense ones of any length; ``first`` is the list's first coordinate."""
    probe = lambda j: F.get("keys", (j + 1) % PREFIX)
    first = members.select("c", "n", "keys", F.posexplode("keys").alias("j", "v"))
    level = repeated(first.select(F.xxhash64("j", "v").alias("h"), F.col("j").alias("first"), "j", "c", "n", probe(F.col("j")).alias("probe")))
    done = []
    for _ in range(DEPTH - 1):
        loose = (F.col("size") > LIST) & (F.col("spread") * 4 > F.col("size")) & (F.col("j") < PREFIX - 1)
        done.append(level.where(~loose))
        again = level.where(loose)
        if again.isEmpty():
            return union(done)
        further = again.join(members.select("c", "keys"), "c").select("h", "first", "c", "n", "keys", F.explode(F.sequence(F.col("j") + 1, F.lit(PREFIX - 1))).alias("j"))
        level = repeated(further.select(F.xxhash64("h", "j", F.get("keys", F.col("j"))).alias("h"), "first", "j", "c", "n", probe(F.col("j")).alias("probe")))
    return union([*done, level])


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parts(posts: DataFrame) -> DataFrame:
    """``h, first, part, c, n, own``: lists cut into parts of about LIST classes; the list's first class is in every part, its ``own`` and others."""
    count = F.ceil(F.col("size") / LIST).cast("int")
    home = lambda of: F.pmod(F.xxhash64("c"), of).cast("int")
    cut = posts.select("h", "first", "c", "n", count.alias("of"), home(count).alias("part"))
    hubs = cut.where("of > 1").groupBy("h", "first").agg(F.min(F.struct("c", "n")).alias("m"), F.max("of").alias("of"))
    guests = hubs.select("h", "first", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"), F.col("m.c").alias("c"), F.col("m.n").alias("n"), "of").where(F.col("part") != home(F.col("of")))
    return union([x.select("h", "first", "part", "c", "n", F.lit(own).alias("own")) for x, own in ((cut, True), (guests, False))])


def collisions(sig: np.ndarray, one: np.ndarray, threshold: int) -> np.ndarray:
    """Collisions of a signature with each row, 0 where they are under the threshold; pairs that cannot reach it are skipped."""
    total, live, at = np.zeros(len(sig), np.int64), np.arange(len(sig)), 0
    for end in STEPS:
        total[live] += (sig[live, at:end] == one[at:end]).sum(axis=1)
        live, at = live[total[live] + (COORDINATES - end) >= threshold], end
        if not len(live):
            break
    found = np.zeros(len(sig), np.int64)
    found[live] = total[live]
    return found


def forest(sig: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the collisions at or above the threshold, grown from the first row."""
    n = len(sig)
    left = np.arange(1, n)
    best, parent, edges, at = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), [], 0
    while len(left):
        m = collisions(sig[left], sig[at], threshold)
        better = m > best
        best, parent = np.where(better, m, best), np.where(better, at, parent)
        k = int(best.argmax())
        at = int(left[k])
        if best[k]:
            edges.append((int(parent[k]), at))
        left, best, parent = (np.delete(x, k) for x in (left, best, parent))
    return edges


def grouped(batches: Iterator[pa.RecordBatch], keys: int, read: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of the rows that agree in the leading columns, from batches in that order."""
    held: tuple[np.ndarray, ...] | None = None
    for part in chain_end(batches):
        if part is not None and not part.num_rows:
            continue
        if part is not None:
            new = read(part)
            held = tuple(np.concatenate(x) for x in zip(held, new)) if held else new
        if held is None:
            return
        other = np.zeros(len(held[0]) - 1, bool)
        for x in held[:keys]:
            other |= x[1:] != x[:-1]
        starts = np.concatenate(([0], np.flatnonzero(other) + 1, [len(held[0])]))
        whole = len(starts) - (1 if part is None else 2)  # the last group may go on in the next batch
        for i, j in zip(starts[:whole], starts[1 : whole + 1]):
            yield tuple(x[i:j] for x in held)
        held = tuple(x[starts[whole] :].copy() for x in held) if part is not None else None


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def first_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a < b``: a forest of every list in ``h, part, c, sig``."""
    out, threshold = pa.schema([("a", pa.int64()), ("b", pa.int64())]), least(percent)

    def read(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return (*(part.column(i).to_numpy() for i in range(3)), signatures_of(part.column(3)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for _, _, c, sig in grouped(batches, 2, read):
            got = forest(sig, threshold) if len(c) > 2 else [(0, 1)] if len(c) == 2 and collisions(sig[:1], sig[1], threshold)[0] else []
            if got:
                found.append(np.sort(c[np.array(got)], axis=1))
            if sum(map(len, found)) > 4096:
                edges = np.unique(np.concatenate(found), axis=0)
                yield batch(out, {"a": edges[:, 0], "b": edges[:, 1]})
                found = []
        edges = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        yield batch(out, {"a": edges[:, 0], "b": edges[:, 1]})

    dealt = listed.repartition(F.col("h"), F.col("part")).sortWithinPartitions("h", "part", "c")
    return map_arrow(dealt.select("h", "part", "c", "sig"), work, "a long, b long").where("a < b")


def tiles(named: DataFrame) -> DataFrame:
    """``h, x, y, block, first, c, g`` of the lists in ``h, first, c, g, n`` that hold several components.

    A list of at most LIST classes and WEIGHT shingles is one tile. Otherwise the classes of its largest component are
    cut into blocks and the others into further ones, and every pair of blocks that can hold a link across components
    is a tile.
    """
    mixed = named.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("low < high")
    open_ = settle(named.join(settle(mixed.select("h", "size", "weight"), "mixed"), "h"), "open")
    small = (F.col("size") <= LIST) & (F.col("weight") <= WEIGHT)
    one = open_.where(small).select("h", *(F.lit(0).alias(k) for k in ("x", "y", "block")), "first", "c", "g")
    big = open_.where(~small)
    if big.isEmpty():
        return one
    own = big.groupBy("h", "g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    main = own.groupBy("h").agg(F.max(F.struct("size", "g", "weight")).alias("m"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    blocks = lambda size, weight: F.ceil(F.greatest(size / LIST, weight / WEIGHT)).cast("int")
    cut = settle(main.select("h", F.col("m.g").alias("main"), blocks(F.col("m.size"), F.col("m.weight")).alias("inner"), blocks(F.col("size") - F.col("m.size"), F.col("weight") - F.col("m.weight")).alias("outer")), "cut")
    inner, outer, block = F.col("inner"), F.col("outer"), F.col("block")
    dealt = big.join(cut, "h").withColumn("block", F.when(F.col("g") == F.col("main"), F.pmod(F.xxhash64("c"), inner)).otherwise(inner + F.pmod(F.xxhash64("c"), outer)).cast("int"))
    # a tile is a pair of blocks of which the larger number is not of the main component
    lower = dealt.where(block >= inner).withColumn("x", F.explode(F.sequence(F.lit(0), block))).withColumn("y", block)
    upper = dealt.withColumn("y", F.explode(F.filter(F.sequence(F.lit(0), inner + outer - 1), lambda y: (y > block) & (y >= inner)))).withColumn("x", block)
    return union([one, *(t.select("h", "x", "y", "block", "first", "c", "g") for t in (lower, upper))])


def meetings(tiled: DataFrame, percent: int) -> DataFrame:
    """``h, x, y, c``: the classes of the tiles ``h, x, y, block, c, n, sig, g, first, keys`` that are in a candidate pair across components."""
    names = ["h", "x", "y", "block", "c", "n", "g", "first"]
    out, threshold = pa.schema([("h", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("c", pa.int64())]), least(percent)

    def read(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return (*(part.column(i).to_numpy() for i in range(8)), signatures_of(part.column(8)), part.column(9).flatten().to_numpy().reshape(part.num_rows, -1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, x, y, block, c, n, g, first, sig, keys in grouped(batches, 3, read):
            by = np.argsort(n, kind="stable")
            block, n, g, sig, keys = (v[by] for v in (block, n, g, sig, keys))
            before, apart, met = keys[:, : int(first[0])], x[0] != y[0], np.zeros(len(c), bool)
            ends = np.searchsorted(n, n * 100 // percent, side="right")
            for i, end in enumerate(ends.tolist()):
                ok = g[i + 1 : end] != g[i]
                if apart:
                    ok &= block[i + 1 : end] != block[i]
                if before.shape[1]:
                    ok &= (before[i + 1 : end] != before[i]).all(axis=1)
                near = i + 1 + np.flatnonzero(ok)
                near = near[collisions(sig[near], sig[i], threshold) > 0] if len(near) else near
                if len(near):
                    met[near] = met[i] = True
            k = by[met]
            if len(k):
                yield batch(out, {"h": h[k], "x": x[k], "y": y[k], "c": c[k]})

    dealt = tiled.repartition(F.col("h"), F.col("x"), F.col("y")).sortWithinPartitions("h", "x", "y", "c")
    return map_arrow(dealt.select(*names, "sig", "keys"), work, "h long, x int, y int, c long")


def unions(sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A link for each union of two groups, by full sets: intersections are counted by merging the postings of a set's shingles."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    listed = row[np.argsort(which, kind="stable")]
    length = np.bincount(which)
    begin, at = np.cumsum(length) - length, np.concatenate(([0], np.cumsum(sizes)))
    root, links = np.unique(group, return_inverse=True)[1].copy(), []
    for i in range(len(sets) - 1):
        if (root == root[i]).all():
            break
        own = which[at[i] : at[i + 1]]
        own = own[length[own] > 1]
        many = length[own]
        places = np.arange(many.sum()) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
        both = np.bincount(listed[places], minlength=len(sets))
        hit = np.flatnonzero(both * 100 >= (sizes + sizes[i] - both) * percent)
        for k in hit[(hit > i) & (root[hit] != root[i])].tolist():
            if root[k] != root[i]:
                links.append((i, k))
                root[root == root[k]] = root[i]
    return links


def tile_links(met: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that unite components, from ``h, x, y, c, g, s`` with the sets of the classes."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def read(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        s = part.column(5)
        ends, values = s.offsets.to_numpy(), s.values.to_numpy()
        sets = np.empty(part.num_rows, object)
        for i in range(part.num_rows):
            sets[i] = values[ends[i] : ends[i + 1]].copy()
        return (*(part.column(i).to_numpy() for i in range(5)), sets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, c, g, sets in grouped(batches, 3, read):
            if links := unions(list(sets), g, percent):
                k = np.sort(c[np.array(links)], axis=1)
                yield batch(out, {"a": k[:, 0], "b": k[:, 1]})

    dealt = met.repartition(F.col("h"), F.col("x"), F.col("y")).sortWithinPartitions("h", "x", "y", "c")
    return map_arrow(dealt.select("h", "x", "y", "c", "g", "s"), work, "a long, b long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``c, a, b, s``: the sets of the given texts and their checksums."""
    out = pa.schema([("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets = [shingles(t) for t in texts_of(part.column(1))]
            sums = np.array([(x.sum(), mix(x).sum()) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield batch(out, {"c": part.column(0), "a": sums[:, 0], "b": sums[:, 1], "s": [x.view(np.int64) for x in sets]})

    return map_arrow(docs.select("c", "text"), work, "c long, a long, b long, s array<long>")


def sets_of(wanted: DataFrame, members: DataFrame, docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """``c, s``: the full sets of the classes ``c``, each once. Of ids with several rows the texts' own keys tell the class."""
    asked = settle(wanted.select("c").distinct().join(members.select("c", "id"), "c"), "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    if shared is None:
        sets = shingle_sets(texts.join(asked, "id")).select("c", "s")
    else:
        several = shared.select(F.col("doc_id").alias("id"))
        one = shingle_sets(texts.join(asked.join(several, "id", "left_anti"), "id")).select("c", "s")
        of_several = texts.join(asked.select("id").distinct().join(several, "id", "left_semi"), "id", "left_semi")
        own = shingle_sets(of_several.select(F.col("id").alias("c"), "text")).withColumn("n", F.size("s").cast("long")).select(class_key().alias("c"), "s")
        sets = one.unionByName(own.join(asked.select("c"), "c", "left_semi").dropDuplicates(["c"]))
    sets = settle(sets, "sets")
    forget(asked)
    return sets


def confirm(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs whose full sets ``c, s`` are similar enough."""
    left, right = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return candidates.join(left, "a").join(right, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``c, g``: every node of the edges with the smallest node that it reaches.

    Labels fall to the smallest among neighbours and then to their own label's label, until none changes; every round
    is written to the shared folder.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("g")), "labels")
    while True:
        near = both.join(labels.select(F.col("c").alias("b"), "g"), "b").groupBy(F.col("a").alias("c")).agg(F.min("g").alias("m"))
        lower = labels.join(near, "c").select("c", F.col("g").alias("was"), F.least("g", "m").alias("g"))
        jump = labels.select(F.col("c").alias("g"), F.col("g").alias("far"))
        new = settle(lower.join(jump, "g", "left").select("c", "was", F.least("g", F.coalesce("far", "g")).alias("g")), "labels")
        forget(labels)
        if new.where("g <> was").isEmpty():
            forget(both)
            return new.select("c", "g")
        labels = new


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, component`` for every row of ``docs``."""
    marked = settle(signed(docs), "signed")
    members = settle(leaders(marked), "members")
    ranked = settle(classes(marked), "classes")
    forget(marked)
    shared = settle(shared_ids(ranked), "shared")
    several = None if shared.isEmpty() else shared
    posts = settle(parts(post(members)), "posts")
    tried = settle(first_pairs(posts.select("h", "part", "c").join(members.select("c", "sig"), "c"), percent).distinct(), "pairs")
    edges = confirm(tried, sets_of(tried.select(F.explode(F.array("a", "b")).alias("c")), members, docs, several), percent)
    if several is not None:  # the classes of an id are one node
        one = ranked.where("c is not null").join(several.where("low < high"), "doc_id").where("c <> low")
        edges = edges.unionByName(one.select(F.col("low").alias("a"), F.col("c").alias("b"))).distinct()
    edges = settle(edges, "links")
    found = components(edges)
    # second round: lists that still hold several components
    named = posts.where("own").join(found, "c", "left").select("h", "first", "c", F.coalesce("g", "c").alias("g"), "n")
    tiled = settle(tiles(named), "tiles")
    met = settle(meetings(tiled.join(members, "c").drop("id", "rows"), percent), "met")
    grown = met.join(tiled.select("h", "x", "y", "c", "g"), ["h", "x", "y", "c"]).join(sets_of(met, members, docs, several), "c")
    more = settle(tile_links(grown, percent).distinct(), "links")
    if not more.isEmpty():
        found = components(edges.unionByName(more))
    # a component's name is its smallest id
    ids = found.join(members.select("c", "id"), "c")
    linked = ids.join(ids.groupBy("g").agg(F.min("id").alias("component")), "g").select("c", "component")
    copies = members.where("rows > 1").select("c", "id")
    labels = settle(copies.join(linked, "c", "full_outer").select("c", F.coalesce("component", "id").alias("component")), "names")
    forget(members, posts, tried, edges, tiled, met, more)
    if several is not None:  # a row without words goes with the other rows of its id
        ranked = ranked.join(several.select("doc_id", "low"), "doc_id", "left").select("doc_id", "n", F.coalesce("c", "low").alias("c"))
    return ranked.join(labels, "c", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    found = link(docs, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns; rows with null ids all stay, repeated rows of a kept id are one."""
    ids = link(docs, percent).where("component = doc_id").select(F.col("doc_id").alias("id")).distinct()
    own = boxed(docs).withColumn("id", F.col("row")["doc_id"].cast("long"))
    one = own.where("id is not null").join(ids, "id", "left_semi").dropDuplicates(["id"])
    return unboxed(one.unionByName(own.where("id is null")), docs.columns)
