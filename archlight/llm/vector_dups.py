"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are at most ``PIVOTS`` vectors of a sample of ``SAMPLE``, none closer than a cosine of
``APART`` to another, so that a large group of copies gives one. The index holds every vector: each is described by its
``NEAREST`` pivots in order of nearness. For retrieval they are sorted by how rare they are, and the vector is posted
under the first ``NEAREST - SHARED + 1`` of them: two vectors that share ``SHARED`` pivots share one of these. In an
inverted list the pivots of its members are merged into shared-pivot counts. A pair with ``SHARED`` or more is a
candidate, in the list of its first common pivot only, so it counts once. Candidates are verified by their cosine in
double precision, so no link is below the threshold; measured recall is in the tests and the README.

A list is a label and a pivot. Lists over ``LIST`` members are cut into blocks, and each pair of blocks is a tile: the
memory of a task is bounded, pairs stay inside it, and what leaves it are a count for each member and at most one edge
for each union of two groups. Tiles first see pivots only; vectors come to those of their members that are in a
candidate pair. Equal vectors of a label are one node with a weight and meet before the shuffle. In a large group of
near copies that are not equal the number of comparisons grows with the square of the group.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null label or
id; a null id's component is null. Vectors of different lengths are never compared. Rows that share an id are one node
of the components; each row counts as a vector of its own in ``n_links``. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, forget, map_arrow, settle
from .near_dups import components, grouped

THRESHOLD = 0.93
SAMPLE = 4096
PIVOTS = 512
APART = 0.8
NEAREST = 12
SHARED = 4
LIST = 1024
#: Rows of a tile that are compared with all others at once.
STRIP = 256


def sound() -> Column:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole & F.exists("embedding", lambda x: x != 0), F.lit(False))


def keys(vectors: DataFrame) -> DataFrame:
    """``vec_id, sound, a, b``: two hashes tell vectors of a label apart."""
    size = F.size("embedding")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), sound().alias("sound"), F.xxhash64("label", size, "embedding").alias("a"), F.xxhash64(F.lit(1), "embedding", size, "label").alias("b"), "label", "embedding")


def nodes_of(keyed: DataFrame) -> DataFrame:
    """``node, id, a, b, home, other, w, v``: distinct vectors of a label with their smallest id and number; two hashes of label and length."""
    first = keyed.where("sound").groupBy("a", "b").agg(F.min(F.struct("vec_id", F.xxhash64("label", F.size("embedding")).alias("home"), F.xxhash64(F.lit(1), F.size("embedding"), "label").alias("other"), F.col("embedding").alias("v"))).alias("m"), F.count(F.lit(1)).alias("w"))
    return settle(first.select(F.monotonically_increasing_id().alias("node"), F.col("m.vec_id").alias("id"), "a", "b", "m.home", "m.other", "w", "m.v"), "nodes")


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision, divided by their largest component so that no square overflows."""
    v = np.asarray(v, np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; with ``width`` cut or filled with zeros, as they may differ in length."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for i, (begin, length) in enumerate(zip(ends.tolist(), lengths.tolist())):
        some = values[begin : begin + length][:width]
        out[i, : len(some)] = some
    return out


def reference_points(nodes: DataFrame) -> np.ndarray:
    """At most PIVOTS unit vectors from the SAMPLE nodes with the smallest hashes."""
    rows = nodes.select("a", "b", "v").orderBy("a", "b").limit(SAMPLE).collect()
    width = max((len(r["v"]) for r in rows), default=0)
    found = np.zeros((0, width))
    for r in rows:
        v = scaled(np.array([r["v"] + [0.0] * (width - len(r["v"]))]))
        v /= np.linalg.norm(v)
        if len(found) < PIVOTS and (found @ v[0] < APART).all():
            found = np.concatenate((found, v))
    return found


def permutations(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``node, home, near``: the numbers of the nearest pivots, the nearest first."""
    out = pa.schema([("node", pa.int64()), ("home", pa.int64()), ("near", pa.list_(pa.int16()))])
    most = min(NEAREST, len(pivots))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(2), pivots.shape[1]).astype(np.float64)
            top = np.argsort(-(v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300) @ pivots.T), axis=1, kind="stable")[:, :most].astype(np.int16)
            near = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, most), pa.int32()), pa.array(top.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near], schema=out)

    return map_arrow(nodes.select("node", "home", "v"), work, "node long, home long, near array<short>")


def inverted(described: DataFrame, pivots: int) -> DataFrame:
    """``h, x, y, block, p, node, ranks``: the tiles of all inverted lists with two members or more.

    ``ranks`` are a node's pivots from the rarest on, ``p`` the list's own.
    """
    often = dict(described.select(F.explode("near").alias("p")).groupBy("p").count().collect())  # one row for each pivot
    rank = {p: k for k, p in enumerate(sorted(range(pivots), key=lambda p: (often.get(p, 0), p)))}
    by_rank = F.array(*(F.lit(rank[p]).cast("short") for p in range(pivots)))
    posted = min(NEAREST, pivots) - min(SHARED, pivots) + 1
    ranks = F.sort_array(F.transform("near", lambda p: F.get(by_rank, p.cast("int"))))
    posts = described.select("node", "home", ranks.alias("ranks")).withColumn("p", F.explode(F.slice("ranks", 1, posted))).select(F.xxhash64("home", "p").alias("h"), "p", "node", "ranks")
    sizes = settle(posts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    of = F.ceil(F.col("size") / LIST).cast("int")
    cut = posts.join(sizes, "h").withColumns({"of": of, "block": F.pmod(F.xxhash64("node"), of).cast("int")})
    tiles = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return tiles.select("h", F.least("block", "j").alias("x"), F.greatest("block", "j").alias("y"), "block", "p", "node", "ranks")


def candidates(ranks: np.ndarray, p: int, block: np.ndarray, apart: bool, shared: int) -> Iterator[tuple[int, np.ndarray]]:
    """Strips ``(begin, mask)`` of the pairs i < j with enough shared pivots, none of them before ``p``, across blocks if ``apart``."""
    _, local = np.unique(ranks, return_inverse=True)
    local = local.reshape(ranks.shape)
    held = np.zeros((len(ranks), int(local.max()) + 1), np.float32)
    held[np.arange(len(ranks))[:, None], local] = 1
    early = int(np.unique(ranks).searchsorted(p))
    for begin in range(0, len(ranks), STRIP):
        own = held[begin : begin + STRIP]
        mask = (own @ held.T >= shared) & (own[:, :early] @ held[:, :early].T == 0)
        mask &= np.arange(len(ranks)) > np.arange(begin, begin + len(own))[:, None]
        if apart:
            mask &= block != block[begin : begin + len(own), None]
        yield begin, mask


TILE = ["h", "x", "y", "block", "p", "node", "ranks"]
TYPES = "h long, x int, y int, block int, p short, node long, ranks array<short>"


def tile_columns(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return (*(part.column(i).to_numpy() for i in range(6)), matrix(part.column(6)))


def dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition(F.col("h"), F.col("x"), F.col("y")).sortWithinPartitions("h", "x", "y", "node")


def met(tiles: DataFrame, shared: int) -> DataFrame:
    """The rows of the tiles that are in a candidate pair."""
    out = pa.schema([("h", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("block", pa.int32()), ("p", pa.int16()), ("node", pa.int64()), ("ranks", pa.list_(pa.int16()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for tile in grouped(batches, 3, tile_columns):
            h, x, y, block, p, node, ranks = tile
            seen = np.zeros(len(node), bool)
            for begin, mask in candidates(ranks, int(p[0]), block, x[0] != y[0], shared):
                seen |= mask.any(axis=0)
                seen[begin : begin + len(mask)] |= mask.any(axis=1)
            if seen.any():
                held.append(tuple(c[seen] for c in tile))
            if sum(len(t[0]) for t in held) > 4096:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    def joined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        return batch(out, dict(zip(TILE, [*columns[:6], list(columns[6])])))

    return map_arrow(dealt(tiles).select(*TILE), work, TYPES)


def verified(seen: DataFrame, threshold: float, shared: int) -> DataFrame:
    """``node, n, a, b``: numbers of linked vectors for nodes of tiles, and edges ``a, b`` of ids, from tiles with ``id, other, w, v``."""
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def read(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        vectors = np.empty(part.num_rows, object)
        values, ends = part.column(10).values.to_numpy(zero_copy_only=False), part.column(10).offsets.to_numpy()
        for i in range(part.num_rows):
            vectors[i] = values[ends[i] : ends[i + 1]].copy()
        return (*tile_columns(part), *(part.column(i).to_numpy() for i in range(7, 10)), vectors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, block, p, node, ranks, id_, other, w, vectors in grouped(batches, 3, read):
            if any(len(v) != len(vectors[0]) for v in vectors):  # two lists under one hash
                width = max(map(len, vectors))
                vectors = [np.pad(v, (0, width - len(v))) for v in vectors]
            v = scaled(np.stack(list(vectors)))
            norm = np.sqrt((v * v).sum(axis=1))
            links, root, edges = np.zeros(len(node), np.int64), np.arange(len(node)), []
            for begin, mask in candidates(ranks, int(p[0]), block, x[0] != y[0], shared):
                own = slice(begin, begin + len(mask))
                mask &= (v[own] @ v.T >= threshold * (norm[own, None] * norm)) & (other[own, None] == other)
                links[own] += mask @ w
                links += w[own] @ mask
                for i in np.flatnonzero(mask.any(axis=1)).tolist():
                    near = np.flatnonzero(mask[i] & (root != root[begin + i]))
                    for k in near[np.unique(root[near], return_index=True)[1]].tolist():
                        edges.append((begin + i, k))
                        root[root == root[k]] = root[begin + i]
            k = np.flatnonzero(links)
            if len(k):
                ends = np.array(edges)
                one, two = id_[ends[:, 0]], id_[ends[:, 1]]
                none = [None] * len(edges)
                yield batch(out, {"node": [*node[k].tolist(), *none], "n": [*links[k].tolist(), *none], "a": [None] * len(k) + np.minimum(one, two).tolist(), "b": [None] * len(k) + np.maximum(one, two).tolist()})

    return map_arrow(dealt(seen).select(*TILE, "id", "other", "w", "v"), work, "node long, n long, a long, b long")


def report(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    keyed = keys(vectors)
    rows = settle(keyed.select("vec_id", "sound", "a", "b"), "rows")
    nodes = nodes_of(keyed)
    pivots = reference_points(nodes)
    shared = min(SHARED, len(pivots))
    if len(pivots):
        described = settle(permutations(nodes, pivots), "permutations")
        tiles = settle(inverted(described, len(pivots)), "tiles")
        seen = settle(met(tiles, shared), "met")
        forget(described, tiles)
        found = settle(verified(seen.join(nodes.select("node", "id", "other", "w", "v"), "node"), threshold, shared), "links")
        forget(seen)
    else:
        found = settle(nodes.select("node", F.col("w").alias("n"), F.col("id").alias("a"), F.col("id").alias("b")).where("false"), "links")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    group = components(found.where("a < b").select("a", "b").distinct())
    alike = settle(nodes.join(counts, "node", "left").join(group.withColumnRenamed("c", "id"), "id", "left").select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("g", "id").alias("component_id")), "alike")
    forget(nodes, found)
    linked = rows.where("sound").join(alike, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
