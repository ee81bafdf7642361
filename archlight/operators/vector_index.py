"""An inverted file over vectors, for tables of queries.

Cells are the centres of a k-means fit on a bounded sample of rows; every row is posted in its nearest cell. A search
filters first, then deals postings and queries to tiles: a cell's postings are cut into blocks of about ``BLOCK`` rows,
and a query goes to every block of the cells that it probes. A tile compares its queries with its block by matrix
products and gives at most k rows for each query, so no pairs leave it and a large cell is spread over many tasks. The
best k of a query are merged by a second shuffle. With all cells probed the result is exact; a query that finds fewer
than k rows in its cells is searched again in all of them.

How many cells to probe for a recall is measured on the sample: the share of true neighbours that lie in a query's
first cells. Rows whose vector is null, holds null or non-finite components or has another length than the centres are
not found, and such queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample, rounds of the fit and queries that measure recall.
SAMPLE, ROUNDS, ASKED = 20_000, 10, 300
CELLS, RECALL = 64, 0.95
BLOCK = 4096
#: Queries of a tile that are compared at once.
STRIP = 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0.0)


@dataclass
class Index:
    """Centres, the measured share of neighbours in the first cells, and the postings ``id, embedding, ..., _cell``."""

    centres: np.ndarray
    found: np.ndarray
    postings: DataFrame

    def probes(self, recall: float = RECALL) -> int:
        """The number of cells in which at least this share of the sample's neighbours lies."""
        return int(np.searchsorted(self.found, recall) + 1) if len(self.found) and self.found[-1] >= recall else len(self.centres)


def sound(vector: str, width: int | None = None) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & (F.size(vector) == width if width is not None else F.size(vector) > 0), F.lit(False))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by k-means from evenly taken rows; a centre without rows stays."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = distances(sample, centres).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def measured(sample: np.ndarray, centres: np.ndarray, k: int = 3) -> np.ndarray:
    """For each number of cells the share of the k nearest of some sample rows that lie in so many cells nearest to the row."""
    if len(sample) < 2:
        return np.zeros(0)
    asked = sample[np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)]
    near = np.argsort(distances(asked, sample), axis=1, kind="stable")[:, 1 : k + 1]
    cell = distances(sample, centres).argmin(axis=1)
    place = np.argsort(np.argsort(distances(asked, centres), axis=1, kind="stable"), axis=1)
    held = np.take_along_axis(place, cell[near], axis=1).reshape(-1)
    return np.cumsum(np.bincount(held, minlength=len(centres))) / len(held)


def cells_of(df: DataFrame, centres: np.ndarray, vector: str, probes: int) -> DataFrame:
    """``df`` with ``_cells``, the nearest cells of a row in order."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    names = [*df.columns, "_cells"]
    at = names.index(vector)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            near = np.argsort(distances(v, centres), axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=names)

    return df.mapInArrow(work, f"{kinds}, _cells array<int>")


def build(vectors: DataFrame, path: str, cells: int = CELLS, vector: str = "embedding", key: str = "id") -> Index:
    """The index of a vector table, its postings written by cell under ``path``."""
    spark = vectors.sparkSession
    rows = vectors.where(sound(vector)).select(key, vector).orderBy(F.xxhash64(key, vector)).limit(SAMPLE).collect()
    width = len(rows[0][vector]) if rows else 0
    sample = np.array([r[vector] for r in rows if len(r[vector]) == width], np.float64).reshape(-1, width) if rows else np.zeros((0, 0))
    centres = fit(sample, cells) if rows else np.zeros((0, 0))
    good = vectors.where(sound(vector, width))
    placed = cells_of(good, centres, vector, 1).select(*vectors.columns, F.get("_cells", F.lit(0)).alias("_cell")) if rows else vectors.where("false").withColumn("_cell", F.lit(0))
    placed.write.partitionBy("_cell").parquet(path)
    kinds = ", ".join(f"`{n}` {k}" for n, k in vectors.dtypes)
    return Index(centres, measured(sample, centres), spark.read.schema(f"{kinds}, _cell int").option("basePath", path).parquet(path))


def tiles(postings: DataFrame, queries: DataFrame, vector: str, key: str) -> DataFrame:
    """``cell, block, asks, key, v`` of postings and queries that meet; ``queries`` has ``_cells``."""
    of = postings.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_of"))  # one row for each cell
    sized = F.broadcast(of)
    held = postings.join(sized, "_cell").select(F.col("_cell").alias("cell"), F.pmod(F.xxhash64(key), F.col("_of")).cast("int").alias("block"), F.lit(False).alias("asks"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.withColumn("_cell", F.explode("_cells")).join(sized, "_cell").select(F.col("_cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("block"), F.lit(True).alias("asks"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return held.unionByName(asked)


NEAR = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def compared(met: DataFrame, k: int) -> DataFrame:
    """``query, id, distance``: the best k of each query in each tile, ties by id."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def best(ids: np.ndarray, block: np.ndarray, keys: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        query, found, far = [], [], []
        most = min(k, len(ids))
        for at in range(0, len(keys), STRIP):
            q = asked[at : at + STRIP]
            rough = distances(q, block)
            # rounding of the product could change places, so a margin of rows is measured by their differences
            few = np.argpartition(rough, min(2 * most + 16, len(ids)) - 1, axis=1)[:, : 2 * most + 16]
            exact = ((q[:, None] - block[few]) ** 2).sum(axis=2)
            order = np.lexsort((ids[few], exact))[:, :most]
            query.append(np.repeat(keys[at : at + STRIP], most))
            found.append(ids[np.take_along_axis(few, order, axis=1)].reshape(-1))
            far.append(np.take_along_axis(exact, order, axis=1).reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip((query, found, far), NEAR)], schema=NEAR)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, joined = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, block, asks, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v = matrix(b.column(4))
            turn = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *turn.tolist()], [*turn.tolist(), len(key)]):
                if (cell[i], block[i]) != tile:
                    tile, held, joined = (cell[i], block[i]), [], None
                if not asks[i]:
                    held.append((key[i:j].copy(), v[i:j].copy()))
                elif held:
                    joined = joined or tuple(np.concatenate(c) for c in zip(*held))
                    yield best(*joined, key[i:j], v[i:j])

    dealt = met.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return dealt.select("cell", "block", "asks", "key", "v").mapInArrow(work, "query long, id long, distance double")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, condition: Column | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """``query, id, distance, relevance, place``: the nearest rows of every query, ties by id.

    ``probes`` cells are searched for a query, by default as many as the measured recall asks for; all of them give the
    exact result. Keys are whole numbers.
    """
    cells, width = index.centres.shape
    most = min(index.probes() if probes is None else probes, cells)
    asked = queries.where(sound(vector, width)).select(key, vector) if cells else queries.where("false").select(key, vector)
    postings = index.postings if condition is None else index.postings.where(condition)
    by = Window.partitionBy("query").orderBy("distance", "id")

    def ranked(few: DataFrame, n: int) -> DataFrame:
        met = tiles(postings, cells_of(few, index.centres, vector, n), vector, key)
        return compared(met, k).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)

    found = ranked(asked, most) if cells else asked.select(F.col(key).cast("long").alias("query"), F.col(key).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("place"))
    if most < cells:
        full = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query").alias(key))
        rest = asked.join(full, key, "left_anti")
        found = found.join(full.withColumnRenamed(key, "query"), "query", "left_semi").select("query", "id", "distance", "place").unionByName(ranked(rest, cells).select("query", "id", "distance", "place"))
    return found.withColumn("relevance", 1 - F.col("distance"))
