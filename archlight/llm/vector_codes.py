"""Compression of vectors to codes of four parts, with codebooks fitted in integers and partial-distance search.

A component x becomes floor(1024 * x) and a vector is cut into ``PARTS`` equal parts. The codebook of a part position
starts as that part of the ``ENTRIES`` smallest ids. A round is one Spark job: tasks find the nearest entry of their
parts and give one sum and count for each entry, which Spark adds up; the driver gets a row for each entry and block of
dimensions, whatever the number of vectors, and holds the codebooks, which are ``ENTRIES`` vectors in all.

The nearest entry is found by partial distances: dimensions go by descending variance of the codebook, a few at a time.
After the first few, the leading entry of every part is completed; its distance is the current best, and a mask drops
every entry whose accumulated distance is strictly over it. After every further few dimensions the leader of those left
is completed too and may lower the best. Distances are exact integers, and ties fall to the lower index because equal
ones are never dropped.

Vectors that are null or hold null or non-finite components have no row, nor do those without components, with another
length than the vector of the smallest id (of lengths that four divides), or with a component of ``2 ** 17`` or more,
whose distances could leave 64 bits. Null ids come after all others; ids that occur twice are ordered by their integer
vectors. A null label is a label of its own. Fewer than 256 vectors give as many entries. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Sizes of components from which a squared distance could leave 64 bits.
LARGE = float(2**17)
#: Dimensions that are accumulated before entries are dropped again, and parts searched at once.
STEP = 4
BLOCK = 2048
#: Components of a sum that travel in one row.
WIDTH = 16


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the vectors that have a code, in integers."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGE))
    sound = vectors.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def first_books(kept: DataFrame) -> np.ndarray:
    """The codebooks at the start, by part, entry and place: at most ENTRIES rows come to the driver."""
    rows = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of every row in sorted ``row``, and where it stands first."""
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    low = np.minimum.reduceat(value, starts)
    at = np.flatnonzero(value == np.repeat(low, np.diff(np.append(starts, len(row)))))
    return low, at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and squared distance of the nearest entry of every part, the lower index on a tie."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    size = 2 * max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.int32 if size * size * book.shape[1] < 2**31 else np.int64
    found, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    c = np.ascontiguousarray(book[:, order], kind)
    for begin in range(0, len(x), BLOCK):
        p = np.ascontiguousarray(x[begin : begin + BLOCK][:, order], kind)
        total = np.zeros((len(p), len(c)), kind)
        for d in range(min(STEP, c.shape[1])):
            gap = p[:, d, None] - c[None, :, d]
            total += gap * gap
        lead = total.argmin(axis=1)
        best = ((p - c[lead]) ** 2).sum(axis=1, dtype=kind)
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for at in range(STEP, c.shape[1], STEP):
            for d in range(at, min(at + STEP, c.shape[1])):
                gap = p[row, d] - c[entry, d]
                total += gap * gap
            _, first = per_row(row, total)
            best = np.minimum(best, ((p - c[entry[first]]) ** 2).sum(axis=1, dtype=kind))
            left = total <= best[row]
            row, entry, total = row[left], entry[left], total[left]
        low, first = per_row(row, total)
        found[begin : begin + BLOCK], far[begin : begin + BLOCK] = entry[first], low
    return found, far


def parts_of(column: pa.Array) -> np.ndarray:
    """Integer vectors by part, row and place."""
    return column.flatten().to_numpy().reshape(len(column), PARTS, -1).transpose(1, 0, 2)


def refine(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round."""
    width = books.shape[2]
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            for k, x in enumerate(parts_of(b.column(0))):
                entry, _ = nearest(x, books[k])
                by = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], entry[by][1:] != entry[by][:-1])))
                sums[k, entry[by][starts]] += np.add.reduceat(x[by].astype(np.int64), starts, axis=0)
                counts[k] += np.bincount(entry, minlength=counts.shape[1])
        used = [(k, e, at) for k, e in zip(*map(np.ndarray.tolist, np.nonzero(counts))) for at in range(0, width, WIDTH)]
        rows = [(k, e, at // WIDTH, int(counts[k, e]), sums[k, e, at : at + WIDTH].tolist()) for k, e, at in used]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, out)], schema=out)

    given = map_arrow(kept.select("v"), work, "part int, entry int, block int, n long, s array<long>")
    added = given.groupBy("part", "entry", "block").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(min(WIDTH, width))))
    books = books.copy()
    for r in added.collect():  # one row for each entry and block of dimensions
        at = r["block"] * WIDTH
        for i in range(min(WIDTH, width - at)):
            books[r["part"], r["entry"], at + i] = r[f"s{i}"] // r["n"]
    return books


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` under the codebooks."""
    label = dict(kept.dtypes)["label"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(x, books[k]) for k, x in enumerate(parts_of(b.column(2)))] if b.num_rows else [(np.zeros(0, np.int64),) * 2] * PARTS
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            code = pa.array([codes[i : i + step] for i in range(0, len(codes), step)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(reduce(np.add, (d for _, d in found)), pa.int64())], names=["vec_id", "label", "code", "error"])

    return map_arrow(kept.select("vec_id", "label", "v"), work, f"vec_id long, label {label}, code string, error long")


def told(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that has a code."""
    kept = settle(integers(vectors), "integers")
    lead = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    same = kept.where(F.size("v") == (lead[0] if lead else 0))
    books = first_books(same) if lead else np.zeros((PARTS, 0, 0), np.int64)
    for _ in range(rounds if lead else 0):
        books = refine(same, books)
    rows = settle(coded(same, books), "codes")
    forget(kept)
    sums = settle(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(told(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in DuckDB; a distance and an index are one number, so that the smallest settles ties."""
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT p.vec_id, p.p, p.x, min(CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) * 256 + b.e) AS m
  FROM parts p JOIN b{k} b ON p.p = b.p GROUP BY p.vec_id, p.p, p.x)"""  # noqa: E731
    book = lambda k: f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS x FROM (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (
    SELECT p, m % 256 AS e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)"""  # noqa: E731
    rounds = ",\n".join(f"{near(k)},\n{book(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x : floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 256
),
{rounds},
{near(ROUNDS)},
codes AS (
  SELECT vec_id, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), told AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM b{ROUNDS})
)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM codes c JOIN kept k ON c.vec_id = k.vec_id, told
"""


ORACLE = oracle()
