"""What the training-data operators share: table access, Arrow plumbing and shared folders."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.sources.shared import ARROW_BYTES, ARROW_ROWS, BOUNDS, bound_batches, forget, settle, shared_dir  # noqa: F401  used by all operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Recent(dict):
    """What was looked up lately, by key: of two generations the older one goes when the younger one is full."""

    def __init__(self, limit: int, make: Callable | None = None) -> None:
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.turn()
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class Twice:
    """Values by key, kept for keys that were met twice: most keys of a text are met once and would only fill the store.

    New keys wait in ``fresh`` for a second meeting; the older half of ``kept`` goes when it is full.
    """

    def __init__(self, fresh: int, kept: int) -> None:
        self.limits, self.fresh, self.kept = (fresh, kept), {}, {}

    def resolve(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A value for every key; ``make`` gives those of keys that are not known."""
        known = keys & self.kept.keys()
        out = dict(zip(known, map(self.kept.__getitem__, known)))
        again = (keys - known) & self.fresh.keys()
        met = {k: self.fresh.pop(k) for k in again}
        new = list(keys - known - again)
        made = dict(zip(new, make(new)))
        if len(self.fresh) + len(made) > self.limits[0]:
            self.fresh = {}
        if len(self.kept) + len(met) > self.limits[1]:
            self.kept = dict(islice(self.kept.items(), len(self.kept) // 2, None))
        self.fresh.update(islice(made.items(), self.limits[0]))
        self.kept.update(met)
        return out | met | made


def trim() -> None:
    """Gives freed memory back to the system, as workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches, whatever the length of a row."""
    bound_batches(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            trim()

    return df.mapInArrow(lambda batches: work(trimmed(batches)), schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column; a null counts as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


#: Stands for a null id where ids order rows.
NULL_ID = -(2**63)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``k1, k2, text``: an identity for rows that holds for null and repeated ids as well.

    ``k1`` is the id (null: NULL_ID) and ``k2`` a hash of the text; rows that agree in both are copies of one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"), *extra)


def boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, ``row``, so that an operator's own names cannot clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unboxed(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of a boxed frame again; with ``text`` that replaces the text and its length."""
    row = F.col("row")
    new = {"text": text, "n_chars": F.length(text).cast("long")} if text is not None else {}
    return df.select(*(new.get(c, row[c]).alias(c) for c in columns))
