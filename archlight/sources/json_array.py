"""Large JSON arrays: read in byte ranges by many tasks, and written as one file.

A file is read as chunks that end at ``}``, so Spark's text reader splits it anywhere and no chunk outlasts a nested
object. A range (the chunks that begin in one split) starts behind a ``}``, hence never inside an escape. What a range
does to the reader's state is told without knowing that state: whether it holds an odd number of quotes, and by how
much its brackets change the depth if it begins outside a string or inside one. Running sums over these few numbers, a
row for each range, give the true state at the start of each. Then every range cuts its own elements at the commas of
depth one and numbers them; an element that lies across ranges is joined from its parts by its number. A range is gone
through in small pieces, so a task's memory does not grow with the size of the splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, forget, settle, shared_path

END = "}"
QUOTE, BACKSLASH, COMMA = b'"\\,'
OPEN, CLOSE = b"{[", b"}]"
BLANK = b" \t\r\n"
#: Bytes that are looked at in one step.
PIECE = 1 << 18


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, size, value``: the chunks of files in order, with their range's start and the file's size."""
    raw = spark.read.option("lineSep", END).text(path)
    meta = F.col("_metadata")
    return raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def pieces(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """For each range its leading columns and its bytes in pieces, each with the number of its chunks and whether it ends the range.

    Chunks of a range come one after another. A piece has ``PIECE`` bytes at most, so what is held does not grow with the
    range; a longer chunk goes on over several pieces, of which the first counts it.
    """
    held, data, count = None, bytearray(), 0

    def told(over: bool) -> Iterator[tuple]:
        for at in range(0, len(data), PIECE):
            yield held, bytes(data[at : at + PIECE]), 0 if at else count, over and at + PIECE >= len(data)

    for b in batches:
        heads = list(zip(*(b.column(i).to_pylist() for i in range(columns))))
        for head, value in zip(heads, b.column(columns).to_pylist()):
            if count and (head != held or len(data) + len(value) >= PIECE):
                yield from told(head != held)
                data, count = bytearray(), 0
            held, count = head, count + 1
            data += value + END.encode()
    if count:
        yield from told(True)


def structure(data: bytes, inside: bool, escaped: bool = False) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Which bytes are outside strings, the change of depth that each bracket makes outside, and whether the end is inside a string and behind an open escape."""
    raw = np.frombuffer(data, np.uint8)
    quote, slash, open_end = raw == QUOTE, raw == BACKSLASH, False
    if len(raw) and (escaped or slash.any()):
        # a quote is escaped behind an odd number of backslashes
        lead = -2 if escaped else -1
        last_other = np.maximum.accumulate(np.where(slash, lead, np.arange(len(raw))))
        before = np.concatenate(([lead], last_other[:-1]))
        quote &= (np.arange(len(raw)) - 1 - before) % 2 == 0
        open_end = bool((len(raw) - 1 - last_other[-1]) % 2)
    strings = (np.cumsum(quote) + inside) % 2 == 1
    change = np.isin(raw, list(OPEN)).astype(np.int8) - np.isin(raw, list(CLOSE)).astype(np.int8)
    return ~strings & ~quote, change, bool(quote.sum() % 2) != inside, open_end


def summarised(found: DataFrame) -> DataFrame:
    """``file, start, size, odd, outside, within, bytes, chunks``: what each range does to the state."""
    out = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("within", pa.int64()), ("bytes", pa.int64()), ("chunks", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, escaped, outside, within, size, chunks = False, False, 0, 0, 0, 0
        for head, data, count, over in pieces(batches, 3):
            free, change, odd, escaped = structure(data, odd, escaped)
            outside, within = outside + int(change[free].sum()), within + int(change[~free].sum())
            size, chunks = size + len(data) - count, chunks + count
            if over:
                row = (*head, int(odd), outside, within, size, chunks)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)
                odd, escaped, outside, within, size, chunks = False, False, 0, 0, 0, 0

    return found.mapInArrow(work, "file string, start long, size long, odd int, outside long, within long, bytes long, chunks long")


def states(summaries: DataFrame) -> DataFrame:
    """``file, start, inside, depth, last, ended``: the state at the start of each range; ``ended`` tells if the file ends with a ``}``."""
    order = Window.partitionBy("file").orderBy("start")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    change = F.when(inside == 1, F.col("within")).otherwise(F.col("outside"))
    known = summaries.withColumn("inside", inside == 1).withColumn("change", change)
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    ended = F.sum(F.col("bytes") + F.col("chunks")).over(whole) == F.col("size")
    return known.select("file", "start", "inside", depth.alias("depth"), (F.lead("start").over(order).isNull()).alias("last"), ended.alias("ended"))


def cut(found: DataFrame, state: DataFrame) -> DataFrame:
    """``file, start, local, text, opened, fault``: parts of elements, numbered by the commas of their range before them.

    Parts at either end of a range may go on in the next. A last row without text has the range's number of commas, how
    often it opens an array, and whether there is a place where the file is none.
    """
    out = pa.schema([("file", pa.string()), ("start", pa.int64()), ("local", pa.int64()), ("text", pa.binary()), ("opened", pa.int64()), ("fault", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for (file, start, *before, last, ended), data, _, over in pieces(batches, 6):
            if not begun:
                inside, depth = before
                escaped, local, opened, fault, text, kept = False, 0, 0, False, [], depth >= 1
            begun = not over
            if over and last and not ended:
                data = data[: -len(END)]
            outside, change, inside, escaped = structure(data, inside, escaped)
            change = np.where(outside, change, 0)
            level = depth + np.cumsum(change)
            depth += int(change.sum())
            raw = np.frombuffer(data, np.uint8)
            own = outside & (((raw == COMMA) & (level == 1)) | ((change == 1) & (level == 1)) | ((change == -1) & (level == 0)))
            # outside the array only blanks may stand, and the array is opened once, by a bracket
            apart = (level <= 0) & ~own & ~np.isin(raw, list(BLANK))
            at = np.flatnonzero(own)
            opened += int((change[at] == 1).sum())
            fault |= bool(apart.any() or (level < 0).any() or np.isin(raw[own & (change != 0)], list(b"{}")).any())
            rows, i = [], 0
            for j, comma, within in zip(at.tolist(), (raw[at] == COMMA).tolist(), (level[at] >= 1).tolist()):
                if kept:
                    rows.append((file, start, local, b"".join([*text, data[i:j]]), 0, False))
                local, kept, text, i = local + comma, within, [], j + 1
            if kept:  # what lies outside the array is no element
                text.append(data[i:])
            if over:
                if kept:
                    rows.append((file, start, local, b"".join(text), 0, False))
                rows.append((file, start, local, None, opened, fault or bool(last and (inside or depth != 0))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    known = found.join(F.broadcast(state.withColumnRenamed("file", "f").withColumnRenamed("start", "s")), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))  # a row for each split of the files
    return known.select("file", "start", "inside", "depth", "last", "ended", "value").mapInArrow(work, "file string, start long, local long, text binary, opened long, fault boolean")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, text``: the elements of JSON arrays as text with their place in the file, the same however it is split.

    Raises ``ValueError`` if a file is no array. The result is a written table.
    """
    bound_batches(spark)
    found = chunks(spark, path)
    state = settle(states(summarised(found)), "states")
    parts = settle(cut(found, state), "parts")
    ends = parts.where("text is null")
    faults = ends.groupBy("file").agg(F.max("fault").alias("fault"), F.sum("opened").alias("opened")).where("fault or opened <> 1")
    if ends.isEmpty() or not faults.isEmpty():
        forget(state, parts)
        raise ValueError(f"no JSON array: {path}")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(ends.select(F.col("file").alias("f"), F.col("start").alias("s"), F.coalesce(F.sum("local").over(earlier), F.lit(0)).alias("base"), F.col("local").alias("commas")), "bases")
    placed = parts.where("text is not null").join(F.broadcast(base), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))  # a row for each split
    numbered = placed.select("file", (F.col("base") + F.col("local")).alias("position"), "start", "text", ((F.col("local") == 0) | (F.col("local") == F.col("commas"))).alias("edge"))
    joined = numbered.where("edge").groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))  # at most two for each split
    whole = joined.select("file", "position", F.decode(F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["text"])), "UTF-8").alias("text"))
    out = settle(numbered.where("not edge").select("file", "position", F.decode("text", "UTF-8").alias("text")).unionByName(whole), "elements")
    empty = F.trim(F.translate("text", "\t\r\n", "   ")) == ""
    blank = out.where(empty).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("p")).where("n > 1 or p > 0")  # a file may be an empty array
    later = out.where(empty).select("file").join(out.where("position > 0").select("file").distinct(), "file", "left_semi")
    forget(state, parts, base)
    if not blank.isEmpty() or not later.isEmpty():
        forget(out)
        raise ValueError(f"an empty element in {path}")
    kept = out.where(~empty)
    kept._settled = out._settled
    return kept


def read(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The elements of JSON arrays as columns with their ``position``; with ``key`` a broken element without it raises ``ValueError``. The result is a written table."""
    found = elements(spark, path)
    parsed = F.from_json("text", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    out = settle(found.select("position", parsed.alias("r")).select("position", "r.*"), "records")
    forget(found)
    if key and not out.where(F.col("_corrupt_record").isNotNull() & F.col(key).isNull()).isEmpty():
        forget(out)
        raise ValueError(f"a broken record in {path}")
    return out.drop("_corrupt_record")
