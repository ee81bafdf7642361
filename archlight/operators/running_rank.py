"""The running 75th percentile of every key, by many tasks for each key.

The positive values of a key are numbered twice, by time and by value, each by ranges in many tasks. The numbers cut
time into blocks and values into buckets. Counts of values by block and bucket, summed up over the blocks before, tell
which buckets can hold the percentile while a block passes: it moves by no more places than the block has values. So a
block needs only the earlier values of those buckets, and how many earlier ones lie below them. A task holds them in a
sorted list, adds the block's own values as they come, and reads the percentile off. At most ``GRID`` blocks make a key,
so the counts stay small, and a block takes a few times its own number of values.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlight.sources.shared import forget, settle

from .positions import numbered

#: Values of a block at least, and blocks of a key at most.
BLOCK, GRID = 4096, 2048
SHARE = (3, 4)


def rank(n: int) -> int:
    """The nearest rank of the percentile among n values: the ceiling of 0.75 (n + 1), within 1 and n."""
    part, whole = SHARE
    return min(max(-(-part * (n + 1) // whole), 1), n)


def timeouts(df: DataFrame, key: str, order: list[str], value: str, floor: float, factor: float, fewest: int = 4) -> DataFrame:
    """``key, order, timeout``: before each row a multiple of the percentile of the key's earlier positive values, with a floor.

    A null or other value counts for nothing. ``order`` should tell rows of a key apart. Rows of a key that follow one
    another without a positive value between them pass one task in order, which does not hold them.
    """
    columns = list(dict.fromkeys([key, *order]))
    kinds = dict(df.dtypes)
    keys = [f"_o{i}" for i in range(len(order))]
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    rows = numbered(df.select(F.col(key).alias("_k"), *(F.col(c).alias(o) for c, o in zip(order, keys)), x.alias("_x")), keys, ["_k"], "_at")
    # how many positive values are before a row: the number of the first one at or behind it
    positive = numbered(rows.where("_x > 0").select("_k", "_at", "_x"), ["_at"], ["_k"], "_p")
    ranked = numbered(positive, ["_x", "_p"], ["_k"], "_r")
    sizes = settle(ranked.groupBy(F.col("_k").alias("_sk")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_size", F.greatest(F.lit(BLOCK), F.ceil(F.col("_n") / GRID))), "sizes")
    same = lambda: F.col("_k").eqNullSafe(F.col("_sk"))
    placed = settle(ranked.join(sizes, same()).select("_k", "_at", "_x", "_p", "_r", "_size", F.floor(F.col("_p") / F.col("_size")).alias("_block"), F.floor(F.col("_r") / F.col("_size")).alias("_bucket")), "placed")
    needed = settle(windows(placed, sizes), "windows")
    earlier = placed.select("_k", "_bucket", "_block", F.col("_x"), F.col("_p"))
    given = earlier.alias("e").join(needed.alias("w"), F.col("e._k").eqNullSafe(F.col("w._k")) & (F.col("e._bucket") == F.col("w._bucket")) & (F.col("e._block") < F.col("w._block")))
    held = given.select(F.col("w._k").alias("_k"), F.col("w._block").alias("_block"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_at"), F.col("e._x").alias("_x"), F.lit(0).cast("long").alias("_m"), F.col("w._below").alias("_below"))
    asked = counted(rows, placed).join(sizes, same(), "left").select("_k", F.coalesce(F.floor(F.col("_m") / F.col("_size")), F.lit(0)).alias("_block"), F.lit(1).alias("_kind"), "_at", "_x", "_m", F.lit(0).cast("long").alias("_below"))
    names = ["_k", "_block", "_kind", "_at", "_x", "_m", "_below"]
    dealt = held.select(*names).unionByName(asked.select(*names)).repartition("_k", "_block").sortWithinPartitions("_k", "_block", "_kind", "_at", "_x")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, values, below = None, [], 0
        for part in parts:
            told = []
            for k, block, kind, at, v, m, low in zip(*(part[c] for c in names)):
                here = (None if pd.isna(k) else k, block)
                if here != owner:
                    owner, values, below = here, [], 0
                if kind == 0:  # in order of the values
                    values.append(v)
                    below = low
                    continue
                told.append((k, at, floor if m < fewest else max(floor, values[rank(m) - 1 - below] * factor)))
                if v > 0:
                    insort(values, v)
            yield pd.DataFrame(told, columns=["_k", "_at", "timeout"])

    found = settle(dealt.mapInPandas(work, f"_k {kinds[key]}, _at long, timeout double"), "timeouts")
    # as long as the rows themselves, but often of few values and small as a file: Spark would take it for a table to broadcast
    out = rows.alias("r").join(found.hint("merge").alias("f"), F.col("r._k").eqNullSafe(F.col("f._k")) & (F.col("r._at") == F.col("f._at")))
    forget(sizes, placed, needed)
    shown = {key: F.col("r._k"), **{c: F.col(f"r.{o}") for c, o in zip(order, keys)}}
    return out.select(*(shown[c].alias(c) for c in columns), "timeout")


def counted(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``_k, _at, _x, _m``: the rows with the number of positive values before them.

    Rows are counted inside stretches of a bounded number of rows; the positive values before a stretch are one more than
    the largest number of one in an earlier stretch.
    """
    width = 4096
    stretch = F.floor(F.col("_at") / width)
    last = placed.groupBy("_k", stretch.alias("_s")).agg(F.max("_p").alias("_top"))
    # a row for each stretch of a key
    spans = rows.groupBy("_k", stretch.alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    start = spans.alias("a").join(last.alias("b"), F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a._s") == F.col("b._s")), "left").select(F.col("a._k").alias("_k"), F.col("a._s").alias("_s"), F.col("b._top").alias("_top"))
    known = based(start)
    inside = Window.partitionBy("_k", "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_s", stretch).withColumn("_in", F.coalesce(F.sum(F.when(F.col("_x") > 0, 1).otherwise(0)).over(inside), F.lit(0)))
    return own.join(known, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_s") == F.col("_bs"))).select("_k", "_at", "_x", (F.col("_base") + F.col("_in")).alias("_m"))


def based(start: DataFrame) -> DataFrame:
    """``_bk, _bs, _base``: positive values before each stretch."""
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return start.select(F.col("_k").alias("_bk"), F.col("_s").alias("_bs"), (F.coalesce(F.max("_top").over(earlier), F.lit(-1)) + 1).alias("_base"))


def windows(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``_k, _block, _bucket, _below``: the buckets whose earlier values a block needs, and how many earlier values lie below the first of them."""
    cells = placed.groupBy("_k", "_bucket", "_block").agg(F.count(F.lit(1)).alias("n"), F.max("_size").alias("_size"))
    # every later block of the key sees a cell's values: at most GRID blocks by GRID buckets
    last = F.floor((F.col("_n") - 1) / F.col("_size"))
    top = sizes.select("_sk", last.alias("_last"))
    seen = cells.join(top, F.col("_k").eqNullSafe(F.col("_sk"))).where(F.col("_block") < F.col("_last") + 1)
    spread = seen.withColumn("_for", F.explode(F.sequence(F.col("_block") + 1, F.col("_last") + 1)))
    grid = spread.groupBy("_k", F.col("_for").alias("_block"), "_bucket").agg(F.sum("n").alias("n"), F.max("_size").alias("_size"))
    by = Window.partitionBy("_k", "_block").orderBy("_bucket")
    below = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part, whole = SHARE
    start = F.col("_block") * F.col("_size")  # values before the block
    low = F.ceil(part * (start + 1) / whole) - F.col("_size") - 1
    high = F.ceil(part * (start + F.col("_size") + 1) / whole) + 1
    meets = (F.col("_below") + F.col("n") >= low) & (F.col("_below") < high)
    kept = grid.withColumn("_below", below).where(meets)
    first = Window.partitionBy("_k", "_block")
    return kept.select("_k", "_block", "_bucket", F.min("_below").over(first).alias("_below"))
