"""Dense numbers for the rows of a distributed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlight.sources.shared import forget, settle

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], by: list[str] = (), name: str = "position") -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the given order, within each group of ``by``, nulls first and alike.

    Rows are dealt out by ranges of ``by`` and ``order`` and sorted inside their partition; the rows of every group in
    every partition are counted and the counts summed over the partitions before. What goes through one task are these
    counts, one for each partition and group in it, so a group of any size is numbered by many tasks. Rows equal in
    ``order`` are numbered in any order, always the same one, as the numbers come from a written table.
    """
    keys = [*by, *order]
    placed = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_row", ROW_BITS)
    runs = placed.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(runs.select(*(F.col(c).alias(f"_{c}") for c in by), "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "starts")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), part == F.col("_part"))
    out = placed.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name))
    final = settle(out, "numbered")
    forget(placed, starts)
    return final
