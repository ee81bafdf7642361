"""The running percentile in blocks against a plain one."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from archlight.operators import running_rank


def plain(rows):
    out, past = {}, {}
    for k, t, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        v = sorted(past.setdefault(k, []))
        n = len(v)
        out[k, t] = 60.0 if n < 4 else max(60.0, 5.0 * v[min(max(math.ceil(0.75 * (n + 1)), 1), n) - 1])
        if x is not None and x > 0:
            past[k].append(x)
    return out


@pytest.mark.parametrize(("block", "grid", "size"), [(4096, 2048, 200), (7, 2048, 600), (5, 12, 900), (4096, 2048, 0)])
def test_timeouts(spark, monkeypatch, block, grid, size):
    monkeypatch.setattr(running_rank, "BLOCK", block)
    monkeypatch.setattr(running_rank, "GRID", grid)
    dice = random.Random(block)
    rows = [(dice.choice(["hot", "hot", "hot", "hot", "b", None]), t, dice.choice([None, 0.0, -1.0, float(t), dice.uniform(0, 90), 20.0, 30.0, dice.expovariate(0.02)])) for t in range(size)]
    df = spark.createDataFrame(rows, "u string, t long, x double").repartition(3)
    got = {(r["u"], r["t"]): r["timeout"] for r in running_rank.timeouts(df, "u", ["t"], "x", 60.0, 5.0).collect()}
    assert got == pytest.approx(plain(rows))


def test_a_key_in_many_blocks(spark, monkeypatch):
    """A key with all rows: a block holds a few times its own number of values."""
    monkeypatch.setattr(running_rank, "BLOCK", 50)
    df = spark.range(4000).select(F.lit("u").alias("_k"), F.col("id").alias("_at"), (F.hash("id") % 1000 + 1001).cast("double").alias("_x"), F.col("id").alias("_p"))
    ranked = running_rank.numbered(df, ["_x", "_p"], ["_k"], "_r").selectExpr("*", "50L _size", "floor(_p / 50) _block", "floor(_r / 50) _bucket")
    sizes = spark.createDataFrame([("u", 4000, 50)], "_sk string, _n long, _size long")
    needed = running_rank.windows(ranked, sizes)
    held = ranked.alias("e").join(needed.alias("w"), F.expr("e._bucket = w._bucket and e._block < w._block")).groupBy("w._block").count()
    row = held.agg(F.max("count"), F.count("*")).first()
    assert row[0] <= 6 * 50 and row[1] >= 79


def test_rows_are_not_broadcast(spark):
    """Equal timeouts of all rows make a tiny file; the rows it is joined to are as many as those of the table."""
    df = spark.range(5000).select((F.col("id") % 7).alias("u"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    out = running_rank.timeouts(df, "u", ["t"], "x", 60.0, 5.0)
    assert out.count() == 5000 and out.where("timeout = 60").count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
