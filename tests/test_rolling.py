"""Keyed state of a stream against the batch operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from archlight.operators import metrics
from archlight.streaming import rolling


@pytest.mark.parametrize("idle", [None, 10_000_000, 30_000])
def test_rolling(spark, tmp_path, idle):
    """A key that is idle for long is forgotten; with a long patience, or none asked, rows are those of the batch operator."""
    dice = random.Random(4)
    rows = [("b" if t in (3, 110) else "a", t, dice.choice([None, 1.0, 2.5, float(t)])) for t in range(120)]
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame(rows, "k string, t long, x double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    for low, high in ((0, 50), (50, 100), (100, 120)):
        df.where(f"t >= {low} and t < {high}").write.mode("append").parquet(source)
        arriving = spark.readStream.schema(df.schema).parquet(source).withWatermark("ts", "0 seconds")
        rolling.write(rolling.moving_average(arriving, "k", ["ts"], "x", "ts" if idle else None, idle or 0), target, checkpoint)
    shown = lambda d: {(r["k"], r["ts"]): (None if r["recent_avg"] is None else round(r["recent_avg"], 9), r["recent_n"]) for r in d.collect()}
    got, want = shown(spark.read.parquet(target)), shown(metrics.moving_average(df, "k", ["ts"], "x"))
    late = max(k for k in want if k[0] == "b")
    if idle == 30_000:
        x = rows[110][2]
        want[late] = (x, 0 if x is None else 1)
    assert got == want


@pytest.mark.parametrize("idle", [None, 40_000])
def test_keys_share_buckets(spark, tmp_path, monkeypatch, idle):
    """Many keys in few buckets, a null one among them: a bucket is one group of the stream, its keys are counted and forgotten apart."""
    monkeypatch.setattr(rolling, "BUCKETS", 2)
    dice = random.Random(9)
    # late keys come once at the start and once after all patience
    rows = [(None if k == 0 else k, t, dice.choice([None, 1.0, -2.5, float(t)])) for t in range(150) for k in range(30) if (t % 3 or k > 9) and (k < 25 or t in (5, 140))]
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame(rows, "k long, t long, x double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    for low, high in ((0, 60), (60, 120), (120, 150)):
        df.where(f"t >= {low} and t < {high}").write.mode("append").parquet(source)
        arriving = spark.readStream.schema(df.schema).parquet(source).withWatermark("ts", "0 seconds")
        rolling.write(rolling.moving_average(arriving, "k", ["ts"], "x", "ts" if idle else None, idle or 0), target, checkpoint)
    shown = lambda d: {(r["k"], r["ts"]): (None if r["recent_avg"] is None else round(r["recent_avg"], 9), r["recent_n"]) for r in d.collect()}
    got, want = shown(spark.read.parquet(target)), shown(metrics.moving_average(df, "k", ["ts"], "x"))
    if idle:
        kept = df.where("k is null or k < 25").unionByName(df.where("k >= 25 and t > 100"))
        want |= shown(metrics.moving_average(kept, "k", ["ts"], "x"))
    assert len(want) == len(rows) and got == want
    spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "recent").load().createOrReplaceTempView("kept_state")
    assert spark.sql("select count(distinct key) from kept_state").first()[0] == 2
