"""Dense numbering over many partitions."""

from __future__ import annotations

import random

import pytest

from archlight.operators.positions import numbered
from archlight.sources import shared


@pytest.mark.parametrize("size", [0, 1, 500])
def test_numbered(spark, size):
    dice = random.Random(size)
    rows = [(dice.choice(["a", "a", "a", None, "b"]), dice.choice([None, *range(40)]), i) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    first = lambda x: (x is not None, x)
    got = {r["i"]: r["n"] for r in numbered(df, ["k", "i"], ["g"], "n").collect()}
    for g in ("a", "b", None):
        assert [got[r[2]] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2]))] == list(range(sum(r[0] == g for r in rows)))
    whole = {r["i"]: r["position"] for r in numbered(df, ["i"]).collect()}
    assert whole == {i: i for i in range(size)}


def test_shared_tables(spark, monkeypatch):
    monkeypatch.setattr(shared, "MADE", set())
    one, two = (shared.settle(spark.range(n), "t") for n in (3, 4))
    assert (one.count(), two.count()) == (3, 4) and len(shared.MADE) == 2
    shared.forget(one)
    assert shared.MADE == {two._settled} and shared.release(spark) == 1 and shared.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not_exist|not_found"):
        spark.read.parquet(two._settled)
