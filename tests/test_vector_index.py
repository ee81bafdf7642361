"""The inverted file against comparing all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlight.operators import vector_index as V


def plain(rows, asked, k):
    out = {}
    for q, x in asked:
        near = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), i) for i, y in rows)[:k]
        out[q] = [i for _, i in near]
    return out


def given(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 7) for i, v in rows], "id long, embedding array<double>, kind int").repartition(4)


def told(found):
    out = {}
    for r in found.orderBy("query", "place").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    dice = np.random.default_rng(3)
    centres = dice.standard_normal((40, 16))
    rows = [(i, centres[i % 40] + 0.35 * dice.standard_normal(16)) for i in range(3000)]
    odd = spark.createDataFrame([(9001, None, 0), (9002, [1.0], 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0)], "id long, embedding array<double>, kind int")
    df = given(spark, rows).unionByName(odd)
    return rows, df, V.build(df, str(tmp_path_factory.mktemp("index") / "x"), cells=32)


def test_exact(spark, clustered, monkeypatch):
    rows, df, index = clustered
    monkeypatch.setattr(V, "BLOCK", 50)  # cells of several blocks
    asked = [r for r in rows if r[0] % 20 == 0]
    got = told(V.search(index, df.where("id % 20 = 0 or id > 9000"), 5, probes=32))
    assert got == plain(rows, asked, 5)
    some = told(V.search(index, df.where("id % 20 = 0"), 3, probes=32, condition=F.col("kind") == 2))
    assert some == plain([r for r in rows if r[0] % 7 == 2], asked, 3)


def test_recall(spark, clustered):
    rows, df, index = clustered
    assert index.postings.count() == 3000 and index.probes() < 16
    want = plain(rows, [r for r in rows if r[0] % 20 == 0], 10)
    got = told(V.search(index, df.where("id % 20 = 0"), 10))
    assert set(got) == set(want) and sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    # a filter that leaves too few rows in the cells probed falls back to all cells
    rare = told(V.search(index, df.where("id % 20 = 0"), 4, probes=1, condition=F.col("id") < 12))
    assert rare == plain(rows[:12], [r for r in rows if r[0] % 20 == 0], 4)


def test_none(spark, tmp_path):
    none = given(spark, [(1, [1.0, 2.0])]).where("false")
    assert V.search(V.build(none, str(tmp_path / "a")), none, 3).count() == 0
    one = given(spark, [(1, [1.0, 2.0])])
    assert told(V.search(V.build(one, str(tmp_path / "b")), one, 3)) == {1: [1]}
