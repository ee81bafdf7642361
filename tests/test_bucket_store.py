"""Upserts into buckets."""

from __future__ import annotations

import os

from archlight.sources import bucket_store as B


def files_of(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_upsert(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id long, v string, n int")
    assert len(B.upsert(rows(*((k, "a", 0) for k in range(100))), base, ["id"], buckets=8)) == 8
    before = files_of(base)
    touched = B.upsert(rows((3, "b", 1), (3, "c", 2), (500, "new", 0)), base, ["id"], ["n"], buckets=99)
    assert len(touched) <= 2 and B.state(spark, base)[0] == 2
    got = {r["id"]: r["v"] for r in B.read(spark, base).collect()}
    assert len(got) == 101 and got[3] == "c" and got[500] == "new" and got[4] == "a" and B.read(spark, base).count() == 101
    # untouched buckets keep their files, and a version that is named no more goes
    _, said = B.state(spark, base)
    assert sum(f.startswith(said["folders"][str(touched[0])].split("/")[0]) for f in said["folders"].values()) == len(touched)
    assert before < files_of(base)
    assert B.vacuum(spark, base, 1) == len(touched) and before - files_of(base) and B.read(spark, base).count() == 101


def test_a_quicker_writer(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id long, v string")
    B.upsert(rows((1, "a"), (2, "a")), base, ["id"], buckets=2)
    real, calls = B.put, []

    def late(session, where, number, said):
        calls.append(number)
        if len(calls) == 1:  # another writer publishes this number first
            monkeypatch.setattr(B, "put", real)
            B.upsert(rows((1, "other")), base, ["id"])
        return real(session, where, number, said)

    monkeypatch.setattr(B, "put", late)
    B.upsert(rows((2, "mine")), base, ["id"])
    assert {r["id"]: r["v"] for r in B.read(spark, base).collect()} == {1: "other", 2: "mine"} and B.state(spark, base)[0] == 3


def test_new_rows_are_shuffled_once(spark, tmp_path):
    """A new table costs one shuffle of its rows and one of the buckets' numbers."""
    tracker = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: tracker.executorList(False).apply(0).totalShuffleWrite()
    df = spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 512) v")
    before = written()
    df.repartition(4).write.parquet(str(tmp_path / "plain"))
    once = written() - before
    B.upsert(df, str(tmp_path / "t"), ["id"], buckets=4)
    assert written() - before - once < 1.6 * once
    assert B.read(spark, str(tmp_path / "t")).count() == 20_000
