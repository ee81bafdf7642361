"""JSON arrays in ranges, single-file sinks and directory listings."""

from __future__ import annotations

import csv
import json
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archlight.sources import file_listing, files, json_array, single_file


def value(dice, depth=0):
    k = dice.random()
    if k < 0.5 or depth > 3:
        return "".join(dice.choice('ab"\\{}[], \n\té中🤖') for _ in range(dice.randint(0, 30)))
    if k < 0.6:
        return dice.choice([None, True, 1.5, -7])
    if k < 0.8:
        return [value(dice, depth + 1) for _ in range(dice.randint(0, 3))]
    return {value(dice, 4): value(dice, depth + 1) for _ in range(dice.randint(0, 3))}


@pytest.fixture
def splits(spark):
    """Splits of any size, whatever the cores ask for."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for n, v in zip(names, (size, 1, 1)):
            spark.conf.set(n, str(v))

    yield cut
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize(("indent", "size"), [(None, 333), (2, 1500), (None, 1 << 27)])
def test_ranges_of_an_array(spark, splits, tmp_path, indent, size):
    dice = random.Random(size)
    rows = [{"i": k, "x": value(dice)} for k in range(60)]
    rows[7]["x"] = {"long": '}{"[' * 800}  # goes on over several ranges
    rows[20:20] = ['just "text" } ]', [1, {"a": []}], None, 4.5]
    path = str(tmp_path / "a.json")
    with open(path, "w") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=indent is None)
    splits(size)
    assert (json_array.chunks(spark, path).rdd.getNumPartitions() > 5) == (size < 1 << 20)
    got = sorted((r["position"], r["text"]) for r in json_array.elements(spark, path).collect())
    assert [p for p, _ in got] == list(range(64)) and [json.loads(t) for _, t in got] == rows


class Taken:
    """Stands for a frame and gives the function that its tasks run."""

    def __getattr__(self, name):
        return lambda *a, **b: self

    def mapInArrow(self, work, schema):
        return work


def works(spark):
    state = spark.createDataFrame([], "file string, start long, inside boolean, depth long, last boolean, ended boolean")
    return json_array.summarised(Taken()), json_array.cut(Taken(), state)


def fed(values, *heads):
    """Chunks of one range in batches."""
    for at in range(0, len(values), 100):
        part = values[at : at + 100]
        yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(part)) for x in heads), pa.array(part, pa.binary())], names=[*map(str, range(len(heads))), "value"])


def test_memory_of_a_range(spark):
    """What a task holds of a range does not grow with it."""
    summary, cut = works(spark)
    element = b'{"a": "' + b'b\\\\"c' * 600 + b'", "d": [1, 2]'
    n = 8_000
    values = [b"[" + element, *[b"," + element] * (n - 1), b"]"]
    size = sum(map(len, values)) + n

    def most(rows):
        tracemalloc.start()
        try:
            return sum(b.num_rows for b in rows), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    told, peak = most(summary(fed(values, "f", 0, size)))
    assert told == 1 and peak < size
    told, peak = most(cut(fed(values, "f", 0, False, 0, True, False)))
    assert told == n + 1 and peak < size


@pytest.mark.parametrize("piece", [1, 2, 7, 100, 1 << 18])
def test_pieces_of_a_range(spark, monkeypatch, piece):
    """Pieces may begin in an escape, a string, an element or a character of several bytes."""
    monkeypatch.setattr(json_array, "PIECE", piece, raising=False)
    summary, cut = works(spark)
    dice = random.Random(piece)
    rows = [value(dice) for _ in range(40)] + ['\\' * 9 + '"' * 5 + "中" * 20]
    data = (" " + json.dumps(rows, ensure_ascii=False) + "\n").encode()
    values = data.split(b"}")
    [row] = [r for b in summary(fed(values, "f", 0, len(data))) for r in b.to_pylist()]
    assert (row["odd"], row["outside"], row["bytes"], row["chunks"]) == (0, -1, len(data) - len(values) + 1, len(values))  # the last chunk has no bracket in the file
    found = [r for b in cut(fed(values, "f", 0, False, 0, True, False)) for r in b.to_pylist()]
    assert [(r["local"], json.loads(r["text"])) for r in found[:-1]] == list(enumerate(rows))
    assert found[-1] == {"file": "f", "start": 0, "local": len(rows) - 1, "text": None, "opened": 1, "fault": False}
    *_, end = [r for b in cut(fed(values[:-1], "f", 0, False, 0, True, True)) for r in b.to_pylist()]
    assert end["fault"]
    # what a range does to a state inside a string
    inner = [b'x\\"y", [1', b'2"], "z]']
    [row] = [r for b in summary(fed(inner, "f", 9, 99)) for r in b.to_pylist()]
    assert (row["outside"], row["within"], row["odd"]) == (-1, -2, 1)


def test_what_is_no_array(spark, splits, tmp_path):
    splits(9)
    path = str(tmp_path / "a.json")
    for bad in ("  ", "{}", "[1,,2]", '[{"a":1}]}', '[{"a":1}', "[1][2]", '[{"a":"x}]'):
        with open(path, "w") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            json_array.elements(spark, path)
    for good, n in ((" [ ]\n", 0), ('[{"a":"}"},{"b":"]"} ] ', 2)):
        with open(path, "w") as f:
            f.write(good)
        assert json_array.elements(spark, path).count() == n


def test_single_files(spark, tmp_path):
    dice = random.Random(1)
    rows = [(k, value(dice, 4), ['a"b', str(k)]) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, t string, l array<string>").repartition(5)
    whole, table = str(tmp_path / "o" / "a.json"), str(tmp_path / "a.csv")
    single_file.write_json(df, whole, ["k"])
    single_file.write_csv(df, table, ["k"])
    with open(whole) as f:
        assert [(r["k"], r["t"], r["l"]) for r in json.load(f)] == rows
    with open(table, newline="") as f:
        found = list(csv.reader(f))
        assert found[0] == ["k", "t", "l"] and [(int(k), t, json.loads(x)) for k, t, x in found[1:]] == rows
    with open(table) as f:
        assert f.readline() == '"k","t","l"\n' and f.readline().startswith('"0","')
    with pytest.raises(Exception, match="division"):  # a task that fails leaves the former file
        single_file.write_json(df.withColumn("x", F.udf(lambda k: 1 // (k - 70), "int")("k")), whole, ["k"])
    with open(whole) as f:
        assert len(json.load(f)) == 100 and {n for n in os.listdir(tmp_path / "o") if not n.endswith(".crc")} == {"a.json"}
    single_file.write_json(df.where("k = 3"), whole, ["k"])
    with open(whole) as f:
        assert [r["k"] for r in json.load(f)] == [3]
    single_file.write_json(df.where("false"), whole, ["k"])
    with open(whole) as f:
        assert json.load(f) == []


def test_parts_where_a_store_joins_none(spark, tmp_path):
    """A local file system has no concatenation of its own: several parts go through the buffer."""
    path = str(tmp_path / "a.json")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        single_file.write_json(spark.range(100).repartition(3), path, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with open(path) as f:
        assert [r["id"] for r in json.load(f)] == list(range(100))


def test_listing(spark, tmp_path, monkeypatch):
    for d in ("a/b", "a/c", "d/.hidden", "e"):
        (tmp_path / d).mkdir(parents=True)
        for k in range(3):
            (tmp_path / d / f"{k}.txt").write_text("x" * 10 * k)
    root = str(tmp_path)
    all_, of = file_listing.list_files(spark, root), lambda c: file_listing.list_files(spark, root, c)
    assert all_.count() == 12 and all_.where("readable").count() == 12
    some = of(F.col("path").startswith(f"{root}/a/") & (F.col("size") > 10))
    assert sorted(r["path"] for r in some.collect()) == [f"{root}/a/b/2.txt", f"{root}/a/c/2.txt"]
    assert of(F.col("path").isin(f"{root}/e/1.txt", f"{root}/none")).count() == 1
    assert of(F.col("path").endswith("0.txt") & (F.col("size") <= 0)).count() == 4 and some.unionByName(all_.where("size > 10")).count() == 6
    # what the predicates leave out is not listed, nor opened
    reader = file_listing.Reader(root, 1)
    assert list(reader.pushFilters([file_listing.StringStartsWith(("path",), f"{root}/a/c"), file_listing.GreaterThan(("size",), 5)])) == []
    seen = []
    monkeypatch.setattr(file_listing, "local_entries", lambda d, real=file_listing.local_entries: seen.append(d) or real(d))
    assert [f[0] for t in reader.partitions() for f in (reader.walk(t.root) if t.root else t.files)] == [f"{root}/a/c/1.txt", f"{root}/a/c/2.txt"]
    assert seen == [root, f"{root}/a", f"{root}/a/c"]
    found = files.scan(spark, root, condition=F.col("size") >= 20).select("file_path", "file_size").collect()
    assert len(found) == 4 and all(r["file_size"] == 20 for r in found)
    by_uri = file_listing.list_files(spark, f"file://{root}")
    assert sorted(r["path"] for r in by_uri.collect()) == sorted(f"file://{r['path']}" for r in all_.collect())
    assert files.digests(by_uri).count() == 12


def test_texts_of_a_tree(spark, tmp_path):
    """Tasks write the files of a tree themselves; many directories are dealt to a bounded number of partitions, files come in path order."""
    rows = [(f"{tmp_path}/{k % 90}/{k % 3}.txt", k, f"é{k}\r") for k in range(400)]
    df = spark.createDataFrame(rows, "path string, k long, text string").repartition(5)
    for uri in ("", "file://"):
        files.write_texts(df.withColumn("path", F.concat(F.lit(uri), "path")), "k")
        found = {os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names}
        assert found == {r[0] for r in rows}
        for path in found:
            with open(path, newline="") as f:
                assert f.read() == "".join(t + "\n" for p, _, t in rows if p == path)
    assert len(file_listing.Reader(str(tmp_path), 8).partitions()) == 8
    scanned = [r["file_path"] for r in files.scan(spark, str(tmp_path)).collect()]
    assert scanned == sorted(found)


def test_batches_of_contents_are_bounded(spark):
    """Contents of files go to Python in batches of bounded size, and texts come back in small ones."""
    from archlight.sources import decoders

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        df = spark.range(900).select(F.col("id").cast("string").alias("path"), F.lit("text/plain").alias("mime_type"), F.encode(F.lit("a b"), "UTF-8").alias("content"))
        for f in (decoders.extract, files.expand_archives):
            spark.conf.set(name, "10000")
            assert f(df).count() == 900 and int(spark.conf.get(name)) <= 2000
    finally:
        spark.conf.set(name, before)
