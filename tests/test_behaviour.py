"""Operators on small inputs: the behaviour of known cases."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archlight.functions import formats, predicates, schema, tasks
from archlight.functions import text as X
from archlight.operators import analyze, catalog, merging, metrics, retrieval, tabular
from archlight.sources import bucket_store, catalog_files, decoders, files
from archlight.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def record(**more):
    return {"file_path": "/a/b.txt", "file_name": "b.txt", "mime_type": "text/plain", "file_size": 3, "last_modified": 1.0, "sha256": "ab", "status": "complete"} | more


def frame(spark, *records):
    """Typed records with an index."""
    raw = spark.read.schema(schema.loose_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 1))
    return schema.normalize(raw.withColumn("manifest_idx", F.monotonically_increasing_id()))


def task(name, status="complete", version=1):
    return {"name": name, "status": status, "error_message": "x" if status == "error" else None, "version": version}


ALL = [task(n, version=v) for n, v in (("text_analysis", 1), ("people_analysis", 1), ("estate_analysis", 2), ("password_detection", 5), ("financial_analysis", 1))]


@pytest.mark.parametrize(
    "record_, count, status",
    [
        (record(extracted_text="t"), 5, "pending_analysis"),
        (record(extracted_text="t", mime_type="image/jpeg", analysis_tasks=[task("image_description", version=0)]), 7, "pending_analysis"),
        (record(analysis_tasks=[task("people_analysis", version=0)]), 1, "pending_analysis"),
        (record(extracted_text="t", analysis_tasks=ALL), 0, "complete"),
        (record(status="failed", analysis_tasks=[task("text_analysis", "error", 0)]), 1, "pending_analysis"),
        (record(status="error", analysis_tasks=[task("text_analysis", "error", 0)]), 1, "error"),
    ],
)
def test_reset_outdated(spark, record_, count, status):
    row = tasks.reset_outdated(frame(spark, record_)).first()
    assert (row["reset_count"], row["status"]) == (count, status)
    assert all(t["error_message"] is None for t in row["analysis_tasks"] if t["status"] == "pending")


def test_reset_clears_payloads(spark):
    row = tasks.reset_outdated(frame(spark, record(contains_password=True, passwords=[{"context": "a", "password": "b"}], analysis_tasks=[task("password_detection", version=4)]))).first()
    assert row["contains_password"] is None and row["passwords"] == []


@pytest.mark.parametrize(
    "mime, path, text, names",
    [
        ("text/plain", "a.txt", False, []),
        ("application/octet-stream", "a", True, list(tasks.TEXT_TASKS)),
        ("video/x-ms-asf", "a.ASX", False, []),
        ("video/mp4", "a.mp4", False, ["video_summary", "nsfw_classification"]),
        ("image/png", "a.png", False, ["image_description", "nsfw_classification"]),
        ("application/zip", "a.zip", False, []),
        ("Application/X-MSAccess", "a.mdb", True, [*tasks.TEXT_TASKS, "access_db_analysis"]),
        (None, "a", False, []),
    ],
)
def test_required(spark, mime, path, text, names):
    assert one(spark, tasks.required(F.lit(mime).cast("string"), F.lit(path), F.lit(text))) == names


def test_rescan(spark):
    row = tasks.rescan(frame(spark, record(extracted_text="t", summary="s", passwords=[{"context": "a", "password": "b"}]))).first()
    assert row["extracted_text"] is None and row["summary"] is None and row["passwords"] == [] and row["status"] == "pending_extraction"
    assert [t["status"] for t in row["analysis_tasks"]] == ["pending"] * 5


def test_normalize(spark):
    row = frame(spark, record(summary={"name": "John", "favorite_food": "Pizza"}, passwords={"mail": "pw"}, potential_red_flags="late", incriminating_items=None, estate_information={"Legal": [{"item": "Will"}], "Odd": "text"})).first()
    assert row["summary"] == '{"favorite_food": "Pizza", "name": "John"}'
    assert [tuple(p) for p in row["passwords"]] == [("mail", "pw")]
    assert row["potential_red_flags"] == ["late"] and row["incriminating_items"] == []
    assert row["estate_information"] == {"Legal": [{"item": "Will"}]}


@pytest.mark.parametrize(
    "conditions, kept",
    [
        ({"hide_nsfw": True}, [1, 2]),
        ({"file_types": ("image/png",)}, [0]),
        ({"red_flags": True}, [1]),
        ({"fully_analyzed": True}, [0]),
        ({"required_tasks": ("text_analysis",)}, [0, 1]),
        ({"no_tasks_complete": True}, [2]),
        ({}, [0, 1, 2]),
    ],
)
def test_filters(spark, conditions, kept):
    m = frame(
        spark,
        record(is_nsfw=True, mime_type="image/png", analysis_tasks=[task("text_analysis")]),
        record(has_financial_red_flags=True, analysis_tasks=[task("text_analysis"), task("people_analysis", "pending")]),
        record(mime_type=None),
    ).withColumn("manifest_idx", F.row_number().over(__import__("pyspark.sql").sql.Window.orderBy("manifest_idx")) - 1)
    found = m.where(predicates.CatalogFilter(**({"hide_nsfw": False} | conditions)).condition())
    assert sorted(r["manifest_idx"] for r in found.collect()) == kept


def test_search(spark):
    m = frame(spark, record(file_path="/tmp/Reports/a.txt"), record(file_path="/tmp/notes/b.txt"))
    assert m.where(predicates.search(" reports ")).count() == 1
    assert m.where(predicates.search("  ")).count() == 0
    assert m.where(predicates.search("%")).count() == 0
    assert predicates.search_with_fallback(m, "notes").count() == 1  # nothing is open: the whole catalog is searched
    assert predicates.search_with_fallback(m, "absent").count() == 0


@pytest.mark.parametrize("n, shown", [(None, "Unknown"), (0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 * 1024**3, "5.0 GB"), (2 * 1024**6, "2.0 EB")])
def test_bytes(spark, n, shown):
    assert one(spark, formats.human_bytes(F.lit(n).cast("long"))) == shown


@pytest.mark.parametrize("s, shown", [(None, "—"), (0, "0s"), (-5, "0s"), (60, "1m"), (3600, "1h"), (3661, "1h 1m 1s"), (3605, "1h 5s")])
def test_duration(spark, s, shown):
    assert one(spark, formats.duration(F.lit(s).cast("long"))) == shown


def test_labels(spark):
    assert one(spark, formats.eta(F.lit(None).cast("long"))) == "Collecting" and one(spark, formats.eta(F.lit(0))) == "Any moment now"
    assert one(spark, formats.rate(F.lit(2.25), "files/min")) == "2.2 files/min" and one(spark, formats.rate(F.lit(0.0), "x")) == "—"
    assert one(spark, formats.seconds(F.lit(1.25))) == "1.2s"


def test_text(spark):
    assert one(spark, X.summary(F.lit("  "))) == X.NO_TEXT and one(spark, X.summary(F.lit(None).cast("string"))) == X.NO_TEXT
    assert one(spark, X.summary(F.lit("One. Two! Three?"))) == "One. Two!"
    assert len(one(spark, X.summary(F.lit("x" * 500)))) == 400
    assert one(spark, X.sentiment(X.sentiment_score(F.lit("Loss and decline hurt profit.")))) == "negative"
    assert one(spark, X.sentiment_score(F.lit(""))) == 0.0 and one(spark, X.sentiment_score(F.lit(None).cast("string"))) == 0.0
    assert one(spark, X.entities(F.lit("Anna Meyer met Bob. Anna Meyer left."))) == ["Anna Meyer", "Bob"]
    assert one(spark, X.chunks(F.lit("a b c d e"), 2)) == ["a b", "c d", "e"] and one(spark, X.chunks(F.lit(" "), 2)) == []
    assert X.chunk_size() == 614 and X.effective_limit(614) == 341
    assert one(spark, X.svg_texts(F.lit("<text>Hello</text><tspan>World &amp; all</tspan>"))) == "Hello\nWorld & all"


@pytest.mark.parametrize(
    "reply, part",
    [('say {"a": [1, 2]} end', '{"a": [1, 2]}'), ('x ["}"] y', '["}"]'), ('{"a": "\\"}"}', '{"a": "\\"}"}'), ("none", None), ("{ open", None), (None, None), ("{a ] b}", None), ("{ ] [1] x", "{ ] [1]"), ('a ["🤖", {"b": "]"}] ]', '["🤖", {"b": "]"}]'), ('{"open string', None), ("[" * 500 + "]" * 500, "[" * 500 + "]" * 500)],
)
def test_json_segment(spark, reply, part):
    assert one(spark, X.json_segment(F.lit(reply).cast("string"))) == part


def test_json(spark):
    assert one(spark, X.strip_fences(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, X.parse_reply(F.lit('Sure: {"a":1}.'))) == '{"a":1}' and one(spark, X.parse_reply(F.lit("nothing"))) is None
    assert one(spark, X.parse_reply(F.lit('{"a":1} as asked ]'))) == '{"a":1}' and one(spark, X.parse_reply(F.lit('"a": [1]} b'))) == "[1]" and one(spark, X.parse_reply(F.lit("3"))) == "3"


def test_merges(spark):
    parts = spark.createDataFrame([(1, 1, "b", ["x"], 80), (1, 0, "a", ["y", "x"], 81)], "k long, chunk int, summary string, people array<string>, confidence int")
    assert tuple(merging.merge_text(parts, "k").first())[1:] == ("a b", ["x", "y"])
    fin = parts.withColumns({"red_flags": F.col("people"), "items": F.array().cast("array<string>")})
    assert merging.merge_financial(fin, "k").first()["confidence"] == 80


def test_tabular(spark):
    t = spark.createDataFrame([("a", "1.5", "2024-01-05", True), ("b", "x", "2024-01-09", None), ("c", "2", "soon", True)], "Name string, Amount string, CreatedDate string, Flag boolean")
    got = {r["metric"]: r for r in tabular.numeric_profile(t).collect()}
    assert got["Amount"]["total"] == 3.5 and got["Flag"]["total"] == 2.0 and got["Amount"]["record_count"] == 3
    assert tabular.date_column(t) == "CreatedDate"
    assert {(r["month"], r["metric"], r["total"]) for r in tabular.monthly_trend(t).collect()} == {("2024-01", "Amount", 1.5), ("2024-01", "Flag", 1.0)}
    assert tabular.date_column(t.select("Name")) is None and tabular.numeric_profile(t.limit(0)).count() == 0


def test_dedup(spark):
    m = frame(spark, record(file_path="/long/path.txt"), record(file_path="/p.txt"), record(file_path=None), record(file_path="/other", sha256=""), record(file_path="/p.txt"))
    plan = {(r["file_path"], r["action"]) for r in catalog.removal_plan(m).collect()}
    assert plan == {("/p.txt", "keep"), ("/p.txt", "remove entry: same path"), ("/long/path.txt", "delete file"), (None, "remove entry: no path")}
    assert catalog.pruned(m).count() == 2
    assert catalog.removal_plan(frame(spark, record(file_path=None), record(file_path=None))).count() == 0


def test_retrieval(spark):
    parts = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (1, [0.3, 0.4, 0.5])], "id long, embedding array<double>")
    assert [round(x, 6) for x in retrieval.mean_pool(parts, "id").first()["embedding"]] == [0.2, 0.3, 0.4]
    assert one(spark, retrieval.hashed_embedding(F.lit(None).cast("string"), 4)) == [0.0] * 4
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    assert [r["id"] for r in retrieval.top_k(v, [1.0, 0.0], 2).collect()] == [1, 2]


def test_plans(spark, sf):
    from archlight.sources.catalog_tables import QUERY_VECTOR, manifest, vectors

    plan = retrieval.top_k(vectors(spark, sf), QUERY_VECTOR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = catalog.per_mime_limit(manifest(spark, sf), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("n, kept", [(3, 3), (15, 15)])
def test_retention_small(n, kept):
    now = datetime(2025, 6, 11, 12)
    assert sum(metrics.tiers([now - timedelta(hours=i) for i in range(n)], now)) == kept


def test_retention_tiers():
    now = datetime(2025, 6, 11, 12)
    hours = [0, 1, 2, 25, 26, 49, 73, 97, 24 * 10, 24 * 11, 24 * 17, 24 * 24, 24 * 40, 24 * 41, 24 * 70, 24 * 100, 24 * 130, 24 * 160]
    kept = metrics.tiers([now - timedelta(hours=h) for h in hours], now)
    assert kept[:3] == [True] * 3 and sum(kept) <= 15 and kept[3] != kept[4] or not kept[4]
    assert sum(k for k, h in zip(kept, hours) if h > 24 * 30) >= 4


def tree(tmp_path):
    (tmp_path / "subdir").mkdir()
    (tmp_path / "file1.txt").write_text("This is a text file.")
    (tmp_path / "file2.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "file3.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "archive.zip").write_bytes(b"not a zip")
    (tmp_path / "subdir" / "file4.mov").write_bytes(b"mov")
    (tmp_path / ".hidden").write_bytes(b"")
    return str(tmp_path)


def test_scan(spark, tmp_path):
    rows = files.scan(spark, tree(tmp_path)).collect()
    names = [r["file_name"] for r in rows]
    assert names == [".hidden", "archive.zip", "file1.txt", "file2.jpg", "file3.pdf", "file4.mov"]
    by = {r["file_name"]: r for r in rows}
    import hashlib

    assert by["file1.txt"]["sha256"] == hashlib.sha256(b"This is a text file.").hexdigest()
    assert by["file2.jpg"]["mime_type"] == "image/jpeg" and by["file4.mov"]["mime_type"] == "video/quicktime" and by[".hidden"]["file_size"] == 0
    assert [t["name"] for t in by["file2.jpg"]["analysis_tasks"]] == ["image_description", "nsfw_classification"]
    assert files.scan(spark, str(tmp_path), 2).count() == 2
    assert files.scan_store(spark, str(tmp_path)).count() == 5
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "absent"))


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w:gz") as t:
        for name, data in (("inner.zip", inner.getvalue()), ("plain.txt", b"plain")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([("a.tar.gz", bytearray(outer.getvalue())), ("b.gz", bytearray(gzip.compress(b"b"))), ("c.zip", bytearray(b"broken"))], "path string, content binary")
    got = {(r["path"], r["member"], bytes(r["content"]), r["depth"]) for r in files.expand_archives(df).collect()}
    assert got == {("a.tar.gz", "inner.zip!/deep.txt", b"deep", 2), ("a.tar.gz", "plain.txt", b"plain", 1), ("b.gz", "b", b"b", 1), ("c.zip", "", b"broken", 0)}


def test_decoders(spark):
    assert decoders.rtf(rb"{\rtf1{\fonttbl x}This is some {\b bold} text.\par}") == "This is some bold text.\n"
    assert decoders.plain(b"caf\xe9") == "café" and decoders.svg(b"<svg><text>Hi</text></svg>") == "Hi" and decoders.svg(b"<svg") == "<svg"
    assert decoders.pdf_page("short", lambda: "ocr") == "ocr" and decoders.pdf_page("short", lambda: 1 / 0) == "short" and decoders.pdf_page("x" * 100, lambda: "ocr") == "x" * 100
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>")
    assert decoders.docx(data.getvalue()) == "ab\nc"
    sheet = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>col1</t></is></c></row><row><c><v>1</v></c><c t="inlineStr"><is><t>a</t></is></c></row></sheetData></worksheet>')
    assert decoders.xlsx(sheet.getvalue()) == "=== SHEET: S ===\nColumns: col1\n1 | a"
    df = spark.createDataFrame([("a", "text/plain", bytearray(b"x")), ("b", "image/svg+xml", None), ("c", decoders.__dict__["docx"].__doc__, bytearray(b"")), ("d", list(decoders.DECODERS)[0], bytearray(b"bad"))], "path string, mime_type string, content binary")
    got = {r["path"]: r for r in decoders.extract(df).collect()}
    assert got["a"]["text"] == "x" and got["b"]["text"] is None and got["d"]["error"].startswith("BadZipFile")


def test_extract_tells_types_without_decoder(spark):
    kinds = ["image/png", "video/mp4", "application/x-msaccess", None]
    df = spark.createDataFrame([(str(i), k, bytearray(b"x")) for i, k in enumerate(kinds)], "path string, mime_type string, content binary")
    got = {r["path"]: r for r in decoders.extract(df).collect()}
    assert all(got[str(i)]["text"] is None and got[str(i)]["error"] == f"no decoder for {k or 'an unknown type'}" for i, k in enumerate(kinds))
    plugged = {r["path"]: r for r in decoders.extract(df, {"video/mp4": lambda data: "read"}).collect()}
    assert plugged["1"]["text"] == "read" and plugged["1"]["error"] is None


def test_secret_scan_keeps_all_of_a_line(spark, tmp_path):
    from archlight.plans import registry

    rows = [(1, "password: a password: b password: a\nnone"), (2, " ".join(x * 40 for x in "abc"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["secret_scan"](spark, str(tmp_path)).collect())
    assert got == [(1, "password assignment_1_1", "password: a"), (1, "password assignment_1_2", "password: b"), *((2, f"hex token_1_{n}", x * 40) for n, x in enumerate("abc", 1))]


def test_catalog_files(spark, tmp_path):
    path = str(tmp_path / "m.json")
    with open(path, "w") as f:
        json.dump([record(), record(file_path="/c", mime_type="image/jpeg", is_nsfw=True), {"file_name": "no path"}], f)
    m = catalog_files.read_json(spark, path)
    assert m.count() == 2 and m.where(predicates.cli_query(is_nsfw=True)).count() == 1
    with open(tmp_path / "bad.json", "w") as f:
        f.write("{nonsense")
    with pytest.raises(ValueError):
        catalog_files.read_json(spark, str(tmp_path / "bad.json"))
    assert catalog_files.read_or_empty(spark, str(tmp_path / "bad.json")).count() == 0
    assert catalog_files.read_or_empty(spark, str(tmp_path / "none.json")).count() == 0
    base = str(tmp_path / "store")
    catalog_files.write_version(m, base)
    catalog_files.write_version(m.limit(1), base)
    assert catalog_files.read_version(spark, base).count() == 1
    assert [n for n, _ in catalog_files.pointers(spark, base)] == [1, 2]
    for _, pointer in catalog_files.pointers(spark, base):
        os.remove(pointer)
    assert catalog_files.read_version(spark, base).count() in (1, 2)
    with pytest.raises(RuntimeError):
        catalog_files.read_version(spark, str(tmp_path / "empty"))
    catalog_files.export_csv(m, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    rows = spark.createDataFrame([("/x", "a/b", "broken", "")], "file_path string, mime_type string, reason string, info string")
    for _ in range(2):
        catalog_files.log_unprocessed(rows, str(tmp_path / "log"))
    assert [r["reason"] for r in catalog_files.read_log(spark, str(tmp_path / "log")).collect()] == ["broken"] * 2
    with open(tmp_path / "list.json", "w") as f:
        json.dump([{"file_path": "/c"}, {"name": "no path"}], f)
    assert [r["file_path"] for r in catalog_files.read_list(spark, str(tmp_path / "list.json")).collect()] == ["/c"]
    assert catalog_files.csv_rows(m.where("file_path = '/c'"), m).count() == 1


def test_streaming(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    m = frame(spark, record(status="pending_analysis", extracted_text="t"), record(), record(status="failed", mime_type="application/zip")).drop("manifest_idx")
    m.write.parquet(source)
    for expected in (1, 1):
        q = incremental.run(spark, source, target, checkpoint)
        q.awaitTermination()
        assert spark.read.parquet(f"{target}/batch=*").count() == expected
    m.write.mode("append").parquet(source)
    incremental.run(spark, source, target, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{target}/batch=*").count() == 2


def test_analyze(spark):
    m = frame(spark, record(extracted_text="Anna spoke. Bob left."), record(extracted_text=" "), record(extracted_text="Zoe " * 2000))
    got = {r["summary"][:5] for r in analyze.analyze_text(m).collect()}
    assert len(got) == 2
    assert {r["summary"] for r in analyze.analyze_text(m, model=lambda t: 1 / 0).collect()} == {analyze.UNAVAILABLE}


def test_default_models(spark):
    m = frame(spark, record(extracted_text="My bank account has a penalty. The will is with the attorney. password: hunter2"), record(extracted_text=None), record(extracted_text="plain"))
    ids = [r["manifest_idx"] for r in m.orderBy("manifest_idx").collect()]
    got = {r["key"]: r for r in analyze.analyze_passwords(m).collect()}
    assert [got[i]["contains_password"] for i in ids] == [True, False, False] and got[ids[0]]["passwords"][0]["password"] == "password: hunter2"
    money = {r["key"]: r for r in analyze.analyze_financial(m).collect()}
    assert money[ids[0]]["red_flags"] == ["penalty"] and money[ids[0]]["confidence"] == 20 and not money[ids[1]]["has_red_flags"]
    estate = {(r["category"], r["items"]) for r in analyze.analyze_estate(m).collect()}
    assert estate == {("Legal", '{"item":"The will is with the attorney.","why_it_matters":"will"}'), ("Financial", '{"item":"My bank account has a penalty.","why_it_matters":"bank"}'), ("Digital", '{"item":"password: hunter2","why_it_matters":"password"}')}
    tables = m.select("manifest_idx", F.lit("A: 1 2").alias("table_text"))
    assert {r["extracted_text"] for r in analyze.analyze_access(m, tables).collect()} == {"A: 1 2", "plain\n\nA: 1 2", "My bank account has a penalty. The will is with the attorney. password: hunter2\n\nA: 1 2"}


def test_small_rules(spark):
    size = lambda *args: one(spark, X.adaptive_size(F.lit(5000), *args))
    assert (size(8192, 8192), size(8192, 4096), size(200, 10)) == (4096, 2048, 128)
    frames = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert one(spark, X.video_summary(frames(), F.lit(True))).startswith("No frames") and one(spark, X.video_summary(frames("a"), F.lit(False))) == "a" and one(spark, X.video_summary(frames("a", "b", "c", "d"), F.lit(True))) == "a b c"
    assert one(spark, X.append_unless_contained(F.lit("abc"), F.lit("b"))) == "abc"
    assert one(spark, retrieval.selected_frames(F.lit(3), F.lit(30.0), 1)) == [0] and one(spark, retrieval.any_frame_nsfw(frames("sfw"), F.lit(None).cast("boolean"))) is None


def test_snapshots(spark, tmp_path):
    path, folder = str(tmp_path / "m.json"), str(tmp_path / "snaps")
    with open(path, "w") as f:
        json.dump([record()], f)
    first, second = (catalog_files.snapshot(spark, path, folder, "x") for _ in range(2))
    assert first != second
    with open(f"{folder}/empty.json", "w"), open(f"{folder}/broken.json", "w") as f:
        f.write("{no")
    assert len(catalog_files.valid_snapshots(spark, folder, delete=True)) == 2 and not os.path.exists(f"{folder}/empty.json")
    with open(path, "w") as f:
        f.write("{no")
    assert catalog_files.recover(spark, path, folder).count() == 1
    with pytest.raises(RuntimeError):
        catalog_files.recover(spark, path, str(tmp_path))


def test_recovery_reads_one_snapshot(spark, tmp_path, monkeypatch):
    """The newest snapshot is read once and older ones not at all."""
    path, folder = str(tmp_path / "a.json"), str(tmp_path / "s")
    (tmp_path / "a.json").write_text('[{"file_path": "/a"}]')
    names = [catalog_files.snapshot(spark, path, folder, x) for x in "pq"]
    os.utime(names[0], (1, 1))
    (tmp_path / "a.json").write_text("{")
    seen = []
    monkeypatch.setattr(catalog_files, "read_json", lambda s, p, real=catalog_files.read_json: seen.append(os.path.basename(p)) or real(s, p))
    assert catalog_files.recover(spark, path, folder).count() == 1
    assert seen == ["a.json", "catalog-q.json"]


def test_dynamic_timeout_is_the_plain_rule(spark):
    import random

    draw = random.Random(4)
    rows = [(k, i, draw.choice((None, 0.0, -1.0, draw.random() * 90))) for k in range(4) for i in range(40)]
    got = {(r["k"], r["i"]): r["timeout"] for r in metrics.dynamic_timeout(spark.createDataFrame(rows, "k int, i int, x double"), "k", ["i"], "x").collect()}
    for k, i, _ in rows:
        past = sorted(x for k2, j, x in rows if k2 == k and j < i and x and x > 0)
        n = len(past)
        assert got[k, i] == (60.0 if n < 4 else max(60.0, 5 * past[min(max(-(-3 * (n + 1) // 4), 1), n) - 1]))


def test_retention_by_windows_is_the_plain_rule(spark):
    import random

    draw, now = random.Random(6), datetime(2025, 6, 11, 12)
    rows = [(a, f"s{i}", now - timedelta(hours=draw.choice((2, 20, 200, 2000)) * draw.random())) for a in range(12) for i in range(draw.choice((3, 15, 16, 40)))]
    got = {(r["archive"], r["name"]): r["kept"] for r in metrics.retain_tiered(spark.createDataFrame(rows, "archive int, name string, modified timestamp"), now).collect()}
    for a in range(12):
        own = sorted((r for r in rows if r[0] == a), key=lambda r: r[2], reverse=True)
        assert [got[a, n] for _, n, _ in own] == metrics.tiers([t for *_, t in own], now)


def test_answers_of_a_model():
    calls = []

    def chat(instructions, text, seconds):
        calls.append((instructions, text, seconds))
        if text == "slow":
            raise TimeoutError("60 s")
        return '{"a": 1}' if text == "good" or (text == "second" and analyze.STRICT in instructions) else "no"

    a = analyze.Answers(chat, "Do.", 5.0)
    assert a.ask("good") == ('{"a": 1}', None) and a.ask("second")[0] and len(calls) == 3 and {s for *_, s in calls} == {60.0}
    assert a.ask("good")[0] and len(calls) == 3  # from memory
    assert a.ask("slow")[1].startswith("timeout") and len(calls) == 4  # not asked again
    for k in range(4):
        assert a.ask(f"bad{k}")[1] == "no JSON in the reply"
    assert len(calls) == 12 and a.ask("good2")[1].startswith("not asked") and len(calls) == 12


def test_images(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"), None), (2, None, ""), (3, bytearray(b"bad"), "own")], "manifest_idx long, content binary, summary string")
    describe = lambda data: {b"x": "a tree"}[data]
    got = {r["key"]: (r["description"], r["summary"]) for r in analyze.describe_images(df, describe).collect()}
    assert got == {1: ("a tree", "a tree"), 2: (analyze.UNREADABLE,) * 2, 3: (analyze.UNREADABLE, "own")}
    scores = spark.createDataFrame([(1, "NSFW", 0.9), (1, "sfw", 0.1), (2, "nsfw", 0.2), (2, "sfw", 0.8), (3, None, None)], "id int, label string, score double")
    assert {r["id"]: (r["label"], r["score"], r["is_nsfw"]) for r in analyze.classify_nsfw(scores, "id").collect()} == {1: ("NSFW", 0.9, True), 2: ("sfw", 0.8, False), 3: ("SFW", 0.0, False)}


def simple_pdf(*pages, deflate=True):
    import zlib

    out = b"%PDF-1.4\n"
    for k, lines in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td " + b" T* ".join(line if line[:1] in b"[<" else b"(" + line + b") Tj" for line in lines) + b" ET"
        data = zlib.compress(body) if deflate else body
        out += b"%d 0 obj << /Length %d %s >>\nstream\n" % (k + 1, len(data), b"/Filter /FlateDecode" if deflate else b"") + data + b"\nendstream endobj\n"
    return out + b"%%EOF"


def test_pdf():
    long = b"A line that is long enough to count as a page of its own, so that nobody looks at the picture of it at all."
    data = simple_pdf([long, rb"with \(brackets\) and \351t\351"], [b"short"])
    assert decoders.pdf(data) == long.decode() + "\nwith (brackets) and été\nshort"
    assert decoders.pdf(data, lambda d, n: f"page {n}") == long.decode() + "\nwith (brackets) and été\npage 1"
    assert decoders.pdf(simple_pdf([b"[(spl) -20 (it)] TJ", b"<4869> Tj"], deflate=False)) == "split\nHi"
    with pytest.raises(ValueError):
        decoders.pdf(b"none")


def test_plug_points(tmp_path):
    import numpy as np

    grey = np.array([[10, 12, 11, 200], [205, 210, 9, 199]], np.uint8)
    assert decoders.binarized(grey).tolist() == [[0, 0, 0, 255], [255, 255, 0, 255]]
    assert decoders.image_text(b"", None, None) == "" and decoders.image_text(b"x", lambda d: grey, lambda im: str(int(im.sum()))) == str(4 * 255)
    assert [i for i, _ in decoders.video_frames(25, 1.0, lambda i: b"f")] == [0, 10, 20]
    with pytest.raises(ValueError):
        decoders.video_frames(5, 0, lambda i: b"")
    assert list(decoders.tables_of({"a": {"x": [1]}, "MSysObjects": {}})) == ["a"]

    class Reader:
        catalog = {"b": 1, "msysq": 2}

        def table(self, name):
            return {"x": [1, 2]}

    assert len(decoders.tables_of(Reader())["b"]) == 2
    with pytest.raises(ValueError):
        decoders.tables_of({"msys1": {}})
    f = io.BytesIO(b"abc")
    f.seek(2)
    assert decoders.uploaded(f) == b"abc" and f.tell() == 2 and decoders.uploaded(b"x") == b"x"
    with pytest.raises(ValueError):
        decoders.uploaded(b"")


def test_settings(tmp_path, monkeypatch):
    import logging

    from archlight.sources import settings

    text = "models:\n  text:\n    name: small  # quick\n    context_window: 8192\n  image: 'seeing'\nother: 1\n"
    section = settings.models(text)
    assert settings.model(section, "text") == settings.ModelConfig("small", 8192) and settings.model(section, "text").options() == {"num_ctx": 8192}
    assert settings.model(section, "image").options() == {}
    for bad, error in (({}, KeyError), ({"x": 3}, TypeError), ({"x": {"size": 1}}, KeyError)):
        with pytest.raises(error):
            settings.model(bad, "x")
    assert settings.workers() == {"analysis": 2, "extraction": 5, "database": 1} and settings.workers(6) == {"analysis": 1, "extraction": 4, "database": 1}
    assert sum(settings.workers(1).values()) == 3
    monkeypatch.setenv(settings.LEVEL, "warning")
    log = settings.configure_logging(file=str(tmp_path / "a.log"), console=False)
    logging.getLogger("archlight.x").warning("told")
    assert log.level == logging.WARNING and "told" in open(tmp_path / "a.log").read()
    with pytest.raises(ValueError):
        settings.configure_logging(console=False)
    settings.configure_logging("INFO")


def test_removals(spark, tmp_path):
    for n in ("a", "bb"):
        (tmp_path / n).write_text("same")
    (tmp_path / "dir").mkdir()
    os.symlink(tmp_path / "gone", tmp_path / "link")
    rows = [(0, str(tmp_path / "a"), "keep"), (1, str(tmp_path / "bb"), "delete file"), (2, str(tmp_path / "none"), "delete file"), (3, str(tmp_path / "dir"), "delete file"), (4, str(tmp_path / "link"), "delete file"), (5, None, "remove entry: no path")]
    plan = spark.createDataFrame(rows, "manifest_idx long, file_path string, action string")
    told = lambda delete: {r["manifest_idx"]: r["outcome"] for r in catalog.apply_removals(plan, delete).collect()}
    same = {0: "kept", 2: "already missing", 3: "directory: entry removed", 4: "broken link", 5: "entry removed"}
    assert told(False) == same | {1: "dry run"} and os.path.exists(tmp_path / "bb")
    assert told(True) == same | {1: "deleted"} and not os.path.exists(tmp_path / "bb") and os.path.exists(tmp_path / "a")


def test_embedding():
    def embed(text):
        if len(text.split()) > 200:
            raise ValueError("too long")
        return [float(len(text.split())), 1.0]

    assert retrieval.embed_chunks("w " * 300, embed, 400, 2) == [150.0, 1.0]  # halved once: 200 and 100 words
    assert retrieval.embed_chunks(" ", embed, 400, 2) == [0.0, 0.0] and retrieval.embed_chunks("w " * 300, lambda t: 1 / 0, 400, 2) == [0.0, 0.0]


def test_tables_and_pages(spark):
    t = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2)], "o int, s string, holed string, n int")
    assert tabular.flat_text(t, "o", []).first()["flat_text"] == "a b"
    index = catalog.mime_index(frame(spark, *(record(file_path=f"/{n}", file_name=n) for n in "cab")))
    first = catalog.page(index, F.col("mime") == "text/plain", 2).collect()
    assert [r["display"] for r in first] == ["a", "b"]
    assert [r["display"] for r in catalog.page(index, F.lit(True), 2, (first[-1]["display"], first[-1]["manifest_idx"])).collect()] == ["c"]


def test_key_themes(spark):
    rows = [(1, "zeta beta Zeta beta, alpha the with x " * 2), (2, None), (3, "")]
    got = [tuple(r) for r in X.key_themes(spark.createDataFrame(rows, "k int, t string"), "k", "t", 2).collect()]
    assert got == [(1, "zeta", 4, 1), (1, "beta", 4, 2)]
    plan = X.key_themes(spark.createDataFrame(rows, "k int, t string"), "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_workbooks():
    import struct

    from archlight.plans.source_queries import workbook
    from archlight.sources import workbooks as W

    long = [f"row {i} " + "é中" * (i % 40) for i in range(3000)]
    assert W.sheets(workbook("Big", long)) == [("Big", [[x] for x in long])]
    assert decoders.xls(workbook("None", [])) == "=== SHEET: None ===\n(Empty sheet)"
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    place = lambda r, c: struct.pack("<HHH", r, c, 0)
    stream = b"".join((
        record(W.BOF, b"\0" * 8), record(W.LABEL, place(0, 0) + struct.pack("<HB", 2, 0) + b"ab"), record(W.NUMBER, place(0, 1) + struct.pack("<d", 2.5)), record(W.PACKED, place(1, 0) + struct.pack("<I", 7 << 2 | 2)),
        record(W.PACKED_ROW, place(1, 1)[:4] + struct.pack("<HIHIH", 0, 150 << 2 | 3, 0, struct.unpack("<II", struct.pack("<d", 4.0))[1], 2)), record(W.FLAG, place(2, 0) + b"\1\0"), record(W.FORMULA, place(2, 1) + struct.pack("<d", 3.0) + b"\0" * 8),
        record(W.FORMULA, place(2, 2) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8), record(W.RESULT, struct.pack("<HB", 1, 0) + b"x"), record(W.EOF, b""), record(W.LABEL, place(9, 9) + struct.pack("<HB", 1, 0) + b"n"),
    ))
    assert W.cells_of(stream, 0, []) == {(0, 0): "ab", (0, 1): "2.5", (1, 0): "7", (1, 1): "1.5", (1, 2): "4", (2, 0): "True", (2, 1): "3", (2, 2): "x"}
    assert W.packed_number((1 << 32) - 4 | 2) == -1.0
    with pytest.raises(ValueError):
        decoders.xls(b"none")


def test_discovery_and_assets(spark, tmp_path):
    root, target = tmp_path / "root", str(tmp_path / "catalog")
    root.mkdir()
    assert catalog_files.discover(spark, str(root), target) == 0 and not os.path.exists(target)
    for k in range(3):
        (root / f"d{k}").mkdir()
        for i in range(4):
            (root / f"d{k}" / f"{i}.txt").write_text(f"{k} {i}")
    assert catalog_files.discover(spark, str(root), target) == 12
    with open(target) as f:
        assert len(json.load(f)) == 12
    with open(tmp_path / "m.json", "w") as f:
        json.dump([record(file_path="/a/b.txt", mentioned_people=["Ann"]), record(file_path="/a/c/d.txt", is_nsfw=True)], f)
    found = catalog_files.assets(spark, str(tmp_path / "m.json"))
    assert {k: v.count() for k, v in found.items()} == {"catalog": 2, "types": 2, "people": 1, "unsafe": 1, "passwords": 0, "estate": 0, "directories": 3, "directory_entries": 4}
    none = catalog_files.assets(spark, str(tmp_path / "absent.json"))
    assert set(none) == set(found) and all(v.count() == 0 for v in none.values())


def test_secret_rules(spark):
    said = {
        "hex token": "a" * 40, "password assignment": "Passwd = x1", "key block": "-----BEGIN RSA PRIVATE KEY-----", "aws access key": "AKIA" + "Z" * 16, "github token": "ghp_" + "a1" * 18, "json web token": "eyJhbGciOi.eyJzdWIi.c2ln",
        "slack token": "xoxb-" + "1" * 12, "stripe key": "sk_live_" + "b" * 24, "basic auth": "https://user:word@", "key assignment": "api_key = 'abcdefgh'",
    }
    assert list(said) == list(X.SECRET_RULES)
    df = spark.createDataFrame([(1, "\n".join(said.values())), (2, "nothing to hide: tokens, keys and words"), (3, None)], "k int, t string")
    got = {(r["label"], r["secret"]) for r in X.secrets(df, "k", "t").collect()}
    assert got == {(f"{kind}_{i}_1", s) for i, (kind, s) in enumerate(said.items(), 1)}


def test_publishing(spark, tmp_path):
    source, base, checkpoint = (str(tmp_path / x) for x in ("in", "store", "cp"))
    rows = lambda *r: frame(spark, *r).drop("manifest_idx")
    rows(record(file_path="/a"), record(file_path="/b", status="failed")).write.parquet(source)
    incremental.publish(spark, source, base, checkpoint).awaitTermination()
    assert bucket_store.read(spark, base).count() == 2
    rows(record(file_path="/b", last_modified=9.0), record(file_path="/c"), record(file_path="/c", last_modified=3.0)).write.mode("append").parquet(source)
    incremental.publish(spark, source, base, checkpoint).awaitTermination()
    got = {r["file_path"]: (r["status"], r["last_modified"]) for r in bucket_store.read(spark, base).collect()}
    assert got == {"/a": ("complete", 1.0), "/b": ("complete", 9.0), "/c": ("complete", 3.0)} and len(catalog_files.pointers(spark, base)) == 2
