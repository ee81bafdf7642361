"""Decoders, archives, coercions and plug points over texts of the test tables."""

from __future__ import annotations

import io
import struct
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.functions import schema as S
from archlight.functions import text as X
from archlight.operators import catalog as C
from archlight.operators import retrieval as R
from archlight.sources import catalog_files, decoders, files
from archlight.sources import workbooks as W
from archlight.sources.catalog_tables import MANIFEST_SQL as M
from archlight.sources.catalog_tables import QUERY_VECTOR, manifest, table, vectors
from archlight.sources.shared import bound_batches

from .registry import query
from .retrieval_queries import DISTANCE, NEAREST
from .task_queries import WORDS

OFFICE = "application/vnd.openxmlformats-officedocument."
KINDS = ("text/plain", OFFICE + "wordprocessingml.document", OFFICE + "spreadsheetml.sheet", "application/rtf", "image/svg+xml", "application/pdf", "application/vnd.ms-excel", "application/x-unknown")


def zipped(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def workbook(name: str, rows: list[str]) -> bytes:
    """One sheet of one column as a workbook in a compound file of plain chains."""
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    strings = [struct.pack("<II", len(rows), len(rows))]
    for text in rows:
        wide, at = text.encode("utf-16-le"), 0
        if len(strings[-1]) + 3 > 8000:
            strings.append(b"")
        strings[-1] += struct.pack("<HB", len(wide) // 2, 1)
        while at < len(wide):
            room = (8000 - len(strings[-1])) // 2 * 2
            if room <= 0:  # the next record begins with the width of the characters
                strings.append(b"\1")
                continue
            strings[-1] += wide[at : at + room]
            at += room
    table = b"".join(record(W.STRINGS if i == 0 else W.MORE, x) for i, x in enumerate(strings))
    label = name.encode("latin-1")
    sheet = lambda start: record(W.SHEET, struct.pack("<IBBBB", start, 0, 0, len(label), 0) + label)
    begin = record(W.BOF, struct.pack("<HHIII", 0x0600, 0x0010, 0, 0, 0))
    start = len(begin) + len(sheet(0)) + len(table) + 4
    cells = b"".join(record(W.SHARED, struct.pack("<HHHI", i, 0, 0, i)) for i in range(len(rows)))
    stream = begin + sheet(start) + table + record(W.EOF, b"") + begin + cells + record(W.EOF, b"")
    stream = stream.ljust(4096, b"\0")
    body = -(-len(stream) // 512)
    tables = 1
    while tables * 128 < body + 1 + tables:
        tables += 1
    chains = [*range(1, body), W.CHAIN_END, W.CHAIN_END, *[0xFFFFFFFD] * tables]
    chains += [W.FREE] * (tables * 128 - len(chains))
    entry = lambda n, kind, at, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", at, size, 0)
    directory = (entry("Root Entry", 5, W.CHAIN_END, 0) + entry("Workbook", 2, 0, len(stream))).ljust(512, b"\0")
    head = W.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", tables, body, 0, 4096, W.CHAIN_END, 0, W.CHAIN_END, 0)
    head += b"".join(struct.pack("<I", body + 1 + i if i < tables else W.FREE) for i in range(109))
    return head + stream.ljust(body * 512, b"\0") + directory + struct.pack(f"<{len(chains)}I", *chains)


def encoded(kind: str, text: str) -> bytes:
    """A text as a file of a kind, as plainly as the format allows."""
    lines = text.split("\n")
    if kind == "text/plain":
        return text.encode()
    if kind.endswith("document"):
        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        return zipped(word__document_xml=f"<w:document {space}>" + "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in lines) + "</w:document>")
    if kind.endswith("sheet"):
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rows = "".join(f'<row><c t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for x in ["line", *(x for x in lines if x.strip())])
        return zipped(xl__workbook_xml=f'<workbook {main}><sheets><sheet name="Text"/></sheets></workbook>', xl__worksheets__sheet1_xml=f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    if kind == "application/vnd.ms-excel":
        return workbook("Text", ["line", *(x for x in lines if x.strip())])
    if kind == "application/rtf":
        shown = text.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}").replace("\n", "\\par ")
        return ("{\\rtf1{\\fonttbl x}" + shown + "}").encode()
    if kind == "image/svg+xml":
        return f"<svg><text>{escape(text)}</text></svg>".encode()
    if kind == "application/pdf":
        shown = b" T* ".join(b"<FEFF" + x.encode("utf-16-be").hex().encode() + b"> Tj" for x in lines)
        return b"%PDF-1.4\n1 0 obj << /Length 0 >>\nstream\nBT " + shown + b" ET\nendstream endobj\n%%EOF"
    return text.encode()


def encoded_documents(spark, sf):
    """``path, mime_type, content``: documents as files of all kinds."""

    def work(parts):
        for part in (whole[at : at + decoders.ROWS] for whole in parts for at in range(0, len(whole), decoders.ROWS)):
            kinds = [KINDS[i % len(KINDS)] for i in part["doc_id"]]
            yield pd.DataFrame({"path": part["doc_id"].astype(str), "mime_type": kinds, "content": [encoded(k, t or "") for k, t in zip(kinds, part["text"])]})

    bound_batches(spark)
    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(work, "path string, mime_type string, content binary")


SAID = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10))"
ROWS = "array_to_string(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), chr(10))"


SHEET = f"'=== SHEET: Text ===' || chr(10) || 'Columns: line' || CASE WHEN {ROWS} <> '' THEN chr(10) || {ROWS} ELSE '' END"


@query(
    f"SELECT doc_id::VARCHAR AS path, CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN {SHEET} WHEN 3 THEN text "
    f"WHEN 4 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 5 THEN {SAID} WHEN 6 THEN {SHEET} END AS text, CASE WHEN doc_id % 8 = 7 THEN 'no decoder for application/x-unknown' END AS error FROM documents"
)
def decode_documents(spark, sf):
    """Documents written as files of seven kinds and one unknown, read by the decoders."""
    return decoders.extract(encoded_documents(spark, sf))


@query("SELECT doc_id::VARCHAR AS path, doc_id || '.txt' AS member, text, 1 AS depth FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id::VARCHAR, 'in.zip!/' || doc_id || '.txt', text, 2 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id::VARCHAR, '', text, 0 FROM documents WHERE doc_id % 3 = 2")
def archive_members(spark, sf):
    """Documents in archives, in archives inside archives, and under an archive's name but broken."""

    def packed(i: int, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{i}.txt", text)
        if i % 3 == 0:
            return out.getvalue()
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("in.zip", out.getvalue())
        return outer.getvalue() if i % 3 == 1 else text.encode()

    def work(parts):
        for part in parts:
            yield pd.DataFrame({"path": [f"{i}.zip" for i in part["doc_id"]], "content": [packed(i, t) for i, t in zip(part["doc_id"], part["text"])]})

    found = files.expand_archives(table(spark, sf, "documents").select("doc_id", "text").mapInPandas(work, "path string, content binary"))
    return found.select(F.regexp_replace("path", r"\.zip$", "").alias("path"), "member", F.decode("content", "UTF-8").alias("text"), "depth")


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || ',b' WHEN 2 THEN '' ELSE event_type END AS list, CASE event_id % 3 WHEN 0 THEN 'a=' || event_type || ',b=2' WHEN 1 THEN 'c=' || event_type ELSE '' END AS passwords FROM events"
)
def coerced_lists(spark, sf):
    """Loosely typed fields: a scalar, a list with a null, null, a list; a map, a list of entries, other text."""
    k, e = F.col("event_id"), S.quoted(F.col("event_type"))
    raw = F.when(k % 4 == 0, F.col("event_type")).when(k % 4 == 1, F.concat(F.lit("["), e, F.lit(', null, "b"]'))).when(k % 4 == 3, F.concat(F.lit(" ["), e, F.lit("]")))
    pairs = F.when(k % 3 == 0, F.concat(F.lit('{"a": '), e, F.lit(', "b": "2"}'))).when(k % 3 == 1, F.concat(F.lit('[{"context": "c", "password": '), e, F.lit("}]"))).otherwise("none")
    shown = F.array_join(F.transform(S.password_list(pairs), lambda p: F.concat_ws("=", p["context"], p["password"])), ",")
    return table(spark, sf, "events").select("event_id", F.array_join(S.string_list(raw), ",").alias("list"), shown.alias("passwords"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a b": ' || event_id || ', "n": null, "q": "say \\"' || event_type || '\\" \\\\ é", "x": [1,true]}' ELSE event_type END AS summary FROM events""")
def sorted_summaries(spark, sf):
    """Objects with their keys in order and their values' types and escapes kept; other text stays."""
    raw = F.concat(F.lit('{"x": [1, true], "q": "say \\"'), "event_type", F.lit('\\" \\\\ \u00e9", "n": null, "a b": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", S.sorted_json(F.when(F.col("event_id") % 2 == 0, raw).otherwise(F.col("event_type"))).alias("summary"))


@query("SELECT c_custkey, CAST(greatest(floor((2048 + c_custkey - 512) * 0.4), 128) AS INT) AS size FROM customer")
def chunk_sizes(spark, sf):
    """A customer's number stands for what a model's context has more than the smallest."""
    return table(spark, sf, "customer").select("c_custkey", X.chunk_size(F.col("c_custkey") + 2048).alias("size"))


def measured(limit: int):
    """An embedder for the query below: a text's words and characters; it takes so many words."""

    def embed(text: str) -> list[float]:
        words = text.split()
        if len(words) > limit:
            raise ValueError("too long")
        return [float(len(words)), float(sum(map(len, words)))]

    return embed


@query(f"SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE n / ceil(n / size) END, 6)::DOUBLE AS words, round(CASE WHEN n = 0 THEN 0 ELSE c / ceil(n / size) END, 6)::DOUBLE AS chars FROM (SELECT doc_id, len({WORDS}) AS n, length(array_to_string({WORDS}, '')) AS c, CASE WHEN len({WORDS}) > 300 THEN 256.0 ELSE 512.0 END AS size FROM documents)")
def embedded_documents(spark, sf):
    """Means over chunks; the model fails on more than 300 words, so longer texts go in halves of the first size."""
    found = R.embed_texts(table(spark, sf, "documents"), "doc_id", "text", lambda: measured(300), 512, 2)
    return found.select("doc_id", *(F.round(F.get("embedding", F.lit(i)), 6).alias(c) for i, c in enumerate(("words", "chars"))))


@query(NEAREST + f"WHERE vec_id % 15 = 0 ORDER BY {DISTANCE}, vec_id LIMIT 5")
def vector_search_flags(spark, sf):
    """The command line's search: flagged rows only."""
    found = R.top_k(vectors(spark, sf), QUERY_VECTOR, R.CLI_K, P.vector_filter(only_nsfw=True, red_flags=True))
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"))


@query(M + "SELECT manifest_idx FROM m WHERE status = 'complete'")
def csv_rows(spark, sf):
    m = manifest(spark, sf)
    return catalog_files.csv_rows(m.where(F.col("status") == S.COMPLETE), m).select("manifest_idx")


@query(
    M + ", r AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER w AS rn, first_value(file_path) OVER w AS kept_path FROM m WINDOW w AS (PARTITION BY sha256 ORDER BY length(file_path), file_path, manifest_idx)) "
    "SELECT manifest_idx, CASE WHEN rn = 1 THEN 'kept' WHEN file_path = kept_path THEN 'entry removed' ELSE 'already missing' END AS outcome FROM r WHERE n > 1"
)
def duplicate_removal(spark, sf):
    """The plan tried without deleting; the view's files lie nowhere."""
    return C.apply_removals(C.removal_plan(manifest(spark, sf))).select("manifest_idx", "outcome")
