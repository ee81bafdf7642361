"""Directory scans: listing, MIME types, hashes, archive members."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.functions import schema as S
from archlight.functions import tasks

from . import file_listing
from .shared import bound_batches

OCTETS = "application/octet-stream"
#: Magic numbers in hexadecimal, extensions and their types.
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "504B0304": "application/zip", "1F8B": "application/gzip", "7B5C727466": "text/rtf", "000100005374616E64617264204A6574": "application/x-msaccess"}
EXTENSIONS = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "text/xml", "svg": "image/svg+xml", "pdf": "application/pdf", "rtf": "text/rtf",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "asx": "video/x-ms-asf", "zip": "application/zip", "gz": "application/gzip",
    "tar": "application/x-tar", "tgz": "application/gzip", "mdb": "application/x-msaccess", "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
OFFICE = ("docx", "xlsx")
MEMBER = "path string, member string, content binary, depth int"


def mime_type(path: Column, content: Column) -> Column:
    """By magic number, then by extension, then unknown bytes; office files are zip files inside."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    head = F.hex(F.substring(content, 1, 16))
    found = F.when(ext.isin(*OFFICE), by_name)
    for magic, kind in MAGIC.items():
        found = found.when(head.startswith(magic), kind)
    return F.coalesce(found, by_name, F.lit(OCTETS))


def write_texts(rows: DataFrame, order: str) -> None:
    """``path, text`` as text files, a path's texts in order with a line end behind each.

    For trees of very many files: tasks put each into place by one rename, so nothing is left for the driver to commit, and a
    task that runs again writes the same files.
    """
    tasks_ = 4 * rows.sparkSession.sparkContext.defaultParallelism  # a file costs more than its bytes, which would ask for few tasks

    def work(part: Iterator) -> None:
        for path, texts in groupby(part, key=lambda r: r["path"]):
            with file_listing.created(path) as f:
                for r in texts:
                    f.write(r["text"].encode() + b"\n")

    rows.repartition(tasks_, "path").sortWithinPartitions("path", order).select("path", "text").foreachPartition(work)


DIGESTED = "path string, size long, modified double, head binary, sha256 string"
#: Files whose digests make one Arrow batch, and bytes that are read at once.
FILES, BLOCK = 1_000, 1 << 20


def digests(listed: DataFrame) -> DataFrame:
    """``path, size, modified, head, sha256`` of listed files, read in blocks; those that cannot be read are left out."""
    out = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.float64()), ("head", pa.binary()), ("sha256", pa.string())])

    def read(path: str) -> tuple[bytes, str] | None:
        try:
            with file_listing.opened(path) as f:
                head = f.read(16)
                digest = hashlib.sha256(head)
                while block := f.read(BLOCK):
                    digest.update(block)
        except OSError:
            return None
        return head, digest.hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for at in range(0, len(rows), FILES):
                done = [(*row, *found) for row in rows[at : at + FILES] if (found := read(row[0]))]
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    return listed.select("path", "size", "modified").mapInArrow(work, DIGESTED)


def scan(spark: SparkSession, root: str, limit: int = 0, condition: Column | None = None) -> DataFrame:
    """The catalog of a directory: one record per readable file in path order, with hash, type and the tasks it needs.

    A condition on ``path``, ``size`` and ``modified`` is pushed into the listing, so that what it leaves out is never
    opened. With a limit only the first files that can be read are opened; a root without files gives an empty catalog.
    """
    listed = file_listing.list_files(spark, root, condition).where("readable")
    some = listed.orderBy("path").limit(limit) if limit else listed
    # files are dealt out in path order before they are opened: to sort them later would open each twice, as Spark samples what it sorts
    found = digests(some.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "path").sortWithinPartitions("path"))
    out = found.select(
        F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), mime_type(F.col("path"), F.col("head")).alias("mime_type"), F.col("size").alias("file_size"), F.col("modified").alias("last_modified"), "sha256"
    )
    return out.withColumns({"status": F.lit(S.PENDING_EXTRACTION), "analysis_tasks": tasks.required_tasks(F.col("mime_type"), F.col("file_path"), F.lit(False))})


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """The same over any store that Spark reads; its binary reader skips hidden and empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    return files.select(
        F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), mime_type(F.col("path"), F.col("content")).alias("mime_type"), F.col("length").alias("file_size"), F.col("modificationTime").cast("double").alias("last_modified"), F.sha2("content", 256).alias("sha256")
    )


def archive_kind(name: str) -> str | None:
    low = name.lower()
    return next((k for end, k in ((".tar.gz", "tar"), (".tgz", "tar"), (".tar", "tar"), (".zip", "zip"), (".gz", "gzip")) if low.endswith(end)), None)


def members(name: str, data: bytes) -> list[tuple[str, bytes]] | None:
    """Files of an archive; null if it is none or broken."""
    kind = archive_kind(name)
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return [(i.name, t.extractfile(i).read()) for i in t.getmembers() if i.isfile()]
        if kind == "gzip":
            return [(os.path.basename(name)[:-3], gzip.decompress(data))]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError):
        return None
    return None


def expand_archives(files: DataFrame) -> DataFrame:
    """``path, content`` to ``path, member, content, depth``: archives inside archives are opened until none is left; broken ones stay as they are."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                waiting = [("", bytes(content), 0)]
                while waiting:
                    member, data, depth = waiting.pop()
                    inside = members(member or path, data)
                    if inside is None:
                        rows.append((path, member, data, depth))
                    else:
                        waiting += [(f"{member}!/{n}" if member else n, d, depth + 1) for n, d in inside]
            yield pd.DataFrame(rows, columns=["path", "member", "content", "depth"])

    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(work, MEMBER)
