"""The catalog at rest: JSON import and export, versioned snapshots, CSV and logs."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.functions import schema as S
from archlight.operators import catalog as C

from . import files, json_array, single_file

log = logging.getLogger(__name__)
#: How often a writer tries for the next number before it gives up.
TRIES = 100


def hadoop(spark: SparkSession, path: str):
    """File system and path objects of any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records as the typed catalog; records without a path are left out.

    The file is read by ranges; ``manifest_idx`` is a record's place in the array, however it is split.
    """
    raw = json_array.read(spark, path, S.loose_schema(), "file_path")
    return S.normalize(raw.withColumnRenamed("position", "manifest_idx")).where("file_path is not null")


def read_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The catalog, or an empty one of the same type if it is missing or broken."""
    fs, p = hadoop(spark, path)
    try:
        if fs.exists(p):
            return read_json(spark, path)
    except ValueError:
        pass
    return spark.createDataFrame([], "manifest_idx bigint, " + S.MANIFEST)


def assets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog with its indexes, each built where it is read; all are empty if the catalog is missing or broken."""
    m = read_or_empty(spark, path)
    return {
        "catalog": m, "types": C.mime_index(m), "people": C.people_index(m), "unsafe": C.flagged(m, P.truthy("is_nsfw")), "passwords": C.flagged(m, P.password_candidate()),
        "estate": C.estate_index(m), "directories": C.directory_index(m), "directory_entries": C.directory_entries(m),
    }


def discover(spark: SparkSession, root: str, path: str, limit: int = 0) -> int:
    """Scans a directory and writes its catalog; without files it warns and writes nothing. Gives the number of records."""
    found = files.scan(spark, root, limit)
    n = found.count()
    if n:
        export_json(found, path)
    else:
        log.warning("%s: no files", root)
    return n


def write_version(catalog: DataFrame, base: str) -> str:
    """Writes a new version beside the others, then publishes it by a pointer of its own under the next number.

    A pointer is written under another name and renamed into place, which fails if a writer was quicker; none is ever
    changed or deleted, so readers see the old version or the new one at any moment.
    """
    spark = catalog.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    catalog.write.parquet(f"{base}/{version}")
    fs, temp = hadoop(spark, f"{base}/.pointer-{version}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    for _ in range(TRIES):
        _, pointer = hadoop(spark, f"{base}/CURRENT-{max([0, *(n for n, _ in pointers(spark, base))]) + 1:012d}")
        if not fs.exists(pointer) and fs.rename(temp, pointer):
            return version
    fs.delete(temp, False)
    raise RuntimeError(f"no pointer could be put into {base} in {TRIES} tries")


def pointers(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    fs, p = hadoop(spark, base)
    names = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])]
    return sorted((int(n.removeprefix("CURRENT-")), f"{base}/{n}") for n in names if n.startswith("CURRENT-"))


def read_version(spark: SparkSession, base: str) -> DataFrame:
    """The current version; if the pointers are lost, the newest one that was written to its end."""
    if known := pointers(spark, base):
        text = spark.read.text(known[-1][1]).first()[0]
        return spark.read.parquet(f"{base}/{json.loads(text)['version']}")
    fs, p = hadoop(spark, base)
    done = [(s.getModificationTime(), s.getPath().toString()) for s in (fs.listStatus(p) if fs.exists(p) else []) if fs.exists(hadoop(spark, s.getPath().toString() + "/_SUCCESS")[1])]
    if not done:
        raise RuntimeError(f"no valid version under {base}")
    return spark.read.parquet(max(done)[1])


def order_of(catalog: DataFrame) -> list[str]:
    return [c for c in ("manifest_idx", "file_path") if c in catalog.columns]


def export_csv(catalog: DataFrame, path: str) -> None:
    """Completed files as one CSV file in catalog order with all fields quoted; nested fields as JSON."""
    single_file.write_csv(catalog.where(F.col("status") == S.COMPLETE), path, order_of(catalog))


def export_json(catalog: DataFrame, path: str) -> None:
    """The catalog as one JSON array in its order; the place in the array stands for ``manifest_idx``."""
    order = order_of(catalog)
    shown = [c for c in catalog.columns if c != "manifest_idx"]
    single_file.write_json(catalog.select(*shown, *(F.col(c).alias(f"_{c}") for c in order)), path, [f"_{c}" for c in order], shown)


def log_unprocessed(rows: DataFrame, path: str) -> None:
    """Appends ``ts, file_path, mime_type, reason, info`` as CSV files with a header each, all fields quoted."""
    columns = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("file_path", "mime_type", "reason", "info"))
    rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), *columns).write.mode("append").options(header="true", quoteAll="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's entries; a field may hold line ends, and one that was empty is empty again."""
    names = ("file_path", "mime_type", "reason", "info")
    rows = spark.read.schema("ts timestamp, " + ", ".join(f"{n} string" for n in names)).options(header="true", escape='"', multiLine="true").csv(path)
    return rows.select("ts", *(F.coalesce(n, F.lit("")).alias(n) for n in names))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A reprocess list: a JSON array, with ``list_idx``, the place in it; entries without a path are left out, with a warning that tells how many."""
    rows = json_array.read(spark, path, "file_path string").withColumnRenamed("position", "list_idx")
    if bad := rows.where("file_path is null").count():
        log.warning("%s: %d entries without a path are left out", path, bad)
    return rows.where("file_path is not null")


def csv_rows(completed: DataFrame, m: DataFrame) -> DataFrame:
    """Rows of the catalog whose file was completed in this run."""
    return m.join(completed.select("file_path").distinct(), "file_path", "left_semi")


def snapshot(spark: SparkSession, path: str, folder: str, stamp: str, tries: int = 100) -> str:
    """A copy of a catalog file under a name that is not taken."""
    fs, source = hadoop(spark, path)
    _, target = hadoop(spark, folder)
    fs.mkdirs(target)
    for k in range(tries):
        name = f"{folder}/catalog-{stamp}{f'-{k}' if k else ''}.json"
        _, p = hadoop(spark, name)
        if not fs.exists(p):
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, p, False, spark.sparkContext._jsc.hadoopConfiguration())
            return name
    raise RuntimeError(f"no free name in {folder}")


def readable(spark: SparkSession, folder: str, delete: bool = False) -> Iterator[tuple[str, DataFrame]]:
    """Snapshots that can be read, the newest first, each read as it is asked for; empty and broken ones are left out and, if asked for, deleted."""
    fs, p = hadoop(spark, folder)
    found = sorted(((s.getModificationTime(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), reverse=True)
    for _, path, size in found:
        try:
            if not size:
                raise ValueError(path)
            read = read_json(spark, path)
        except ValueError:
            if delete:
                fs.delete(hadoop(spark, path)[1], False)
            continue
        yield path, read


def valid_snapshots(spark: SparkSession, folder: str, delete: bool = False) -> list[str]:
    """Snapshots that can be read, the newest first; empty and broken ones are left out and, if asked for, deleted."""
    return [path for path, _ in readable(spark, folder, delete)]


def recover(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The catalog; if it is broken, the newest snapshot that can be read, read once, and none older."""
    try:
        return read_json(spark, path)
    except ValueError:
        for _, newest in readable(spark, folder):
            return newest
        raise RuntimeError(f"neither {path} nor a snapshot can be read") from None
