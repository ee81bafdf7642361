"""Files written and read back: single-file exports, ranges of large arrays, listings, snapshots, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.operators import catalog as C
from archlight.operators.positions import numbered
from archlight.sources import bucket_store, catalog_files, file_listing, files, json_array, single_file
from archlight.sources.catalog_tables import MANIFEST_SQL as M
from archlight.sources.catalog_tables import manifest, table
from archlight.sources.shared import shared_path
from archlight.streaming import incremental

from .registry import query

SAID = "summary IS NOT NULL AND summary <> ''"
#: What JSON keeps of a catalog row: null fields are left out, and a record without flags has none.
ROW = f"""row_number() OVER (ORDER BY manifest_idx) - 1 AS manifest_idx, file_path, status, extracted_text, is_nsfw,
 CASE WHEN {SAID} THEN strlen(summary) ELSE 0 END AS summary_bytes, len(analysis_tasks) AS n_tasks, array_to_string(mentioned_people, '|') AS people, has_password_rows"""


def told(m):
    said = F.when(F.coalesce("summary", F.lit("")) != "", F.octet_length("summary")).otherwise(0).cast("long")
    return m.select("manifest_idx", "file_path", "status", "extracted_text", "is_nsfw", said.alias("summary_bytes"), F.size("analysis_tasks").cast("long").alias("n_tasks"), F.array_join("mentioned_people", "|").alias("people"), (F.size("passwords") > 0).alias("has_password_rows"))


@query(M + f"SELECT {ROW} FROM m")
def manifest_json_file(spark, sf):
    """The catalog written as one JSON array and read again in ranges."""
    path = shared_path(spark, "manifest") + "/manifest.json"
    catalog_files.export_json(manifest(spark, sf), path)
    return told(catalog_files.read_json(spark, path))


@query("SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS position, doc_id, text, source || '}\"]' AS source, concat_ws('|', text, '\\\"{' || lang) AS both FROM documents")
def json_array_ranges(spark, sf):
    """Documents as one JSON array, with brackets, quotes and escapes in strings, read again in ranges."""
    path = shared_path(spark, "array") + "/documents.json"
    docs = table(spark, sf, "documents").withColumns({"o": F.col("source"), "source": F.concat("source", F.lit('}"]')), "both": F.array("text", F.concat(F.lit('\\"{'), "lang"))})
    single_file.write_json(docs, path, ["o", "doc_id"], ["doc_id", "text", "source", "both"])
    return json_array.read(spark, path, "doc_id long, text string, source string, both array<string>").withColumn("both", F.array_join("both", "|"))


@query(M + "SELECT file_path, status, extracted_text, array_to_string(list_transform(mentioned_people, lambda p: '\"' || p || '\"'), ',') AS people FROM m WHERE status = 'complete'")
def manifest_csv_file(spark, sf):
    """Completed files as one CSV file with all fields quoted, read again."""
    path = shared_path(spark, "manifest") + "/manifest.csv"
    catalog_files.export_csv(manifest(spark, sf), path)
    read = spark.read.options(header="true", escape='"', multiLine="true", quote='"', nullValue="\u0000").csv(path)
    return read.select("file_path", "status", F.nullif("extracted_text", F.lit("")).alias("extracted_text"), F.regexp_replace("mentioned_people", r"^\[|\]$", "").alias("people"))


@query(M + f"SELECT {ROW} FROM m")
def manifest_recovery(spark, sf):
    """A catalog file that breaks, and the newest of its snapshots that can be read; a broken and an empty one are passed over."""
    base = shared_path(spark, "recovery")
    path, folder = f"{base}/manifest.json", f"{base}/snapshots"
    catalog_files.export_json(manifest(spark, sf), path)
    catalog_files.snapshot(spark, path, folder, "a")
    for target, text in ((f"{folder}/catalog-b.json", b'[{"file_path": "/a"'), (f"{folder}/catalog-c.json", b""), (path, b"{")):
        store = single_file.Store(spark, target)
        store.write(store.path(target), text, [], 0, b"")
    return told(catalog_files.recover(spark, path, folder))


@query(M + "SELECT row_number() OVER (ORDER BY file_path DESC) - 1 AS list_idx, manifest_idx, file_path FROM m WHERE has_financial_red_flags")
def reprocess_order(spark, sf):
    """A reprocess list in a file, in its own order, met with the catalog."""
    path = shared_path(spark, "list") + "/list.json"
    m = manifest(spark, sf)
    listed = numbered(m.where("has_financial_red_flags").select("file_path"), ["file_path"], name="k").withColumn("k", -F.col("k"))
    single_file.write_json(listed, path, ["k"], ["file_path"])
    return C.reprocess(catalog_files.read_list(spark, path), m).select("list_idx", "manifest_idx", "file_path")


@query(M + "SELECT manifest_idx, row_number() OVER (PARTITION BY directory ORDER BY file_size DESC, file_path) - 1 AS place, row_number() OVER (ORDER BY file_path) - 1 AS position FROM m")
def catalog_positions(spark, sf):
    """Dense places in the whole catalog and in each directory, by counts of partitions."""
    m = manifest(spark, sf).select("manifest_idx", "file_path", (-F.col("file_size")).alias("smaller"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("directory"))
    whole = numbered(m, ["file_path"], name="position")
    return numbered(whole, ["smaller", "file_path"], ["directory"], "place").select("manifest_idx", "place", "position")


#: Documents of a file of the written tree.
SHELF = 500
FILE = f"""WITH f AS (SELECT source, lang, doc_id // {SHELF} AS shelf, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT 'source=' || source || '/lang=' || lang || '/shelf=' || shelf AS directory, strlen(content) AS file_size, sha256(content) AS sha256, 'text/plain' AS mime_type FROM f"""


def tree(spark, sf):
    """Documents as text files in directories by source, language and shelf."""
    root = shared_path(spark, "tree")
    root = root.removeprefix("file://") if file_listing.local(root.removeprefix("file://")) else root
    shelf = F.floor(F.col("doc_id") / SHELF).cast("string")
    key = lambda c: F.coalesce(F.col(c), F.lit("__HIVE_DEFAULT_PARTITION__"))
    path = F.concat(F.lit(f"{root}/source="), key("source"), F.lit("/lang="), key("lang"), F.lit("/shelf="), shelf, F.lit("/texts.txt"))
    files.write_texts(table(spark, sf, "documents").where("text is not null").select(path.alias("path"), "doc_id", "text"), "doc_id")
    return root


def scanned(found, root):
    shown = F.regexp_extract("file_path", r"(source=.*)/[^/]*$", 1)
    return found.where(F.col("file_path").endswith(".txt") & ~F.col("file_name").startswith(".")).select(shown.alias("directory"), "file_size", "sha256", "mime_type")


@query(FILE)
def directory_scan(spark, sf):
    """A written tree of text files, listed, hashed and typed."""
    root = tree(spark, sf)
    return scanned(files.scan(spark, root), root)


@query(FILE + " WHERE directory LIKE 'source=src1/%' AND file_size > 20000")
def directory_scan_pruned(spark, sf):
    """Part of the tree: paths and sizes are pushed into the listing, and no other file is opened."""
    root = tree(spark, sf)
    return scanned(files.scan(spark, root, condition=F.col("path").startswith(f"{root}/source=src1/") & (F.col("size") > 20_000)), root)


@query(f"SELECT * FROM ({FILE}) ORDER BY directory LIMIT 7")
def directory_scan_first(spark, sf):
    """The first files of the tree in path order; no other file is opened."""
    root = tree(spark, sf)
    return scanned(files.scan(spark, root, limit=7, condition=F.col("path").startswith(f"{root}/source=") & F.col("path").endswith(".txt")), root)


@query(M + "SELECT file_path, mime_type, 'no model takes it' AS reason, CASE WHEN extracted_text IS NULL THEN '' ELSE left(extracted_text, 40) END AS info FROM m WHERE mime_type = ''")
def unprocessed_log(spark, sf):
    """Files that no model takes, appended to a log in two runs and read again."""
    path = shared_path(spark, "log")
    m = manifest(spark, sf).where(P.model_of().isNull() & (F.col("mime_type") == ""))
    rows = m.select("manifest_idx", "file_path", "mime_type", F.lit("no model takes it").alias("reason"), F.left("extracted_text", F.lit(40)).alias("info"))
    for half in (0, 1):
        catalog_files.log_unprocessed(rows.where(F.col("manifest_idx") % 2 == half), path)
    return catalog_files.read_log(spark, path).select("file_path", "mime_type", "reason", F.coalesce("info", F.lit("")).alias("info"))


@query(M + "SELECT 'types' AS asset, count(DISTINCT mime_type) AS groups, count(*) AS entries FROM m UNION ALL SELECT 'unsafe', 1, count(*) FROM m WHERE is_nsfw UNION ALL SELECT 'catalog', 1, count(*) FROM m")
def catalog_assets(spark, sf):
    """A catalog file with its indexes, and how much each holds."""
    path = shared_path(spark, "assets") + "/manifest.json"
    catalog_files.export_json(manifest(spark, sf), path)
    held = catalog_files.assets(spark, path)
    types = held["types"].agg(F.lit("types").alias("asset"), F.count_distinct("mime").alias("groups"), F.count(F.lit(1)).alias("entries"))
    others = [held[k].agg(F.lit(k).alias("asset"), F.lit(1).cast("long").alias("groups"), F.count(F.lit(1)).alias("entries")) for k in ("unsafe", "catalog")]
    return types.unionByName(others[0]).unionByName(others[1])


@query(M + "SELECT file_path, CASE WHEN status = 'complete' THEN status ELSE 'pending_extraction' END AS status, round(last_modified - CASE WHEN status = 'complete' THEN 0 ELSE 1 END, 3) AS last_modified FROM m")
def catalog_publishing(spark, sf):
    """The catalog at rest, kept by a stream of arriving records: all files as pending, then those that were completed."""
    base = shared_path(spark, "publishing")
    m = manifest(spark, sf).drop("manifest_idx")
    arriving = (m.withColumns({"status": F.lit("pending_extraction"), "last_modified": F.col("last_modified") - 1}), m.where("status = 'complete'"))
    for rows in arriving:
        rows.write.mode("append").parquet(f"{base}/in")
        incremental.publish(spark, f"{base}/in", f"{base}/catalog", f"{base}/checkpoint").awaitTermination()
    return bucket_store.read(spark, f"{base}/catalog").select("file_path", "status", F.round("last_modified", 3).alias("last_modified"))
