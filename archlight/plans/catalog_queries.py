"""Filters, statistics, indexes, selection and deduplication over the catalog view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.functions import formats
from archlight.functions import predicates as P
from archlight.operators import catalog as C
from archlight.operators import metrics, path_search
from archlight.sources import files
from archlight.sources.catalog_tables import MANIFEST_SQL as M
from archlight.sources.catalog_tables import SHEET, manifest, table
from archlight.sources.shared import shared_path

from .registry import query

DONE = "list_filter(analysis_tasks, lambda t: t.status = 'complete')"
LISTED = "lower(file_name) AS display, manifest_idx, file_path"
TEXT = "coalesce(extracted_text, '') <> ''"
IDS = "SELECT manifest_idx FROM m WHERE "


def ids(df: DataFrame) -> DataFrame:
    return df.select("manifest_idx")


def filtered(spark: SparkSession, sf: str, **conditions) -> DataFrame:
    return ids(manifest(spark, sf).where(P.CatalogFilter(**({"hide_nsfw": False} | conditions)).condition()))


@query(M + "SELECT status, count(*) AS n FROM m GROUP BY status")
def status_counts(spark, sf):
    return C.status_counts(manifest(spark, sf))


@query(M + f"SELECT mime_type, count(*) AS total, count(*) FILTER ({TEXT}) AS with_text, count(*) FILTER (NOT {TEXT}) AS without_text, min(manifest_idx) AS first_idx FROM m WHERE status = 'complete' GROUP BY mime_type")
def mime_stats(spark, sf):
    return C.mime_stats(manifest(spark, sf))


@query(M + f"SELECT mime_type, total, row_number() OVER (ORDER BY total DESC, first_idx) AS place FROM (SELECT mime_type, count(*) AS total, min(manifest_idx) AS first_idx FROM m WHERE status = 'complete' GROUP BY mime_type)")
def mime_stats_sorted(spark, sf):
    from pyspark.sql import Window

    ranked = C.sort_stats(C.mime_stats(manifest(spark, sf)), "total")  # a few types
    return ranked.select("mime_type", "total", F.row_number().over(Window.orderBy(F.desc("total"), "first_idx")).cast("long").alias("place"))


@query(M + f"SELECT count(*) AS total, count(*) FILTER (is_nsfw) AS nsfw, count(*) FILTER (mime_type LIKE 'image/%' AND NOT {TEXT}) AS images_without_text FROM m WHERE status = 'complete'")
def completed_scalars(spark, sf):
    return C.completed_scalars(manifest(spark, sf))


@query(
    M + "SELECT count(*) FILTER (coalesce(summary, '') <> '') AS with_summary, count(*) FILTER (coalesce(summary, '') = '') AS without_summary, count(*) FILTER (has_financial_red_flags) AS red_flags, "
    "count(*) FILTER (coalesce(contains_password, false) OR has_password_rows) AS with_passwords, count(*) FILTER (has_estate) AS with_estate FROM m WHERE status = 'complete'"
)
def extended_counters(spark, sf):
    return C.extended_counters(manifest(spark, sf))


@query(
    M + "SELECT count(*) AS files, count(*) FILTER (status = 'complete') AS complete, count(DISTINCT mime_type) AS types, count(*) FILTER (is_nsfw) AS nsfw, count(*) FILTER (has_financial_red_flags) AS red_flags, "
    "count(*) FILTER (coalesce(contains_password, false) OR has_password_rows) AS passwords, count(*) FILTER (has_estate) AS estate FROM m"
)
def headline_metrics(spark, sf):
    return C.headline(manifest(spark, sf))


@query(M + IDS + "NOT coalesce(is_nsfw, false)")
def filter_hide_nsfw(spark, sf):
    return filtered(spark, sf, hide_nsfw=True)


@query(M + IDS + "mime_type IN ('image/png', 'text/plain')")
def filter_file_type(spark, sf):
    return filtered(spark, sf, file_types=("image/png", "text/plain"))


@query(M + IDS + "has_financial_red_flags")
def filter_red_flags(spark, sf):
    return filtered(spark, sf, red_flags=True)


@query(M + IDS + f"len(analysis_tasks) > 0 AND len({DONE}) = len(analysis_tasks)")
def filter_fully_analyzed(spark, sf):
    return filtered(spark, sf, fully_analyzed=True)


@query(M + IDS + f"len(list_filter({DONE}, lambda t: t.name = 'text_analysis')) > 0 AND len(list_filter({DONE}, lambda t: t.name = 'people_analysis')) > 0")
def filter_required_tasks(spark, sf):
    return filtered(spark, sf, required_tasks=("text_analysis", "people_analysis"))


@query(M + IDS + "status = 'complete' AND len(analysis_tasks) = 0")
def filter_no_tasks(spark, sf):
    return filtered(spark, sf, no_tasks_complete=True)


@query(M + IDS + f"NOT coalesce(is_nsfw, false) AND mime_type IN ('image/png', 'text/plain', '{SHEET}') AND len(list_filter({DONE}, lambda t: t.name = 'text_analysis')) > 0")
def filter_combined(spark, sf):
    return filtered(spark, sf, hide_nsfw=True, file_types=("image/png", "text/plain", SHEET), required_tasks=("text_analysis",))


@query(M + IDS + "summary IS NULL AND coalesce(extracted_text, '') <> '' AND status = 'complete' AND mime_type = 'application/pdf'")
def cli_query(spark, sf):
    m = manifest(spark, sf)
    return ids(m.where(P.cli_query(no_summary=True, completed=True, mime_type="application/pdf") & ~P.cli_query(no_text=True)))


@query(M + IDS + "contains(lower(file_path), 'src1/en')")
def search_term(spark, sf):
    return ids(manifest(spark, sf).where(P.search("  SRC1/en ")))


@query(M + ", h AS (SELECT *, status <> 'complete' AS o FROM m WHERE contains(lower(file_path), '/77')) SELECT manifest_idx FROM h WHERE o OR NOT (SELECT coalesce(max(o), false) FROM h)")
def search_term_fallback(spark, sf):
    return ids(P.search_with_fallback(manifest(spark, sf), "/77"))


@query(M + IDS + "contains(lower(file_path), 'src1/en')")
def search_term_indexed(spark, sf):
    """The same rows by lists of grams."""
    m = manifest(spark, sf).select("manifest_idx", "file_path")
    return ids(path_search.search(path_search.build(m, shared_path(spark, "grams")), "  SRC1/en "))


@query(M + ", h AS (SELECT *, status <> 'complete' AS o FROM m WHERE contains(lower(file_path), '/77')) SELECT manifest_idx FROM h WHERE o OR NOT (SELECT coalesce(max(o), false) FROM h)")
def search_fallback_indexed(spark, sf):
    m = manifest(spark, sf).select("manifest_idx", "file_path", "status")
    return ids(path_search.search_with_fallback(path_search.build(m, shared_path(spark, "grams")), "/77"))


@query(M + "SELECT manifest_idx, file_path FROM m WHERE has_financial_red_flags")
def reprocess_selection(spark, sf):
    m = manifest(spark, sf)
    listed = m.where("has_financial_red_flags").select("file_path")
    return C.reprocess(listed, m).select("manifest_idx", "file_path")


@query(M + "SELECT file_path || '.old' AS file_path FROM m WHERE has_financial_red_flags")
def reprocess_missing(spark, sf):
    m = manifest(spark, sf)
    listed = m.where("has_financial_red_flags").select(F.explode(F.array("file_path", F.concat("file_path", F.lit(".old")))).alias("file_path"))
    return C.reprocess_missing(listed, m)


@query(M + "SELECT manifest_idx, CASE WHEN mime_type LIKE 'text/%' OR mime_type IN ('application/pdf', 'image/svg+xml', 'application/vnd.ms-excel') OR mime_type LIKE '%document' OR mime_type LIKE '%sheet' THEN 'text' WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' END AS model FROM m")
def model_routing(spark, sf):
    return manifest(spark, sf).select("manifest_idx", P.model_of().alias("model"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'financial') OR contains(lower(text), 'account')")
def financial_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("extracted_text")).where(P.financial()).select("doc_id")


@query(M + IDS + r"regexp_matches(coalesce(extracted_text, ''), '\S')")
def has_text(spark, sf):
    return ids(manifest(spark, sf).where(P.has_text()))


@query(M + "SELECT manifest_idx FROM m WHERE status <> 'complete' ORDER BY manifest_idx LIMIT 50")
def batch_limit(spark, sf):
    return ids(C.batch_limit(C.candidates(manifest(spark, sf)), 50))


@query(M + "SELECT manifest_idx, mime_type FROM m QUALIFY row_number() OVER (PARTITION BY mime_type ORDER BY manifest_idx) <= 3")
def per_mime_limit(spark, sf):
    return C.per_mime_limit(manifest(spark, sf), 3).select("manifest_idx", "mime_type")


MIME = "coalesce(nullif(mime_type, ''), 'unknown/unknown')"
PEOPLE = "(SELECT *, trim(unnest(mentioned_people)) AS person FROM m) WHERE person <> ''"
ESTATES = "m, (SELECT unnest(['Legal', 'Financial']) AS category) WHERE has_estate"


@query(M + f"SELECT {MIME} AS mime, {LISTED} FROM m")
def mime_index(spark, sf):
    return C.mime_index(manifest(spark, sf))


@query(M + f"SELECT {MIME} AS mime, count(*) AS n_files FROM m GROUP BY 1")
def mime_index_counts(spark, sf):
    return C.group_counts(C.mime_index(manifest(spark, sf)), "mime")


@query(M + f"SELECT {LISTED} FROM m WHERE mime_type = 'application/pdf' ORDER BY display, manifest_idx LIMIT 25")
def mime_index_page(spark, sf):
    return C.page(C.mime_index(manifest(spark, sf)), F.col("mime") == "application/pdf", 25).drop("mime")


@query(M + f"SELECT person, {LISTED} FROM {PEOPLE}")
def people_index(spark, sf):
    return C.people_index(manifest(spark, sf))


@query(M + f"SELECT person, count(*) AS n_files FROM {PEOPLE} GROUP BY person")
def people_index_counts(spark, sf):
    return C.group_counts(C.people_index(manifest(spark, sf)), "person")


@query(M + f"SELECT {LISTED} FROM m WHERE is_nsfw")
def nsfw_index(spark, sf):
    return C.flagged(manifest(spark, sf), P.truthy("is_nsfw"))


@query(M + f"SELECT {LISTED} FROM m WHERE coalesce(contains_password, false) OR has_password_rows")
def password_index(spark, sf):
    return C.flagged(manifest(spark, sf), P.password_candidate())


@query(M + f"SELECT category, CAST(1 AS BIGINT) AS n_items, {LISTED} FROM {ESTATES}")
def estate_index(spark, sf):
    return C.estate_index(manifest(spark, sf))


@query(M + f"SELECT category, count(*) AS n_files, count(*) AS n_items FROM {ESTATES} GROUP BY category")
def estate_index_counts(spark, sf):
    return C.group_counts(C.estate_index(manifest(spark, sf)), "category", n_items="n_items")


DIRECTORIES = M + """, d AS (SELECT directory, file_path FROM m), l AS (SELECT DISTINCT directory AS d FROM d),
    a AS (SELECT d AS directory FROM l UNION SELECT regexp_extract(d, '^(.*)/[^/]*$', 1) FROM l UNION SELECT regexp_extract(d, '^(.*)/[^/]*/[^/]*$', 1) FROM l UNION SELECT '/'),
    n AS (SELECT directory, CASE WHEN directory = '/' THEN NULL WHEN directory = '/archive' THEN '/' ELSE regexp_extract(directory, '^(.*)/[^/]*$', 1) END AS parent FROM a)
    """


@query(
    DIRECTORIES + """SELECT n.directory, n.parent, regexp_extract(n.directory, '([^/]*)$', 1) AS name, (SELECT count(*) FROM d WHERE d.directory = n.directory) AS n_files,
      (SELECT count(*) FROM n AS k WHERE k.parent = n.directory) AS n_subdirs FROM n"""
)
def directory_index(spark, sf):
    return C.directory_index(manifest(spark, sf))


@query(DIRECTORIES + "SELECT directory, 'file' AS kind, file_path AS entry FROM d UNION ALL SELECT parent, 'directory', directory FROM n WHERE parent IS NOT NULL")
def directory_entries(spark, sf):
    return C.directory_entries(manifest(spark, sf))


@query(M + "SELECT directory, count(*) AS n_files FROM m GROUP BY directory ORDER BY n_files DESC, directory LIMIT 1")
def default_directory(spark, sf):
    return C.default_directory(C.directory_index(manifest(spark, sf))).select("directory", "n_files")


@query(M + "SELECT manifest_idx, file_name AS file, directory, substring(coalesce(nullif(summary, ''), description, ''), 1, 120) AS summary FROM m")
def table_rows(spark, sf):
    return C.table_rows(manifest(spark, sf))


@query(M + "SELECT manifest_idx, CASE WHEN has_estate THEN 'Legal: Will ' || manifest_idx || '; Financial: Account' ELSE 'No highlights' END AS highlights FROM m")
def estate_rows(spark, sf):
    return C.estate_highlights(manifest(spark, sf))


@query(M + "SELECT manifest_idx, CASE WHEN file_size < 1024 THEN format('{:.1f} B', file_size::DOUBLE) ELSE format('{:.1f} KB', file_size / 1024.0::DOUBLE) END AS size FROM m")
def format_bytes(spark, sf):
    return manifest(spark, sf).select("manifest_idx", formats.human_bytes(F.col("file_size")).alias("size"))


@query(
    "SELECT event_id, trim(CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm ' ELSE '' END || CASE WHEN s % 60 > 0 OR s < 60 THEN (s % 60) || 's' ELSE '' END) AS took, "
    "CASE WHEN value <= 0 THEN '—' ELSE printf('%.1f', round_even(value, 1)) || ' files/min' END AS rate FROM (SELECT event_id, value, CAST(greatest(floor(value * 100), 0) AS BIGINT) AS s FROM events)"
)
def format_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", formats.duration(F.floor(F.col("value") * 100)).alias("took"), formats.rate(F.col("value"), "files/min").alias("rate"))


@query(
    M + "SELECT manifest_idx, strftime(make_timestamp(CAST(last_modified * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS modified, manifest_idx || '.txt' AS source, 'file-' || lpad(CAST(('0x' || substr(md5(file_path), 1, 8))::BIGINT % 100000 AS VARCHAR), 5, '0') AS short_name, "
    f"CASE WHEN len(analysis_tasks) > 0 THEN len({DONE}) || '/' || len(analysis_tasks) ELSE '—' END AS tasks, CAST(CASE WHEN len(analysis_tasks) > 0 THEN round_even(len({DONE}) * 40.0 / len(analysis_tasks), 0) ELSE 0 END AS INT) AS bar FROM m"
)
def file_labels(spark, sf):
    done, all_ = F.size(P.tasks_done()), F.size("analysis_tasks")
    return manifest(spark, sf).select(
        "manifest_idx", formats.modified_time(F.col("last_modified")).alias("modified"), formats.source_name(F.col("file_path")).alias("source"), formats.correlation_id(F.col("file_path")).alias("short_name"),
        formats.out_of(done, all_).alias("tasks"), formats.bar_fill(F.try_divide(done.cast("double"), all_)).alias("bar"),
    )


@query(M + "SELECT manifest_idx, CAST(json_object('manifest_idx', manifest_idx, 'file_path', file_path, 'mime_type', mime_type, 'is_nsfw', is_nsfw) AS VARCHAR) AS record FROM m WHERE status = 'complete' AND is_nsfw")
def query_json(spark, sf):
    found = manifest(spark, sf).where(P.cli_query(is_nsfw=True, completed=True))
    return found.select("manifest_idx", F.to_json(F.struct("manifest_idx", "file_path", "mime_type", "is_nsfw"), {"ignoreNullFields": "false"}).alias("record"))


@query(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'text/html' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime FROM documents"
)
def mime_detect(spark, sf):
    """Magic numbers before names, names before nothing; an office file is a zip file inside."""
    d = F.col("doc_id") % 6
    head = F.when(d == 0, F.unhex(F.lit("255044462D312E37"))).when(d == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(d == 4, F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit("")))
    name = F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.when(d == 2, ".TXT").when(d == 3, ".htm").when(d == 4, ".docx").otherwise(".dat"))
    return table(spark, sf, "documents").select("doc_id", files.mime_type(name, F.concat(head, F.col("text").cast("binary"))).alias("mime"))


@query(M + "SELECT sha256, count(*) AS n, min(manifest_idx) AS first_idx, CAST(sum(file_size) AS BIGINT) AS bytes FROM m GROUP BY sha256 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return C.duplicate_groups(manifest(spark, sf))


PLAN = """, r AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER w AS rn, first_value(file_path) OVER w AS kept_path FROM m WINDOW w AS (PARTITION BY sha256 ORDER BY length(file_path), file_path, manifest_idx))
"""


@query(M + PLAN + "SELECT manifest_idx, sha256, file_path, kept_path, CASE WHEN rn = 1 THEN 'keep' WHEN file_path = kept_path THEN 'remove entry: same path' ELSE 'delete file' END AS action FROM r WHERE n > 1")
def duplicate_removal_plan(spark, sf):
    return C.removal_plan(manifest(spark, sf))


@query(M + PLAN + "SELECT manifest_idx FROM r WHERE n = 1 OR rn = 1")
def manifest_after_prune(spark, sf):
    return ids(C.pruned(manifest(spark, sf)))


@query(M + "SELECT manifest_idx, coalesce(is_nsfw, false) AS filtered_out FROM m WHERE manifest_idx = 42")
def selected_path(spark, sf):
    m = manifest(spark, sf)
    path = m.where("manifest_idx = 42").first()
    return C.selected(m.where(P.CatalogFilter().condition()), m, path["file_path"] if path else "").select("manifest_idx", "filtered_out")


@query(M + "SELECT manifest_idx, sha256 FROM m")
def sha256_digest(spark, sf):
    return manifest(spark, sf).select("manifest_idx", "sha256")


@query(M + "SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS done, round(count(*) FILTER (status = 'complete') * 100.0 / count(*), 6)::DOUBLE AS percent, round(count(*) FILTER (status = 'complete') * 60.0 / 90, 6)::DOUBLE AS files_per_minute, round((count(*) - count(*) FILTER (status = 'complete')) * 90.0 / count(*) FILTER (status = 'complete'), 6)::DOUBLE AS eta_seconds FROM m")
def progress(spark, sf):
    p = metrics.progress(manifest(spark, sf), F.col("status") == "complete", 90.0)
    return p.select("total", "done", *(F.round(c, 6).cast("double").alias(c) for c in ("percent", "files_per_minute", "eta_seconds")))


@query(M + "SELECT manifest_idx, file_path, CASE WHEN manifest_idx % 4 < 3 THEN left(sha256, 1) || ',' || left(sha256, 2) || ',' || left(sha256, 3) ELSE '' END AS frames FROM m WHERE mime_type LIKE 'image/%' OR mime_type LIKE 'video/%' ORDER BY manifest_idx LIMIT 9")
def previews(spark, sf):
    """Beginnings of a file's hash stand for its frames; every fourth file has none."""
    frames = F.when(F.col("manifest_idx") % 4 < 3, F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.substring("sha256", F.lit(1), n)))
    found = C.previews(manifest(spark, sf).withColumn("extracted_frames", frames))
    return found.select("manifest_idx", "file_path", F.array_join("frames", ",").alias("frames"))


@query(M + f"SELECT manifest_idx, CAST(len({DONE}) AS INT) AS done, CAST(len(analysis_tasks) AS INT) AS total FROM m WHERE status <> 'complete' AND len({DONE}) > 0 ORDER BY manifest_idx LIMIT 5")
def active_files(spark, sf):
    return C.active(manifest(spark, sf))
