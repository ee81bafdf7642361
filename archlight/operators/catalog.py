"""Statistics, indexes, deduplication and run selection over the catalog."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.functions import schema as S

UNKNOWN_MIME = "unknown/unknown"
SUMMARY_CHARS = 120


def display_name() -> Column:
    return F.lower(F.coalesce(F.nullif("file_name", F.lit("")), F.regexp_extract("file_path", r"([^/]*)$", 1), F.lit("")))


def listed(m: DataFrame, *group: str) -> DataFrame:
    """A row for each group and file, with what a list is sorted by: display name, then position in the catalog."""
    return m.select(*group, display_name().alias("display"), "manifest_idx", "file_path")


def page(index: DataFrame, condition: Column, n: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next ``n`` files of a group in display order; each task keeps its own n, so no group is gathered."""
    rest = condition & (F.struct("display", "manifest_idx") > F.struct(F.lit(after[0]).alias("display"), F.lit(after[1]).cast("long").alias("manifest_idx"))) if after else condition
    return index.where(rest).orderBy("display", "manifest_idx").limit(n)


# statistics


def status_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def mime_stats(m: DataFrame) -> DataFrame:
    """Completed files by MIME type: all, with text, without."""
    text = F.coalesce(F.col("extracted_text"), F.lit("")) != ""
    done = m.where(F.col("status") == S.COMPLETE)
    return done.groupBy("mime_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(text).alias("with_text"), F.count_if(~text).alias("without_text"), F.min("manifest_idx").alias("first_idx"))


def sort_stats(stats: DataFrame, by: str | None = None) -> DataFrame:
    """By type ascending, by a count descending with first-seen ties, or as first seen."""
    if by == "mime_type":
        return stats.orderBy("mime_type")
    return stats.orderBy(*([F.desc(by)] if by else []), "first_idx")


def completed_scalars(m: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("extracted_text"), F.lit("")) != ""
    return m.where(F.col("status") == S.COMPLETE).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(P.truthy("is_nsfw")).alias("nsfw"), F.count_if(F.col("mime_type").startswith("image/") & ~text).alias("images_without_text")
    )


def extended_counters(m: DataFrame) -> DataFrame:
    """The counters that are declared for completed files, with the meaning their names give."""
    summary = F.coalesce(F.col("summary"), F.lit("")) != ""
    return m.where(F.col("status") == S.COMPLETE).agg(
        F.count_if(summary).alias("with_summary"),
        F.count_if(~summary).alias("without_summary"),
        F.count_if(P.truthy("has_financial_red_flags")).alias("red_flags"),
        F.count_if(P.password_candidate()).alias("with_passwords"),
        F.count_if(F.size(F.map_keys("estate_information")) > 0).alias("with_estate"),
    )


def headline(m: DataFrame) -> DataFrame:
    return m.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == S.COMPLETE).alias("complete"),
        F.countDistinct("mime_type").alias("types"),
        F.count_if(P.truthy("is_nsfw")).alias("nsfw"),
        F.count_if(P.truthy("has_financial_red_flags")).alias("red_flags"),
        F.count_if(P.password_candidate()).alias("passwords"),
        F.count_if(F.size(F.map_keys("estate_information")) > 0).alias("estate"),
    )


def db_stats(vectors: DataFrame) -> DataFrame:
    """Rows of the vector table by MIME type, with the total of all types."""
    counts = vectors.groupBy(F.col("metadata.mime_type").alias("mime_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # a few types


def db_files(vectors: DataFrame, m: DataFrame) -> DataFrame:
    """Files of the vector table with their flags and the summary to show."""
    flags = vectors.select(F.col("metadata.file_path").alias("file_path"), "metadata.is_nsfw", "metadata.has_financial_red_flags")
    return with_summaries(vectors, m).join(flags, "file_path")


def last_by_path(m: DataFrame) -> DataFrame:
    """One row for each path: the last in the catalog."""
    return m.withColumn("_rn", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("manifest_idx")))).where("_rn = 1").drop("_rn")


def with_summaries(vectors: DataFrame, m: DataFrame) -> DataFrame:
    """Vector rows with their catalog summary, or the description where it is blank."""
    own = last_by_path(m).select("file_path", "summary", "description")
    text = F.coalesce(F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary")), F.nullif("description", F.lit("")), F.col("summary"))
    return vectors.select(F.col("metadata.file_path").alias("file_path"), F.col("metadata.mime_type").alias("mime_type")).join(own, "file_path", "left").select("file_path", "mime_type", text.alias("summary"))


# indexes


def mime_index(m: DataFrame) -> DataFrame:
    """``mime, display, manifest_idx, file_path`` of every file."""
    return listed(m.withColumn("mime", F.coalesce(F.nullif("mime_type", F.lit("")), F.lit(UNKNOWN_MIME))), "mime")


def people_index(m: DataFrame) -> DataFrame:
    """A row for each mention: a person twice in a file is there twice."""
    people = m.withColumn("person", F.explode("mentioned_people")).withColumn("person", F.trim("person")).where("person <> ''")
    return listed(people, "person")


def flagged(m: DataFrame, condition: Column) -> DataFrame:
    return listed(m.where(condition))


def estate_index(m: DataFrame) -> DataFrame:
    """A row for each category and file, with the file's usable items in it."""
    rows = m.withColumns({"_e": F.map_entries("estate_information")}).withColumn("_e", F.explode("_e"))
    usable = F.size(F.filter(F.col("_e")["value"], P.valid_estate_item)).cast("long")
    return listed(rows.withColumns({"category": F.col("_e")["key"], "n_items": usable}), "category", "n_items")


def group_counts(index: DataFrame, group: str, **sums: str) -> DataFrame:
    """Files, and sums of further columns, of each group of an index; counted with partial aggregation."""
    return index.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), *(F.sum(c).alias(k) for k, c in sums.items()))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.when(F.array_join(F.slice(parts, 1, i), "/") == "", "/").otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def directory_index(m: DataFrame) -> DataFrame:
    """Every directory with its direct files, its sub-directories and its parent."""
    up = m.select(ancestors(F.col("file_path")).alias("dirs"))
    dirs = up.select(F.explode("dirs").alias("directory")).distinct()
    files = m.select(F.get(ancestors(F.col("file_path")), F.lit(0)).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"))
    parent = F.when(F.col("directory") == "/", F.lit(None).cast("string")).otherwise(F.get(ancestors(F.col("directory")), F.lit(0)))
    named = dirs.withColumns({"parent": parent, "name": F.regexp_extract("directory", r"([^/]*)$", 1)})
    subs = named.where("parent is not null").groupBy(F.col("parent").alias("directory")).agg(F.count(F.lit(1)).alias("n_subdirs"))
    out = named.join(files, "directory", "left").join(subs, "directory", "left")
    return out.select("directory", "parent", "name", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_subdirs", F.lit(0)).cast("long").alias("n_subdirs"))


def directory_entries(m: DataFrame) -> DataFrame:
    """``directory, kind, entry``: the files and the sub-directories directly in every directory."""
    up = m.select("file_path", ancestors(F.col("file_path")).alias("dirs"))
    files = up.select(F.get("dirs", F.lit(0)).alias("directory"), F.lit("file").alias("kind"), F.col("file_path").alias("entry"))
    pairs = F.transform(F.slice("dirs", 1, F.greatest(F.size("dirs") - 1, F.lit(0))), lambda d, i: F.struct(F.get("dirs", i + 1).alias("directory"), d.alias("entry")))
    subs = up.select(F.explode(pairs).alias("p")).select("p.directory", F.lit("directory").alias("kind"), "p.entry").distinct()
    return files.unionByName(subs)


def default_directory(directories: DataFrame) -> DataFrame:
    """The directory with the most direct files, the first by name of equal ones: one row."""
    return directories.orderBy(F.desc("n_files"), "directory").limit(1)


# rows for tables


def table_rows(m: DataFrame) -> DataFrame:
    text = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("description", F.lit("")), F.lit(""))
    return m.select(
        "manifest_idx",
        F.coalesce(F.nullif("file_name", F.lit("")), F.regexp_extract("file_path", r"([^/]*)$", 1)).alias("file"),
        F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("directory"),
        F.substring(text, 1, SUMMARY_CHARS).alias("summary"),
    )


def estate_highlights(m: DataFrame, default: str = "No highlights") -> DataFrame:
    """The first usable label of up to three categories."""
    some = lambda v: F.nullif(F.coalesce(v, F.lit("")), F.lit(""))
    label = lambda x: F.coalesce(some(F.try_element_at(x, F.lit("item"))), some(F.try_element_at(x, F.lit("details"))), some(F.try_element_at(x, F.lit("why_it_matters"))))
    shown = F.transform(F.map_entries("estate_information"), lambda e: F.struct(e["key"].alias("k"), F.get(F.filter(F.transform(e["value"], label), lambda v: v.isNotNull()), F.lit(0)).alias("v")))
    text = F.array_join(F.transform(F.slice(F.filter(shown, lambda e: e["v"].isNotNull()), 1, 3), lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "; ")
    return m.select("manifest_idx", F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text).alias("highlights"))


#: What a page shows at most: frames of a film, pictures of a folder, files at work.
FRAMES, PREVIEWS, ACTIVE = 3, 9, 5


def previews(m: DataFrame, directory: str | None = None, n: int = PREVIEWS) -> DataFrame:
    """The first pictures and films, of one directory if asked for, with their first frames."""
    seen = F.col("mime_type").startswith("image/") | F.col("mime_type").startswith("video/")
    here = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1) == directory if directory else F.lit(True)
    frames = F.slice(F.coalesce(F.col("extracted_frames"), F.array().cast("array<string>")), 1, FRAMES).alias("frames")
    return m.where(seen & here).select("manifest_idx", "file_path", frames).orderBy("manifest_idx").limit(n)


def active(m: DataFrame, n: int = ACTIVE) -> DataFrame:
    """The first unfinished files of which something is done, with their progress."""
    done = F.size(P.tasks_done())
    return candidates(m).where(done > 0).select("manifest_idx", done.alias("done"), F.size("analysis_tasks").alias("total")).orderBy("manifest_idx").limit(n)


# selection of a run


def candidates(m: DataFrame) -> DataFrame:
    return m.where(F.col("status") != S.COMPLETE)


def batch_limit(m: DataFrame, n: int) -> DataFrame:
    return m.orderBy("manifest_idx").limit(n) if n else m


def per_mime_limit(m: DataFrame, k: int) -> DataFrame:
    return P.first_per_group(m, F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("unknown")), [F.col("manifest_idx")], k) if k else m


def reprocess(listed: DataFrame, m: DataFrame) -> DataFrame:
    """Catalog rows of a list of paths, with the list's positions."""
    return listed.join(last_by_path(m), "file_path")


def reprocess_missing(listed: DataFrame, m: DataFrame) -> DataFrame:
    return listed.join(m.select("file_path"), "file_path", "left_anti")


def selected(filtered: DataFrame, m: DataFrame, path: str) -> DataFrame:
    """A row by its path, with a flag if the filter hides it."""
    inside = filtered.select("file_path").distinct().withColumn("_in", F.lit(True))
    return last_by_path(m).where(F.col("file_path") == path).join(inside, "file_path", "left").withColumn("filtered_out", F.col("_in").isNull()).drop("_in")


# deduplication


def hashed(m: DataFrame) -> DataFrame:
    return m.where(F.coalesce(F.col("sha256"), F.lit("")) != "")


def duplicate_groups(m: DataFrame) -> DataFrame:
    """Hashes that several files have; counted with partial aggregation."""
    return hashed(m).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("manifest_idx").alias("first_idx"), F.sum("file_size").alias("bytes")).where("n > 1")


def removal_plan(m: DataFrame, exists: Column | None = None) -> DataFrame:
    """What happens to each member of a duplicate group: one is kept, the shortest path among files that exist."""
    groups = hashed(m).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.count("file_path").alias("paths")).where("n > 1 and paths > 0").select("sha256")
    there = exists if exists is not None else F.lit(True)
    order = Window.partitionBy("sha256").orderBy(F.col("file_path").isNull(), there.desc(), F.length("file_path"), "file_path", "manifest_idx")
    ranked = m.join(groups, "sha256", "left_semi").withColumns({"_rn": F.row_number().over(order), "kept_path": F.first("file_path").over(order)})
    action = (
        F.when(F.col("_rn") == 1, "keep")
        .when(F.col("file_path").isNull(), "remove entry: no path")
        .when(F.col("file_path") == F.col("kept_path"), "remove entry: same path")
        .when(~there, "remove entry: missing file")
        .otherwise("delete file")
    )
    return ranked.select("manifest_idx", "sha256", "file_path", "kept_path", action.alias("action"))


def pruned(m: DataFrame, exists: Column | None = None) -> DataFrame:
    """The catalog without removed rows."""
    gone = removal_plan(m, exists).where("action <> 'keep'").select("manifest_idx")
    return m.join(gone, "manifest_idx", "left_anti")


def apply_removals(plan: DataFrame, delete: bool = False) -> DataFrame:
    """``manifest_idx, file_path, outcome`` of a removal plan: only entries whose action says so lose their file, and only if ``delete`` is given.

    Tasks delete the files of their own rows; the entry of a file that is missing, is a directory or cannot be deleted
    is removed all the same.
    """

    def outcome(action: str, path: str | None) -> str:
        if action != "delete file":
            return "kept" if action == "keep" else "entry removed"
        if os.path.islink(path) and not os.path.exists(path):
            return "broken link"
        if os.path.isdir(path):
            return "directory: entry removed"
        if not os.path.exists(path):
            return "already missing"
        if not delete:
            return "dry run"
        try:
            os.remove(path)
        except OSError as e:
            return f"error: {e.strerror}"
        return "deleted"

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"manifest_idx": part["manifest_idx"], "file_path": part["file_path"], "outcome": [outcome(a, p) for a, p in zip(part["action"], part["file_path"])]})

    return plan.select("manifest_idx", "file_path", "action").mapInPandas(work, "manifest_idx long, file_path string, outcome string")
