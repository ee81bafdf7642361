"""Analysis tasks of a file: selection, completion, versions and roll-ups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema as S

TEXT_TASKS = ("text_analysis", "people_analysis", "estate_analysis", "password_detection", "financial_analysis")


def names(column: str = "analysis_tasks") -> Column:
    return F.transform(F.coalesce(F.col(column), F.array().cast(f"array<{S.TASK}>")), lambda t: t["name"])


def versions() -> Column:
    return F.create_map(*(F.lit(x) for pair in S.TASK_VERSIONS.items() for x in pair))


def new_task(name: Column) -> Column:
    version = F.coalesce(F.try_element_at(versions(), name), F.lit(1))
    return F.struct(name.alias("name"), F.lit(S.TASK_PENDING).alias("status"), F.lit(None).cast("string").alias("error_message"), version.alias("version"))


def required(mime: Column, path: Column, has_text: Column) -> Column:
    """Names of the tasks a file needs, in order."""
    none = F.array().cast("array<string>")
    m = F.coalesce(mime, F.lit(""))
    text = F.when(has_text, F.array(*map(F.lit, TEXT_TASKS))).otherwise(none)
    image = F.when(m.startswith("image/"), F.array(F.lit("image_description"), F.lit("nsfw_classification"))).otherwise(none)
    video = F.when(m.startswith("video/") & ~F.lower(path).endswith(".asx"), F.array(F.lit("video_summary"), F.lit("nsfw_classification"))).otherwise(none)
    access = F.lower(m) == "application/x-msaccess"
    return F.when(access, F.concat(text, F.array(F.lit("access_db_analysis")))).otherwise(F.concat(text, image, video))


def required_tasks(mime: Column, path: Column, has_text: Column) -> Column:
    return F.transform(required(mime, path, has_text), new_task)


def ensure(has_text: Column) -> Column:
    """Existing tasks, then what is missing of the required ones as pending."""
    missing = F.array_except(required(F.col("mime_type"), F.col("file_path"), has_text), names())
    return F.concat(F.col("analysis_tasks"), F.transform(missing, new_task))


def reset_outdated(manifest: DataFrame) -> DataFrame:
    """Adds missing tasks, bumps outdated versions to pending, clears their payloads; ``reset_count`` tells how many changed.

    A text that is present but empty counts as text here.
    """
    need = F.array_except(required(F.col("mime_type"), F.col("file_path"), F.col("extracted_text").isNotNull()), names())
    known = versions()
    expected = lambda t: F.coalesce(F.try_element_at(known, t["name"]), t["version"])
    stale = F.filter("analysis_tasks", lambda t: t["version"] < expected(t))
    changed = F.concat(need, F.transform(stale, lambda t: t["name"]))
    bumped = F.transform(
        "analysis_tasks",
        lambda t: F.when(
            t["version"] < expected(t),
            F.struct(t["name"].alias("name"), F.lit(S.TASK_PENDING).alias("status"), F.lit(None).cast("string").alias("error_message"), expected(t).alias("version")),
        ).otherwise(t),
    )
    out = manifest.withColumns({"_changed": changed, "_tasks": F.concat(bumped, F.transform(need, new_task))})
    done = F.col("status").isin(S.COMPLETE, S.FAILED) & (F.size("_changed") > 0)
    clears = {"contains_password": "password_detection", "passwords": "password_detection", "has_estate_relevant_info": "estate_analysis", "estate_information": "estate_analysis"}
    kinds = dict(manifest.dtypes)
    empty = {"passwords": F.array().cast(kinds.get("passwords", "array<string>")), "estate_information": F.from_json(F.lit("{}"), S.ESTATE)}
    reset = {c: F.when(F.array_contains("_changed", t), empty.get(c, F.lit(None).cast("boolean"))).otherwise(F.col(c)) for c, t in clears.items() if c in kinds}
    return out.withColumns(reset | {"status": F.when(done, S.PENDING_ANALYSIS).otherwise(F.col("status")), "analysis_tasks": F.col("_tasks"), "reset_count": F.size("_changed")}).drop("_changed", "_tasks")


def rescan(manifest: DataFrame) -> DataFrame:
    """A file as if freshly found: tasks by the text it had, then everything cleared."""
    kinds = dict(manifest.dtypes)
    lists = {c: F.array().cast(kinds[c]) for c in ("mentioned_people", "potential_red_flags", "incriminating_items", "passwords") if c in kinds}
    nulls = {c: F.lit(None).cast(kinds[c]) for c in ("extracted_text", "extracted_frames", "summary", "description", "is_nsfw", "has_financial_red_flags", "confidence_score", "contains_password", "has_estate_relevant_info") if c in kinds}
    maps = {"estate_information": F.from_json(F.lit("{}"), S.ESTATE)} if "estate_information" in kinds else {}
    tasks = required_tasks(F.col("mime_type"), F.col("file_path"), F.col("extracted_text").isNotNull())
    return manifest.withColumns(lists | nulls | maps | {"analysis_tasks": tasks, "status": F.lit(S.PENDING_EXTRACTION)})


def count(status: str) -> Column:
    return F.size(F.filter("analysis_tasks", lambda t: t["status"] == status))


def file_status(filtered: bool = False) -> Column:
    """Pending or failed tasks make a file failed, else it is complete, or pending under a filter on tasks."""
    return F.when((count(S.TASK_PENDING) > 0) | (count(S.TASK_ERROR) > 0), S.FAILED).otherwise(S.PENDING_ANALYSIS if filtered else S.COMPLETE)


def file_reason() -> Column:
    """``reason, info`` of a failed file: its pending tasks, else its failed ones with their errors."""
    of = lambda status, show: F.array_join(F.transform(F.filter("analysis_tasks", lambda t: t["status"] == status), show), ", ")
    waiting, broken = of(S.TASK_PENDING, lambda t: t["name"]), of(S.TASK_ERROR, lambda t: F.concat(t["name"], F.lit(": "), F.coalesce(t["error_message"], F.lit("unknown error"))))
    reason = F.when(count(S.TASK_PENDING) > 0, "analysis_tasks_incomplete").when(count(S.TASK_ERROR) > 0, "analysis_task_failed")
    return F.struct(reason.alias("reason"), F.when(count(S.TASK_PENDING) > 0, waiting).when(count(S.TASK_ERROR) > 0, broken).alias("info"))


def incomplete(manifest: DataFrame) -> DataFrame:
    """One row for each unfinished task of a finished file, with all unfinished names of the file."""
    open_ = F.filter("analysis_tasks", lambda t: t["status"] != S.TASK_COMPLETE)
    found = manifest.where(F.col("status").isin(S.COMPLETE, S.FAILED)).withColumn("_open", open_)
    names_ = F.array_join(F.transform("_open", lambda t: t["name"]), ", ")
    return found.select("*", names_.alias("incomplete_tasks"), F.explode("_open").alias("_task")).drop("_open")
