"""Types of the catalog and the normalisation of loosely typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record states, task states, task names with their current versions.
PENDING_EXTRACTION, PENDING_ANALYSIS, COMPLETE, FAILED = "pending_extraction", "pending_analysis", "complete", "failed"
TASK_PENDING, TASK_COMPLETE, TASK_ERROR = "pending", "complete", "error"
TASK_VERSIONS = {
    "text_analysis": 1,
    "image_description": 1,
    "people_analysis": 1,
    "video_summary": 1,
    "financial_analysis": 1,
    "nsfw_classification": 1,
    "access_db_analysis": 1,
    "password_detection": 5,
    "estate_analysis": 2,
}

TASK = "struct<name:string,status:string,error_message:string,version:int>"
PASSWORD = "struct<context:string,password:string>"
ESTATE = "map<string,array<map<string,string>>>"
MANIFEST = (
    "file_path string, file_name string, mime_type string, file_size bigint, last_modified double, sha256 string, status string, "
    f"extracted_text string, extracted_frames array<string>, analysis_tasks array<{TASK}>, summary string, description string, "
    "mentioned_people array<string>, is_nsfw boolean, has_financial_red_flags boolean, potential_red_flags array<string>, "
    f"incriminating_items array<string>, confidence_score int, contains_password boolean, passwords array<{PASSWORD}>, "
    f"has_estate_relevant_info boolean, estate_information {ESTATE}"
)
#: Loosely typed fields are read as JSON text and coerced afterwards.
LOOSE = ("summary", "potential_red_flags", "incriminating_items", "passwords", "estate_information", "mentioned_people")


def string_list(raw: Column) -> Column:
    """JSON text to a list of strings: null gives an empty list, a scalar a list of one, null items go."""
    trimmed = F.trim(raw)
    listed = F.filter(F.from_json(trimmed, "array<string>"), lambda x: x.isNotNull())
    return F.when(raw.isNull() | (trimmed == "null"), F.array().cast("array<string>")).when(trimmed.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(raw))


def password_list(raw: Column) -> Column:
    """A list stays; a map becomes one entry for each key; anything else an empty list."""
    kind = f"array<{PASSWORD}>"
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("context"), e["value"].alias("password")))
    return F.coalesce(F.when(F.trim(raw).startswith("["), F.from_json(raw, kind)).when(F.trim(raw).startswith("{"), pairs), F.array().cast(kind))


def estate_map(raw: Column) -> Column:
    """Every category is parsed by itself, so one of another shape does not lose the rest."""
    kept = F.transform_values(F.from_json(raw, "map<string,string>"), lambda _, v: F.from_json(v, "array<map<string,string>>"))
    return F.coalesce(F.map_filter(kept, lambda _, v: v.isNotNull()), F.from_json(F.lit("{}"), ESTATE))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sorted_json(raw: Column) -> Column:
    """An object summary as JSON with sorted keys and a space behind its own ``:`` and ``,``; values keep their types, nested ones are compact. Any other text stays as it is."""
    entries = F.array_sort(F.map_entries(F.from_json(raw, "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    shown = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.when(F.trim(raw).startswith("{") & entries.isNotNull(), F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))).otherwise(raw)


def normalize(raw: DataFrame) -> DataFrame:
    """Records read with the loose schema, as the typed catalog; missing fields get their defaults."""
    have = set(raw.columns)
    kinds = dict(part.strip().split(" ", 1) for part in MANIFEST.replace(", ", "\n").split("\n"))

    def col(name: str) -> Column:
        c = F.col(name) if name in have else F.lit(None).cast("string" if name in LOOSE else kinds[name])
        if name in ("potential_red_flags", "incriminating_items", "mentioned_people"):
            return string_list(c)
        if name == "passwords":
            return password_list(c)
        if name == "estate_information":
            return estate_map(c)
        if name == "summary":
            return sorted_json(c)
        if name == "status":
            return F.coalesce(c, F.lit(PENDING_EXTRACTION))
        if name == "analysis_tasks":
            return F.coalesce(c, F.array().cast(kinds[name]))
        return c

    return raw.select(*([F.col("manifest_idx")] if "manifest_idx" in have else []), *(col(n).alias(n) for n in kinds))


def loose_schema() -> str:
    return ", ".join(f"{n} string" if n in LOOSE else f"{n} {k}" for n, k in (p.strip().split(" ", 1) for p in MANIFEST.replace(", ", "\n").split("\n")))
