"""Filters over the catalog and the vector table; every builder returns one condition."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema as S

#: Fixed value: phrases that mark a question about the collection itself.
STATS_PHRASES = (
    "how many", "total files", "count", "database stats", "how much", "all files", "files in", "archive", "database",
    "list files", "show files", "what files", "tell me about my files", "about my files", "my files",
)


def truthy(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def tasks_done() -> Column:
    return F.transform(F.filter("analysis_tasks", lambda t: t["status"] == S.TASK_COMPLETE), lambda t: t["name"])


@dataclass(frozen=True)
class CatalogFilter:
    """Optional conditions, all of which must hold; the default hides files that are not safe for work."""

    hide_nsfw: bool = True
    file_types: tuple[str, ...] = ()
    red_flags: bool = False
    fully_analyzed: bool = False
    required_tasks: tuple[str, ...] = ()
    no_tasks_complete: bool = False

    def condition(self) -> Column:
        parts = []
        if self.hide_nsfw:
            parts.append(~truthy("is_nsfw"))
        if self.file_types:
            parts.append(F.coalesce(F.col("mime_type").isin(*self.file_types), F.lit(False)))
        if self.red_flags:
            parts.append(truthy("has_financial_red_flags"))
        if self.fully_analyzed:
            parts.append((F.size("analysis_tasks") > 0) & F.forall("analysis_tasks", lambda t: F.coalesce(t["status"], F.lit("")) == S.TASK_COMPLETE))
        if self.required_tasks:
            parts.append(F.size(F.array_except(F.array(*map(F.lit, self.required_tasks)), tasks_done())) == 0)
        if self.no_tasks_complete:
            parts.append((F.col("status") == S.COMPLETE) & (F.size(F.coalesce("analysis_tasks", F.array())) == 0))
        return both(parts)


def cli_query(no_summary: bool = False, is_nsfw: bool = False, no_text: bool = False, completed: bool = False, mime_type: str | None = None) -> Column:
    """The batch query: a missing summary is null only, a missing text null or empty."""
    parts = []
    if no_summary:
        parts.append(F.col("summary").isNull())
    if is_nsfw:
        parts.append(truthy("is_nsfw"))
    if no_text:
        parts.append(F.coalesce(F.col("extracted_text"), F.lit("")) == "")
    if completed:
        parts.append(F.col("status") == S.COMPLETE)
    if mime_type:
        parts.append(F.col("mime_type") == mime_type)
    return both(parts)


def search(term: str) -> Column:
    """The trimmed term anywhere in the path, case aside; a blank term matches nothing."""
    t = term.strip().lower()
    return F.contains(F.lower("file_path"), F.lit(t)) if t else F.lit(False)


def search_with_fallback(manifest: DataFrame, term: str) -> DataFrame:
    """Matches among unfinished files; if there are none, among all."""
    hits = manifest.where(search(term)).withColumn("_open", F.col("status") != S.COMPLETE)
    any_open = hits.agg(F.max("_open").alias("_any"))  # one row
    return hits.join(F.broadcast(any_open)).where(F.col("_open") | ~F.col("_any")).drop("_open", "_any")


def model_of() -> Column:
    """Which model a file's MIME type asks for, if any."""
    m = F.col("mime_type")
    text = m.startswith("text/") | m.isin("application/pdf", "image/svg+xml", "application/vnd.ms-excel") | m.endswith("document") | m.endswith("sheet")
    return F.when(text, "text").when(m.startswith("image/"), "image").when(m.startswith("video/") & ~F.lower("file_path").endswith(".asx"), "video")


#: Which tasks each kind of model does.
MODEL_TASKS = {"text": ("text_analysis", "people_analysis", "estate_analysis", "password_detection", "financial_analysis", "access_db_analysis"), "image": ("image_description", "nsfw_classification"), "video": ("video_summary", "nsfw_classification")}


def pending_tasks(model: str | None = None, name: str | None = None) -> Column:
    """A file's pending tasks, of one kind of model and of one name if asked for."""
    wanted = lambda t: both([t["status"] == S.TASK_PENDING, *([t["name"].isin(*MODEL_TASKS[model])] if model else []), *([t["name"] == name] if name else [])])
    return F.filter("analysis_tasks", wanted)


def financial() -> Column:
    t = F.lower("extracted_text")
    return F.coalesce(F.contains(t, F.lit("financial")) | F.contains(t, F.lit("account")), F.lit(False))


def has_text() -> Column:
    return F.coalesce(F.rlike("extracted_text", F.lit(r"(?U)\S")), F.lit(False))


def vector_filter(hide_nsfw: bool = False, red_flags: bool = False, mime_types: tuple[str, ...] = (), only_nsfw: bool = False) -> Column:
    parts = []
    if hide_nsfw:
        parts.append(~F.col("metadata.is_nsfw"))
    if only_nsfw:
        parts.append(F.col("metadata.is_nsfw"))
    if red_flags:
        parts.append(F.col("metadata.has_financial_red_flags"))
    if mime_types:
        parts.append(F.col("metadata.mime_type").isin(*mime_types))
    return both(parts)


def asks_for_stats(prompt: Column) -> Column:
    return F.exists(F.array(*map(F.lit, STATS_PHRASES)), lambda k: F.contains(F.lower(prompt), k))


def valid_estate_item(item: Column) -> Column:
    return F.exists(F.map_values(item), lambda v: v.isNotNull() & (v != ""))


def password_candidate() -> Column:
    return truthy("contains_password") | (F.size(F.coalesce("passwords", F.array())) > 0)


def first_per_group(df: DataFrame, group: Column, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
