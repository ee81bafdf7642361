"""Substring search in paths by an index of their three-letter pieces (grams).

A posting is a gram and a row's key. Postings lie in ranges of gram and key, so a scan for one gram opens only the files
and row groups that can hold it, and a gram that every path has is spread over many files. A search looks up how many
rows hold each gram of the term, intersects the lists of the rarest ones, the shortest first, and verifies what is left
by the text itself, so its rows are those of a scan. Terms under three letters have no gram and are searched by a scan.
Paths are compared in lower case; a null path is in no list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlight.functions import schema as S

GRAM = 3
#: Lists that are intersected; more would cost more than verifying the rest.
LISTS = 3


def grams(text: Column) -> Column:
    """The distinct grams of a text; none if it is shorter or null."""
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass
class Index:
    """The postings and their counts under a folder, beside the rows they speak of."""

    rows: DataFrame
    folder: str
    key: str
    path: str

    def read(self, name: str) -> DataFrame:
        return self.rows.sparkSession.read.parquet(f"{self.folder}/{name}")

    def lists(self, term: str) -> list[str] | None:
        """The term's rarest grams, the rarest first; null if one of them is in no path."""
        own = {term[i : i + GRAM] for i in range(len(term) - GRAM + 1)}
        known = self.read("counts").where(F.col("gram").isin(*own)).orderBy("n", "gram").collect()  # a row for each gram of the term at most
        return [r["gram"] for r in known][:LISTS] if len(known) == len(own) else None


def build(rows: DataFrame, folder: str, key: str = "manifest_idx", path: str = "file_path") -> Index:
    """Writes the index of a table's paths; keys tell its rows apart."""
    posts = rows.select(F.explode(grams(F.lower(path))).alias("gram"), F.col(key).alias("key"))
    posts.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{folder}/postings")
    spark: SparkSession = rows.sparkSession
    counts = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
    return Index(rows, folder, key, path)


def search(index: Index, term: str) -> DataFrame:
    """The rows whose path holds the trimmed term, case aside; a blank term matches nothing."""
    t = term.strip().lower()
    holds = F.contains(F.lower(index.path), F.lit(t)) if t else F.lit(False)
    if len(t) < GRAM:
        return index.rows.where(holds)
    lists = index.lists(t)
    if not lists:
        return index.rows.where("false")
    posts = index.read("postings")
    found = posts.where(F.col("gram") == lists[0]).select("key")
    for gram in lists[1:]:
        found = found.join(posts.where(F.col("gram") == gram).select("key"), "key", "left_semi")
    return index.rows.join(found.withColumnRenamed("key", index.key), index.key, "left_semi").where(holds)


def search_with_fallback(index: Index, term: str) -> DataFrame:
    """Matches among unfinished files; if there are none, among all. The lists are read twice, the table only for what they hold."""
    hits = search(index, term)
    unfinished = F.col("status") != S.COMPLETE
    return hits.where(unfinished) if not hits.where(unfinished).isEmpty() else hits
