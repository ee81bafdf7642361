"""Results of chunks merged per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(value: str) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("chunk", value))), lambda x: x[value])


def merge_text(parts: DataFrame, key: str) -> DataFrame:
    """Summaries joined in chunk order; the union of people, sorted."""
    people = F.array_sort(F.array_distinct(F.flatten(F.collect_list("people"))))
    return parts.groupBy(key).agg(F.array_join(ordered("summary"), " ").alias("summary"), people.alias("people"))


def merge_financial(parts: DataFrame, key: str) -> DataFrame:
    """Unions of flags and items; the mean confidence cut to a whole number, 0 if there is none."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = parts.groupBy(key).agg(union("red_flags"), union("items"), F.coalesce(F.floor(F.avg("confidence")), F.lit(0)).cast("int").alias("confidence"))
    return merged.withColumn("has_red_flags", F.size("red_flags") > 0)


def merge_estate(parts: DataFrame, key: str) -> DataFrame:
    """``key, category, items``: distinct whole entries in the order they came; an entry has a ``category`` and any further fields."""
    rows = parts.select(key, "chunk", F.posexplode("entries").alias("pos", "e")).select(key, "chunk", "pos", F.col("e.category").alias("category"), F.to_json(F.col("e").dropFields("category")).alias("entry"))
    first = rows.groupBy(key, "category", "entry").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    return first.groupBy(key, "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]), "|").alias("items"))


def merge_passwords(parts: DataFrame, key: str) -> DataFrame:
    """All entries in chunk order; a flag if there is any."""
    return parts.groupBy(key).agg(F.flatten(ordered("passwords")).alias("passwords")).withColumn("contains_password", F.size("passwords") > 0)
