"""A corpus pipeline of the training-data operators: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``; the last returns packed pieces.

Null and empty texts have no words and go in the first stage; a null source or language is a site of its own; rows with
null ids stay as far as their text does, rows that agree in id and text are near duplicates of each other by their id
and one of them stays. Texts may be of any length. On a tie the smaller id stays. An empty table gives empty results.
Extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archlight.llm import long_matches, near_dups, packing, quality_rules, site_quality
from archlight.llm.common import forget, settle, table
from archlight.llm.queries import vocabulary

#: Of the near-dedup stage; the query ``op7`` has a threshold of its own.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them the documents that lose too much text or fail the base rules."""
    return quality_rules.clean_documents(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier rejects go. It is fitted on a bounded sample of the labelled raw documents."""
    model = site_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return site_quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: links are at a similarity of 0.8 or more."""
    return near_dups.keep(docs, NEAR_PERCENT)


def long_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 200-byte string that starts elsewhere too go; documents stay, if only with an empty text."""
    return long_matches.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classify),
    ("near dedup", near_dedup),
    ("long match dedup", long_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Similarity joins, long matches and packing cannot be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None
