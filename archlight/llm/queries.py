"""The registered queries of the training-data operators, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, long_matches, manifest, near_dups, packing, page_text, quality_rules, sentence_spans, site_quality, telephony, token_counts, vector_codes, vector_dups
from .common import settle, table

#: Where the public tokenizers' files lie; None asks the installed package.
VOCABULARIES: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARIES:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.read_media(settle(telephony.store_bytes(table(spark, sf_dir, "documents")), "media"), keep_pcm=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.report(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_matches.report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.report(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_media_columns": op2_media_columns,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_counts": op5_token_counts,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_substring_dedup": sentence_spans.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
