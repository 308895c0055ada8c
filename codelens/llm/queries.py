"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelens.llm import (
    crf_quality,
    decontaminate,
    exact_dedup,
    hard_negatives,
    licences,
    ngram_lm,
    packing,
    personal_data,
    ranked_search,
    simhash,
    suffix_dedup,
    token_files,
    warc,
)
from codelens.llm.common import table


def op1_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(table(spark, folder, "documents"))


def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.report(table(spark, folder, "documents"))


def op5_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_suffix_lpf(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


def op7_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op8_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    return crf_quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_licence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_matches(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_counts(table(spark, folder, "documents"))


def op11_nra_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.report(table(spark, folder, "embeddings"))


def op13_deobfuscated_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.report(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_hilbert_packing,
        op2_winnowing,
        op3_warc,
        op4_exact_dedup,
        op5_cross_entropy_difference,
        op6_suffix_lpf,
        op7_simhash_trie,
        op8_line_crf_quality,
        op9_licence_rules,
        op10_token_counts,
        op11_nra_search,
        op12_bond_negatives,
        op13_deobfuscated_pii,
    )
}
