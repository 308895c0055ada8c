"""The documents' way to training sequences: five operators, each on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``;
the last returns the pieces of packed sequences. Stages are written and read
again, so a lost executor never costs more than one of them, and what a stage stored
on its way goes when its result is written. Null texts and repeated rows are treated
as each operator says; an empty document gives one piece, the end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelens.llm import crf_quality, decontaminate, exact_dedup, packing, simhash
from codelens.llm.common import table
from codelens.plans.layout import shared_folder, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good."""
    return crf_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the one with the smallest id."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the space-filling curve."""
    return packing.report(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, name.replace(" ", "-"))
        with workspace(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(folder)
        docs = spark.read.schema(kept.schema).parquet(folder)
    return docs
