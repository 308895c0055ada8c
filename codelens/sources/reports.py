"""Writing and reading evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = ("summary", "quality_distribution", "category_statistics", "detailed_results", "unmatched")
_FEW_ROWS = ("summary", "quality_distribution")  # one and at most four


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Each part of the report as JSON Lines in a folder of its own.

    Only parts with a fixed number of rows are written as one file.
    """
    for part in (name for name in PARTS if name in report):
        rows = report[part].coalesce(1) if part in _FEW_ROWS else report[part]
        rows.write.mode("errorifexists").json(f"{path}/{part}")


def read_report_part(spark: SparkSession, path: str, part: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{part}")
