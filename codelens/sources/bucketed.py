"""Runs and their cases stored side by side, so that judging moves no code.

Both tables are bucketed by case and part. A case with more runs than a bucket's fair
share has several parts: its runs are dealt out over them by ``result_id``, and the case
is written once for each. Tables with equal buckets join where they lie, whatever the
size of the case table, in this job and in every later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens import schemas
from codelens.operators.evaluation import PART


def _write(df: DataFrame, name: str, path: str, buckets: int) -> None:
    placed = df.repartition(buckets, "case_id", PART)  # one file for each bucket
    placed.write.bucketBy(buckets, "case_id", PART).option("path", path).mode("errorifexists").saveAsTable(name)


def save_by_case(runs: DataFrame, cases: DataFrame, name: str, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Writes the tables ``<name>_runs`` and ``<name>_cases``; the stored runs and cases.

    Choose as many buckets as tasks should judge. Cases that are split are at most as
    many as buckets, so what is broadcast here does not grow with the tables. Runs
    without a case number match nothing and are dealt out over all buckets.
    """
    spark = runs.sparkSession
    counts = runs.groupBy("case_id").agg(F.count("*").alias("n"))
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // buckets)
    hot = F.broadcast(
        counts.filter((F.col("n") > share) & F.col("case_id").isNotNull())
        .select("case_id", F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    )
    dealt = F.pmod(F.xxhash64("result_id"), F.when(F.col("case_id").isNull(), buckets).otherwise(F.coalesce("_parts", F.lit(1))))
    placed = runs.select(*schemas.RUNS.names).join(hot, "case_id", "left").withColumn(PART, dealt.cast("int")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    wanted = cases.select(*schemas.CASES.names).join(hot, "case_id", "left").withColumn(PART, copies).drop("_parts")
    _write(placed, f"{name}_runs", f"{path}/runs", buckets)
    _write(wanted, f"{name}_cases", f"{path}/cases", buckets)
    return spark.table(f"{name}_runs"), spark.table(f"{name}_cases")
