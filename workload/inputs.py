"""Derived inputs as Spark DataFrames.

``submissions`` turns every order into a submitted code row, ``runs`` into an
evaluated one, ``pairs`` every answered user turn into an instruction row, and
``prose`` takes every document's whole text as if it were code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens import schemas
from codelens.plans.layout import spread
from codelens.sources import tables
from workload.templates import (
    CATEGORIES,
    FREE_CASE,
    GENERATION_ERROR,
    INSTRUCTIONS,
    N_CASE_NUMBERS,
    OUTCOMES,
    TEMPLATES,
)

BLOCK = 1000  # turns of one conversation that are put in order together


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(number: Column, texts) -> Column:
    """The text with that number."""
    return F.element_at(F.array(*[F.lit(text) for text in texts]), (number + 1).cast("int"))


def _filled(text: Column) -> Column:
    return F.replace(text, F.lit("@a@"), F.col("o_custkey").cast("string"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """One code row per order: seq, template, category, instruction, code, time.

    The narrow order columns are spread over all cores before the code text is
    made out of them.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = spread(orders, "o_orderkey")
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey"),
        (F.col("o_orderkey") % len(TEMPLATES)).alias("template"),
        _pick(F.expr("o_orderkey div 16") % len(CATEGORIES), CATEGORIES).alias("category"),
        _pick(F.expr("o_orderkey div 128") % len(INSTRUCTIONS), INSTRUCTIONS).alias("instruction"),
        _filled(_pick(F.col("o_orderkey") % len(TEMPLATES), [t.code for t in TEMPLATES])).alias("generated_code"),
        F.replace(F.col("o_orderdate").cast("string"), F.lit(" "), F.lit("T")).alias("timestamp"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluated code row per order, with a recorded execution outcome."""
    block = F.expr("seq div 16")
    outcomes = [
        F.struct(
            F.lit(success).alias("success"), F.lit(output).alias("output"),
            F.lit(error).alias("error"), F.lit(code).cast("int").alias("code"),
        )
        for success, output, error, code in OUTCOMES.values()
    ]
    rows = submissions(spark, folder).withColumn(
        "picked", F.element_at(F.array(*outcomes), (block % len(OUTCOMES) + 1).cast("int"))
    )
    return rows.select(
        F.col("seq").alias("result_id"),
        (block % N_CASE_NUMBERS).alias("case_id"),
        "generated_code",
        F.when(F.col("seq") % 50 != 49, (F.col("seq") % 100) / F.lit(8.0)).alias("execution_time"),
        F.col("picked.success").alias("execution_success"),
        _filled(F.col("picked.output")).alias("execution_output"),
        _filled(F.col("picked.error")).alias("execution_error"),
        F.col("picked.code").alias("exit_code"),
        F.when(block % 11 == 10, GENERATION_ERROR).alias("generation_error"),
    )


def cases(spark: SparkSession) -> DataFrame:
    """The built-in cases and one that asks for no keyword."""
    return tables.builtin_cases(spark).unionByName(spark.createDataFrame([FREE_CASE], schemas.CASES))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction rows: a user turn, the system turn before, the answer after.

    Turns of a conversation are dealt out in blocks, and a block's first and last
    turn go to the neighbouring block too, so a window over one block sees every
    neighbour. That is one scan and one shuffle, and a conversation of any length
    spreads over all tasks. The key leaves room for the longest conversation.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    longest = turns.agg(F.max("turn")).first()[0] or 0
    own = F.expr(f"turn div {BLOCK}")
    neighbours = F.array_compact(F.array(
        own,
        F.when(F.col("turn") % BLOCK == 0, own - 1),
        F.when(F.col("turn") % BLOCK == BLOCK - 1, own + 1),
    ))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn")
    row = F.struct("turn", "role", "text")
    seen = turns.withColumn("block", F.explode(neighbours)).select(
        "*", F.lead(row).over(in_block).alias("after"), F.lag(row).over(in_block).alias("before")
    )
    answered = (F.col("after.turn") == F.col("turn") + 1) & (F.col("after.role") == "assistant")
    led = (F.col("before.turn") == F.col("turn") - 1) & (F.col("before.role") == "system")
    return seen.filter((F.col("role") == "user") & (F.col("block") == own) & answered).select(
        (F.col("conv_id") * (longest + 1) + F.col("turn")).alias("row_id"),
        F.col("text").alias("instruction"),
        F.when(led, F.col("before.text")).otherwise("").alias("input"),
        F.col("after.text").alias("output"),
    )


def prose(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's whole text as code, most with comments, quotes or indents added."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    text, kind = F.col("text"), F.col("doc_id") % 6
    indented = F.replace(text, F.lit("\n"), F.lit("\n  "))
    code = (
        F.when(kind == 1, F.concat(F.lit("# "), text))
        .when(kind == 2, F.concat(F.lit('"""'), text, F.lit('"""')))
        .when(kind == 3, F.replace(text, F.lit("\n"), F.lit("\n    ")))
        .when(kind == 4, F.concat(F.lit("note: text -> "), text))
        .when(kind == 5, F.replace(indented, F.lit(". "), F.lit(".\n    # ")))
        .otherwise(text)
    )
    return documents.select("doc_id", code.alias("generated_code"), F.lit("").alias("instruction"))
