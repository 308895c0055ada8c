"""Schemas of every table the library reads or writes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_STRINGS = ArrayType(StringType(), containsNull=False)

INSTRUCTIONS = StructType([
    StructField("row_id", LongType()),
    StructField("instruction", StringType()),
    StructField("input", StringType()),
    StructField("output", StringType()),
])

SUBMISSIONS = StructType([
    StructField("seq", LongType()),
    StructField("instruction", StringType()),
    StructField("generated_code", StringType()),
    StructField("category", StringType()),
    StructField("timestamp", StringType()),
])

# One scored submission, without the key and the typed time we add.
SCORE = StructType([
    StructField("instruction", StringType()),
    StructField("generated_code", StringType()),
    StructField("timestamp", StringType()),
    StructField("syntax_score", DoubleType()),
    StructField("functionality_score", DoubleType()),
    StructField("style_score", DoubleType()),
    StructField("efficiency_score", DoubleType()),
    StructField("documentation_score", DoubleType()),
    StructField("total_score", DoubleType()),
    StructField("grade", StringType()),
    StructField("syntax_errors", _STRINGS),
    StructField("style_issues", _STRINGS),
    StructField("positive_features", _STRINGS),
    StructField("suggestions", _STRINGS),
    StructField("code_length", IntegerType()),
    StructField("complexity_estimate", StringType()),
    StructField("category", StringType()),
])

HISTORY = StructType(
    [StructField("seq", LongType())] + SCORE.fields + [StructField("scored_at", TimestampType())]
)

# Submissions that were not scored, and why.
REFUSED = StructType(SUBMISSIONS.fields + [StructField("reason", StringType())])

# The single-object history file: two lists and a time.
HISTORY_FILE = StructType([
    StructField("scores_history", ArrayType(SCORE)),
    StructField("high_scores", ArrayType(SCORE)),
    StructField("timestamp", StringType()),
])

CASES = StructType([
    StructField("case_id", LongType()),
    StructField("category", StringType()),
    StructField("instruction", StringType()),
    StructField("input_text", StringType()),
    StructField("expected_keywords", ArrayType(StringType())),
    StructField("difficulty", StringType()),
    StructField("description", StringType()),
])

CATEGORY_TABLE = StructType([
    StructField("position", IntegerType()),
    StructField("category", StringType()),
    StructField("title", StringType()),
])

# What a model run and a code run left behind for one evaluation case.
RUNS = StructType([
    StructField("result_id", LongType()),
    StructField("case_id", LongType()),
    StructField("generated_code", StringType()),
    StructField("execution_time", DoubleType()),
    StructField("execution_success", BooleanType()),
    StructField("execution_output", StringType()),
    StructField("execution_error", StringType()),
    StructField("exit_code", IntegerType()),
    StructField("generation_error", StringType()),
])
