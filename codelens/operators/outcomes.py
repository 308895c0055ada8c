"""Classes of code-execution outcomes, read off their recorded fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import text, vocab

_EXCEPTION = r"^([A-Za-z_][A-Za-z0-9_]*): "


def outcome_class(success: Column, error: Column, exit_code: Column) -> Column:
    """The outcome class.

    A non-zero exit code is looked at before the error text, which then is
    whatever the program itself printed.
    """
    error = text.or_empty(error)
    return (
        F.when(success, "success")
        .when(F.coalesce(exit_code, F.lit(0)) != 0, "nonzero_exit")
        .when(F.startswith(error, F.lit(vocab.TIMEOUT_PREFIX)), "timeout")
        .when(F.startswith(error, F.lit(vocab.SECURITY_PREFIX)), "security_violation")
        .when(F.startswith(error, F.lit(vocab.SANDBOX_PREFIX)), "sandbox_error")
        .when(F.startswith(error, F.lit(vocab.SUBPROCESS_PREFIX)), "subprocess_error")
        .when(F.rlike(error, F.lit(_EXCEPTION)), "exception")
        .otherwise("unknown")
    )


def classify(runs: DataFrame) -> DataFrame:
    """Adds ``outcome`` and, for exceptions, ``exception_name``."""
    named = runs.withColumn(
        "outcome",
        outcome_class(F.col("execution_success"), F.col("execution_error"), F.col("exit_code")),
    )
    return named.withColumn(
        "exception_name",
        F.when(F.col("outcome") == "exception", F.regexp_extract("execution_error", _EXCEPTION, 1)),
    )
