"""Judges generated code against evaluation cases and sums the results up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens import schemas
from codelens.functions import python_ast, text, vocab
from codelens.functions.rules import add, contains_any, ladder, literal, points
from codelens.operators.analysis import ANALYSIS, analyse
from codelens.operators.lines import add_line_facts

COUNTS = ("syntax_valid", "keyword_match", "execution_success")
PART = "case_part"  # of a case that stored tables split (``sources.bucketed``)


def add_quality(
    df: DataFrame, code: str = "generated_code", keywords: str = "expected_keywords"
) -> DataFrame:
    """Adds ``contains_keywords`` and ``estimated_quality``.

    Keywords match if any of them occurs, ignoring case, or if there are none.
    """
    own = set(df.columns)
    df = add_line_facts(df, code)
    df = add(df, _lower="lower(_code)")
    df = add(df, contains_keywords=(
        f"coalesce(size({keywords}), 0) <= 0"
        f" OR coalesce(exists({keywords}, word -> contains(_lower, lower(word))), false)"
    ))
    documented = (
        f"CASE WHEN {contains_any('_code', (chr(34) * 3, chr(39) * 3))} THEN 2"
        " WHEN contains(_code, '#') THEN 1 ELSE 0 END"
    )
    gained = documented + " + " + points([
        (contains_any("_code", ("def ", "class ")), 2),
        (contains_any("_code", ("try:", "except:")), 1),
        ("_n_nonblank >= 5", 1),
        ("_n_nonblank >= 15", 1),
        ("contains_keywords", 2),
    ])
    df = add(df, _points=gained)
    df = add(df, estimated_quality=(
        f"CASE WHEN _blank THEN {literal(vocab.LOWEST_QUALITY)}"
        f" ELSE {ladder('_points', vocab.QUALITY, vocab.LOWEST_QUALITY)} END"
    ))
    return df.drop(*[name for name in df.columns if name.startswith("_") and name not in own])


def _join_keys(runs: DataFrame, cases: DataFrame) -> list[str]:
    return ["case_id", PART] if PART in runs.columns and PART in cases.columns else ["case_id"]


def evaluate(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """One judged row per run whose case exists; ``unmatched`` has the others.

    A run whose generation failed, or whose code the parser gave up on for
    another reason than a syntax error, counts as failed throughout. What a run
    printed or raised is only kept for code that parses.

    No join hint is given here: Spark broadcasts cases it knows to be small, as
    the built-in ones, and otherwise splits the skewed keys of a shuffled join.
    Tables stored by case (``sources.bucketed``) join in place.
    """
    keys = _join_keys(runs, cases)
    wanted = cases.select(*keys, "category", "instruction", "difficulty", "expected_keywords")
    asked = runs.select(*schemas.RUNS.names, *keys[1:]).join(wanted, keys)
    judged = add_quality(analyse(asked))
    status = F.col(f"{ANALYSIS}.status")
    problem = F.coalesce(
        F.col("generation_error"), F.when(status == python_ast.OTHER, F.col(f"{ANALYSIS}.error"))
    )
    judged = judged.withColumns({
        "_failed": problem.isNotNull(),
        "_parsed": problem.isNull() & (status == python_ast.OK),
        "notes": F.coalesce(F.concat(F.lit(vocab.FAILED_NOTE), problem), F.lit("")),
    })

    def unless_failed(value: Column, default) -> Column:
        return F.when(F.col("_failed"), F.lit(default)).otherwise(value)

    def if_parsed(value: Column, default) -> Column:
        return F.when(F.col("_parsed"), F.coalesce(value, F.lit(default))).otherwise(F.lit(default))

    return judged.select(
        "result_id",
        "case_id",
        "category",
        "instruction",
        "difficulty",
        unless_failed(text.or_empty(F.col("generated_code")), "").alias("generated_code"),
        "execution_time",
        F.col("_parsed").alias("syntax_valid"),
        unless_failed(F.col("contains_keywords"), False).alias("contains_keywords"),
        unless_failed(F.col("estimated_quality"), vocab.LOWEST_QUALITY).alias("estimated_quality"),
        if_parsed(F.col("execution_success"), False).alias("execution_success"),
        if_parsed(F.col("execution_output"), "").alias("execution_output"),
        if_parsed(F.col("execution_error"), "").alias("execution_error"),
        "notes",
    )


def unmatched(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs that cannot be judged, with the reason."""
    reason = F.when(F.col("case_id").isNull(), "no case number").otherwise("unknown case")
    keys = _join_keys(runs, cases)
    rest = runs.select("result_id", *keys).join(cases.select(*keys), keys, "left_anti")
    return rest.select("result_id", "case_id", reason.alias("reason"))


def details(judged: DataFrame) -> DataFrame:
    return judged.select(
        "result_id", "category", "instruction", "difficulty", "syntax_valid", "contains_keywords",
        "estimated_quality", "execution_time", F.length("generated_code").alias("code_length"), "notes",
    )


def report_cells(judged: DataFrame) -> DataFrame:
    """Counts per (category, quality): a small table all summaries add up from."""
    return judged.groupBy("category", "estimated_quality").agg(
        F.count("*").alias("total"),
        F.count_if("syntax_valid").alias("syntax_valid"),
        F.count_if("contains_keywords").alias("keyword_match"),
        F.count_if("execution_success").alias("execution_success"),
        F.count("execution_time").alias("timed"),
        F.sum("execution_time").alias("total_time"),
    )


def _add_up(cells, *more: Column) -> DataFrame:
    return cells.agg(
        *[F.sum(name).alias(name) for name in ("total", *COUNTS)],
        F.try_divide(F.sum("total_time"), F.sum("timed")).alias("avg_time"),
        *more,
    )


def _rate(count: str) -> Column:
    return F.col(count) / F.col("total") * F.lit(100.0)


def summary(cells: DataFrame) -> DataFrame:
    """One row of totals and rates; no row if nothing was judged."""
    return _add_up(cells).filter(F.col("total") > 0).select(
        F.col("total").alias("total_tests"),
        *[column for name in COUNTS for column in (F.col(name), _rate(name).alias(f"{name}_rate"))],
        F.col("avg_time").alias("avg_execution_time"),
    )


def category_statistics(cells: DataFrame) -> DataFrame:
    return _add_up(cells.groupBy("category"))


def category_rates(statistics: DataFrame) -> DataFrame:
    return statistics.select(
        "category",
        _rate("syntax_valid").alias("syntax_rate"),
        _rate("keyword_match").alias("keyword_rate"),
        "avg_time",
    )


def quality_distribution(cells: DataFrame) -> DataFrame:
    return cells.groupBy("estimated_quality").agg(F.sum("total").alias("n_rows"))


def expectation_check(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """How many rows turned out as expected."""
    met = F.coalesce(F.col(actual) == F.col(expected), F.lit(False))
    return df.agg(F.count_if(met).alias("passed"), F.count("*").alias("total")).withColumn(
        "all_passed", F.col("passed") == F.col("total")
    )
