"""The three batch jobs: prepare training rows, score submissions, evaluate runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.operators import evaluation, prompts, rows, scoring, stats
from codelens.plans.layout import broadcast_if_small, settle


def prepare_training_rows(
    instructions: DataFrame, max_samples: int | None = None, max_tokens: int = 1024
) -> DataFrame:
    """Sampled, formatted and length-capped training rows."""
    sample = rows.first_rows(instructions, max_samples)
    return prompts.limit_length(prompts.format_rows(sample), max_tokens)


@dataclass(frozen=True)
class Scored:
    history: DataFrame
    refused: DataFrame


def score_submissions(submissions: DataFrame) -> Scored:
    """History rows of all submissions with code, and the refused rest.

    Rows without code are refused before the parser sees them. There is no
    shuffle; ``layout.spread`` the scan first if it has few splits.
    """
    named = submissions.withColumn("category", rows.category_or_default(submissions["category"]))
    kept, refused = rows.split_blank(named, "generated_code")
    return Scored(scoring.score_rows(kept), refused)


def performance_by_category(submissions: DataFrame) -> DataFrame:
    """Count, mean and best of every known category; other rows are not parsed."""
    named = submissions.withColumn("category", rows.category_or_default(submissions["category"]))
    known = named.filter(stats.known_category(F.col("category")))
    return stats.category_performance(stats.score_cells(scoring.add_scores(known)))


def evaluate_runs(runs: DataFrame, cases: DataFrame, path: str) -> dict[str, DataFrame]:
    """Judges all runs once into a Parquet table at ``path`` and reports on it.

    Every part of the report reads the stored rows, and only the columns it
    needs, so nothing is parsed twice and a lost executor costs no judging. A
    fifth part lists the runs that no case belongs to.
    """
    cases = broadcast_if_small(cases)
    judged = evaluation.evaluate(runs, cases)
    judged.write.mode("errorifexists").parquet(path)
    report = evaluation_report(judged.sparkSession.read.schema(judged.schema).parquet(path))
    return report | {"unmatched": evaluation.unmatched(runs, cases)}


def evaluation_report(judged: DataFrame) -> dict[str, DataFrame]:
    """The four parts of a report on stored rows; the summaries share one pass."""
    cells = settle(evaluation.report_cells(judged))
    return {
        "summary": evaluation.summary(cells),
        "quality_distribution": evaluation.quality_distribution(cells),
        "category_statistics": evaluation.category_statistics(cells),
        "detailed_results": evaluation.details(judged),
    }
