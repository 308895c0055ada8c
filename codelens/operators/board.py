"""High scores, the leaderboard view and the recent trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import text, vocab


def _best_first() -> list[Column]:
    """Highest total first; among equal totals the earlier row."""
    return [F.desc("total_score"), F.asc("seq")]


def top_scores(scored: DataFrame, k: int = vocab.TOP_SCORES) -> DataFrame:
    """The ``k`` best rows. Every task keeps k rows, one task merges those.

    Give it only the columns you need: they travel with the kept rows.
    """
    return scored.orderBy(*_best_first()).limit(k)


def top_stored_scores(history: DataFrame, k: int = vocab.TOP_SCORES) -> DataFrame:
    """The ``k`` best rows of a stored history, with all their columns.

    Ranks (seq, total_score) first, so that no code text is sorted or moved.
    The k-th row then bounds a filter that the scan uses to skip row groups.
    The ranking runs at once; the k-th pair of numbers reaches the driver.
    """
    ranked = top_scores(history.select("seq", "total_score"), k)
    worst = ranked.agg(F.min(F.struct("total_score", (-F.col("seq")).alias("back"))).alias("last")).first()["last"]
    if worst is None:
        return history.limit(0)
    total, seq = F.col("total_score"), F.col("seq")
    kept = (total > worst["total_score"]) | ((total == worst["total_score"]) & (seq <= -worst["back"]))
    return top_scores(history.filter(kept), k)


def high_scores(
    scored: DataFrame, category: str | None = None, limit: int = vocab.TOP_SCORES
) -> DataFrame:
    """The first ``limit`` of the ten best rows, optionally of one category.

    The category is looked up within the overall ten, so a category can have
    fewer rows here than it has submissions, or none.
    """
    best = top_scores(scored)
    if category:
        best = best.filter(F.col("category") == category)
    return best.orderBy(*_best_first()).limit(limit)


def leaderboard_view(
    scored: DataFrame, width: int = 50, limit: int = vocab.TOP_SCORES
) -> DataFrame:
    """Display columns of the best rows with their positions.

    The numbering window has no partition; it sees at most ten rows.
    """
    needed = scored.select("seq", "instruction", "timestamp", "category", "grade", "total_score")
    best = high_scores(needed, limit=limit)
    return best.select(
        F.row_number().over(Window.orderBy(*_best_first())).alias("position"),
        "grade",
        text.one_decimal(F.col("total_score")).alias("score"),
        text.title(F.col("category")).alias("category"),
        text.cut(F.col("instruction"), width).alias("instruction"),
        F.substring("timestamp", 1, 10).alias("date"),
    )


def trend_rows(scored: DataFrame) -> DataFrame:
    """The rows that the trend is made of: the last ten totals."""
    return scored.select("seq", "total_score").orderBy(F.desc("seq")).limit(2 * vocab.TREND_ROWS)


def recent_trend(scored: DataFrame) -> DataFrame:
    """One row: how the last five totals compare with the five before them."""
    last = trend_rows(scored)
    # At most ten rows are collected here, put in order so that sums are exact
    # repeats of adding them one after the other.
    ordered = last.agg(F.array_sort(F.collect_list(F.struct("seq", "total_score"))).alias("rows"))
    totals = ordered.select(F.transform("rows", lambda row: row["total_score"]).alias("totals"))
    return totals.select(trend_name(F.col("totals")).alias("recent_trend"))


def trend_name(totals: Column) -> Column:
    """The trend of a list of the last ten totals, the oldest first."""
    n = vocab.TREND_ROWS

    def mean(start: int) -> Column:
        part = F.slice(totals, start, n)
        return F.aggregate(part, F.lit(0.0), lambda total, value: total + value) / F.lit(float(n))

    older, recent = mean(1), mean(n + 1)
    unknown, better, worse, same = vocab.TREND_NAMES
    return (
        F.when(F.size(totals) < 2 * n, unknown)
        .when(recent > older + F.lit(vocab.TREND_STEP), better)
        .when(recent < older - F.lit(vocab.TREND_STEP), worse)
        .otherwise(same)
    )
