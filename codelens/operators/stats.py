"""Score statistics, all added up from one small table of cells.

A cell holds count, sum, best and worst total of one (category, grade). Cells of
parts of the data can be merged, so the batch statistics and the running ones of
the stream share every step after the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import text, vocab

# All categories outside the dictionary share one cell row per grade: they count
# in the overall and grade figures only, and the cells stay few.
OTHER_CATEGORIES = ""


def known_category(category: Column) -> Column:
    return category.isin(*vocab.CATEGORIES)


def cell_category(category: Column) -> Column:
    return F.when(known_category(category), category).otherwise(OTHER_CATEGORIES)


def score_cells(scored: DataFrame) -> DataFrame:
    """At most 96 rows: 8 category cells times 12 grades."""
    return scored.groupBy(cell_category(F.col("category")).alias("category"), "grade").agg(
        F.count("*").alias("n_rows"),
        F.sum("total_score").alias("sum_score"),
        F.max("total_score").alias("best_score"),
        F.min("total_score").alias("worst_score"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of several parts of the data as cells of them all."""
    return cells.groupBy("category", "grade").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("sum_score").alias("sum_score"),
        F.max("best_score").alias("best_score"),
        F.min("worst_score").alias("worst_score"),
    )


def overall(cells: DataFrame) -> DataFrame:
    """One row of count, mean, best and worst; no row without submissions."""
    return cells.agg(
        F.sum("n_rows").alias("total_submissions"),
        (F.sum("sum_score") / F.sum("n_rows")).alias("average_score"),
        F.max("best_score").alias("highest_score"),
        F.min("worst_score").alias("lowest_score"),
    ).filter(F.col("total_submissions") > 0)


def grade_distribution(cells: DataFrame) -> DataFrame:
    """Rows per grade that occurs, in text order of the grade."""
    return cells.groupBy("grade").agg(F.sum("n_rows").alias("n_rows")).orderBy("grade")


def category_performance(cells: DataFrame) -> DataFrame:
    """Count, mean and best of every known category that occurs."""
    return cells.filter(known_category(F.col("category"))).groupBy("category").agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("sum_score") / F.sum("n_rows")).alias("average"),
        F.max("best_score").alias("best"),
    )


def _shown(score: Column) -> Column:
    """One decimal, after removing what the order of a float sum left behind."""
    return text.one_decimal(F.round(score, 9))


def overall_view(cells: DataFrame, trend: DataFrame) -> DataFrame:
    """The overall figures as shown to a reader. A trend of several rows is an error."""
    figures = overall(cells).select(
        "total_submissions",
        _shown(F.col("average_score")).alias("average"),
        _shown(F.col("highest_score")).alias("highest"),
    )
    words = F.replace(F.col("recent_trend"), F.lit("_"), F.lit(" "))
    return figures.withColumn("trend", trend.select(text.title(words)).scalar())


def category_view(cells: DataFrame, categories: DataFrame) -> DataFrame:
    """Shown figures per category, in the order of the category table."""
    return (
        category_performance(cells)
        .join(categories, "category")
        .orderBy("position")
        .select(
            "position",
            text.title(F.col("category")).alias("name"),
            _shown(F.col("average")).alias("average"),
            "n_rows",
        )
    )
