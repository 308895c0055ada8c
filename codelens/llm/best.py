"""The first rows of each group, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1024


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int, part: str) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, numbered from 1 in ``rank``.

    ``part`` numbers the task a row comes from, which keeps ``k`` rows of a group
    at most. They are cut down within ``PARTS`` parts of each group first, so the
    last step sees ``PARTS * k`` rows of a group however many tasks there were.
    """
    number = F.row_number()
    parts = rows.withColumn(part, F.col(part) % PARTS)
    kept = parts.withColumn("rank", number.over(Window.partitionBy(*keys, part).orderBy(*order))).filter(F.col("rank") <= k)
    return kept.drop("rank", part).withColumn("rank", number.over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
