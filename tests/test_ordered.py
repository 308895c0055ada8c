from __future__ import annotations

import random

import pytest

from codelens.functions import vocab
from codelens.operators import ordered


def trend_after(totals):
    if len(totals) < 10:
        return "insufficient_data"
    older, recent = sum(totals[-10:-5]) / 5, sum(totals[-5:]) / 5
    return "improving" if recent > older + 5 else "declining" if recent < older - 5 else "stable"


def entries(rows, k):
    best, out = [], []
    for seq, total in rows:
        best = sorted([*best, (total, seq)], key=lambda row: (-row[0], row[1]))[:k]
        if (total, seq) in best:
            out.append((seq, total, best.index((total, seq)) + 1))
    return out


@pytest.fixture(params=[1, 9])
def ranges(spark, request):
    """More ranges than rows would fill, too."""
    before = [spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("n", [0, 3, 60, 300])
def test_each_row_as_it_was_when_it_came(spark, ranges, n):
    pick = random.Random(n)
    rows = [(3 * at, float(pick.choice([40, 50, 60, at / 4, pick.random() * 100]))) for at in range(n)]
    frame = spark.createDataFrame(pick.sample(rows, n), "seq long, total_score double").repartition(5)
    trends = {row["seq"]: row["recent_trend"] for row in ordered.trend_history(frame).collect()}
    assert trends == {seq: trend_after([total for _, total in rows[: at + 1]]) for at, (seq, _) in enumerate(rows)}
    for k in (1, vocab.TOP_SCORES):
        assert sorted(map(tuple, ordered.high_score_entries(frame, k).collect())) == entries(rows, k)


def test_no_window_without_partitions(spark):
    frame = spark.range(50).selectExpr("id AS seq", "cast(id % 9 AS double) AS total_score")
    for result in (ordered.trend_history(frame), ordered.high_score_entries(frame)):
        plan = result._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan


def test_rows_are_scored_once(spark):
    """Ranges are found by a sample, which must not score again."""
    seen = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for view in (ordered.trend_history, ordered.high_score_entries):
        seen.value = 0
        rows = spark.range(500).selectExpr("id as seq", "cast(id as double) as total_score").repartition(5)
        assert view(rows.mapInArrow(score, "seq long, total_score double")).count() == 500
        assert seen.value == 500
