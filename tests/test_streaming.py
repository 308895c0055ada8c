from __future__ import annotations

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from codelens import schemas
from codelens.operators import board, scoring, stats
from codelens.plans import jobs, layout
from codelens.plans.layout import shared_folder
from codelens.sources import history
from codelens.streaming import live

CODES = [
    "def add(first, second):\n    return first + second", "x = = 1", "", "import os", "class Thing:\n    pass",
    '"""Doc."""\nvalue = [item for item in values]',
]


def submissions(spark, low, high):
    rows = [
        (n, "write a function and a class", CODES[n % len(CODES)], ["web", "data", "mystery", " "][n % 4],
         f"2024-01-01T00:00:{n % 60:02d}")
        for n in range(low, high)
    ]
    return spark.createDataFrame(rows, schemas.SUBMISSIONS)


def arrive(spark, base, low, high):
    submissions(spark, low, high).coalesce(1).write.mode("append").parquet(f"{base}/in")


def advance(spark, base):
    """Runs all streams over what has arrived since the last call."""
    live.score_stream(spark, f"{base}/in", f"{base}/history", f"{base}/c1", True, 1, tasks=2).awaitTermination()
    follow(spark, base)


def follow(spark, base):
    live.statistics_stream(spark, f"{base}/history", f"{base}/cells", f"{base}/c2", True).awaitTermination()
    live.top_stream(spark, f"{base}/history", f"{base}/top", f"{base}/c3", available_now=True).awaitTermination()
    live.trend_stream(spark, f"{base}/history", f"{base}/trend", f"{base}/c4", available_now=True).awaitTermination()


def test_streams_equal_the_batch_and_continue_after_a_restart(spark):
    base = shared_folder(spark, "stream")
    for part in range(2):
        arrive(spark, base, part * 20, part * 20 + 20)
    advance(spark, base)
    arrive(spark, base, 40, 75)
    advance(spark, base)

    kept = submissions(spark, 0, 75).filter("trim(generated_code) != ''").replace(" ", "general", ["category"])
    expected = scoring.score_rows(kept).cache()
    stored = history.read_history(spark, f"{base}/history")
    assert sorted(stored.collect()) == sorted(expected.collect())

    running, whole = live.running_cells(spark, f"{base}/cells"), stats.score_cells(expected)
    assert sorted(running.collect()) == sorted(whole.collect())
    assert stats.overall(running).collect() == stats.overall(whole).collect()
    assert {row["category"] for row in running.collect()} == {"web", "data", "general", ""}

    top = board.top_scores(live.running_top(spark, f"{base}/top")).collect()
    assert top == board.top_scores(expected.select(*live.BOARD.names)).collect()
    assert live.running_trend(spark, f"{base}/trend").collect() == board.recent_trend(expected).collect()


def test_a_replayed_batch_changes_nothing(spark):
    """Without its commit mark, the last batch of each query runs once more."""
    base = shared_folder(spark, "replay")
    arrive(spark, base, 0, 30)
    advance(spark, base)
    arrive(spark, base, 30, 60)
    arrive(spark, base, 60, 80)
    advance(spark, base)

    def state():
        return [
            sorted(live.running_top(spark, f"{base}/top").collect()),
            sorted(live.running_cells(spark, f"{base}/cells").collect()),
            sorted(live.latest_snapshot(spark, f"{base}/trend", live.TREND).collect()),
            sorted(history.read_history(spark, f"{base}/history").collect()),
        ]

    before = state()
    for name in ("c1", "c2", "c3", "c4"):
        marks = [path for path in Path(f"{base}/{name}/commits").iterdir() if path.name.isdigit()]
        assert len(marks) > 1
        last = max(marks, key=lambda path: int(path.name))
        last.unlink()
        last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    advance(spark, base)
    assert state() == before


def test_one_history_for_batch_and_stream_in_either_order(spark):
    for order in ("batch stream", "stream batch"):
        base = shared_folder(spark, "mixed")
        arrive(spark, base, 0, 30)
        scored = jobs.score_submissions(submissions(spark, 30, 60))
        for step in order.split():
            if step == "batch":
                for _ in range(2):  # a job that is run again adds nothing
                    history.append_history(scored.history, f"{base}/history", "job-1")
                    history.append_refused(scored.refused, f"{base}/history", "job-1")
            else:
                advance(spark, base)
        advance(spark, base)
        expected = jobs.score_submissions(submissions(spark, 0, 60))
        stored = history.read_history(spark, f"{base}/history")
        assert sorted(stored.collect()) == sorted(expected.history.collect())
        refused = history.read_refused(spark, f"{base}/history")
        assert sorted(refused.collect()) == sorted(expected.refused.select(*refused.columns).collect())
        assert sorted(live.running_cells(spark, f"{base}/cells").collect()) == sorted(stats.score_cells(expected.history).collect())


def test_fifty_batches_leave_a_few_snapshots(spark):
    base = shared_folder(spark, "long")
    scored = jobs.score_submissions(submissions(spark, 0, 50)).history.coalesce(1).cache()
    for n in range(50):
        history.append_history(scored.filter(f"seq = {n}"), f"{base}/history", f"job-{n}")
        if n % 8 == 7:
            live.statistics_stream(spark, f"{base}/history", f"{base}/cells", f"{base}/state", True).awaitTermination()
    live.statistics_stream(spark, f"{base}/history", f"{base}/cells", f"{base}/state", True).awaitTermination()
    assert len(list(Path(f"{base}/cells").glob("batch_id=*"))) <= live.SNAPSHOTS_KEPT
    assert sorted(live.running_cells(spark, f"{base}/cells").collect()) == sorted(stats.score_cells(scored).collect())


def test_snapshots_of_nothing(spark):
    path = shared_folder(spark, "nothing")
    assert live.running_top(spark, path).collect() == []
    assert live.latest_snapshot(spark, path, live.BOARD, before=3).collect() == []


def test_files_of_any_age_are_seen(spark):
    base = shared_folder(spark, "aged")
    for part in range(3):
        arrive(spark, base, part * 10, part * 10 + 10)
        for file in Path(f"{base}/in").glob("*.parquet"):
            if file.stat().st_mtime > time.time() - 3600:
                os.utime(file, (time.time() - part * 9 * 86400 - 7200,) * 2)
        advance(spark, base)
    expected = jobs.score_submissions(submissions(spark, 0, 30)).history
    assert history.read_history(spark, f"{base}/history").count() == expected.count()
    for file in Path(f"{base}/history").rglob("*"):  # and so are runs
        os.utime(file, (time.time() - 40 * 86400,) * 2)
    live.statistics_stream(spark, f"{base}/history", f"{base}/again", f"{base}/c9", True).awaitTermination()
    assert sorted(live.running_cells(spark, f"{base}/again").collect()) == sorted(stats.score_cells(expected).collect())


def equal_cells(one, other):
    """Sums can differ in what the order of adding leaves."""
    rows = [sorted(cells.withColumn("sum_score", F.round("sum_score", 6)).filter("n_rows > 0").collect()) for cells in (one, other)]
    return rows[0] == rows[1]


def test_corrections_reach_running_views(spark):
    base = shared_folder(spark, "corrected")
    path = f"{base}/history"
    scored = jobs.score_submissions(submissions(spark, 0, 60)).history.cache()
    wrong = scored.withColumn("total_score", F.when(F.col("seq") % 4 == 0, 300.0 + F.col("seq")).otherwise(F.col("total_score")))
    wrong = wrong.withColumn("grade", F.when(F.col("seq") % 4 == 0, "A+").otherwise(F.col("grade")))
    history.append_history(wrong.filter("seq < 40"), path, "one")
    follow(spark, base)
    history.append_history(wrong.filter("seq >= 40"), path, "two")
    history.correct_history(scored.filter("seq % 4 = 0 AND seq < 20"), path, "three")
    follow(spark, base)
    history.run_log(spark, path).compact()
    history.run_log(spark, path).clean(hours=0)
    follow(spark, base)
    history.correct_history(scored.filter("seq % 4 = 0"), path, "four")
    history.run_log(spark, path).compact()
    follow(spark, base)
    assert sorted(history.read_history(spark, path).collect()) == sorted(scored.collect())
    assert equal_cells(live.running_cells(spark, f"{base}/cells"), stats.score_cells(scored))
    assert board.top_scores(live.running_top(spark, f"{base}/top")).collect() == board.top_scores(scored.select(*live.BOARD.names)).collect()
    assert live.running_trend(spark, f"{base}/trend").collect() == board.recent_trend(scored).collect()
    # Earlier versions can still be read: after the first run, and before the last correction.
    assert sorted(history.read_history(spark, path, 1).collect()) == sorted(wrong.filter("seq < 40").collect())
    third = scored.filter("seq % 4 != 0 OR seq < 20").union(wrong.filter("seq % 4 = 0 AND seq >= 20"))
    assert sorted(history.read_history(spark, path, 3).collect()) == sorted(third.collect())


def test_a_large_micro_batch_is_scored_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 10)
    base = shared_folder(spark, "large")
    rows = spark.range(200).selectExpr("id as seq", "'say' as instruction", "concat('x = ', id) as generated_code", "'general' as category", "'t' as timestamp")
    rows.select(*schemas.SUBMISSIONS.names).coalesce(1).write.parquet(f"{base}/arriving")
    live.score_stream(spark, f"{base}/arriving", f"{base}/history", f"{base}/state", available_now=True, tasks=2).awaitTermination()
    log = history.run_log(spark, f"{base}/history")
    assert log.rows().count() == 200 and len(log.state()[1][0]["files"]) > 10
