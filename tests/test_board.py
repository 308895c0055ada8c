from __future__ import annotations

import random

import pytest

from codelens import schemas
from codelens.operators import board, rows, scoring, stats
from codelens.plans.layout import shared_folder
from codelens.sources import history, tables


def totals(spark, values, categories=None):
    rows = [
        (at, float(value), (categories or ["web"])[at % len(categories or ["web"])], "A", f"task {at}", "2024-01-02T03")
        for at, value in enumerate(values)
    ]
    schema = "seq long, total_score double, category string, grade string, instruction string, timestamp string"
    return spark.createDataFrame(rows, schema).repartition(4)


def one_by_one(values, k=10):
    """The list a single process keeps: append, stable sort, cut."""
    best = []
    for row in values:
        best.append(row)
        best.sort(key=lambda r: r[1], reverse=True)
        best = best[:k]
    return best


def test_ties_keep_the_earlier_row(spark):
    pick = random.Random(1)
    values = [pick.choice([50, 60, 70]) for _ in range(300)]
    expected = [at for at, _ in one_by_one(list(enumerate(values)))]
    assert [row["seq"] for row in board.top_scores(totals(spark, values)).collect()] == expected


def test_category_is_looked_up_within_the_ten(spark):
    frame = totals(spark, list(range(100)), ["web", "data"])
    assert [r["seq"] for r in board.high_scores(frame, "web").collect()] == [98, 96, 94, 92, 90]
    assert [r["seq"] for r in board.high_scores(frame, "web", 2).collect()] == [98, 96]
    assert board.high_scores(frame, "advanced").collect() == []
    assert len(board.high_scores(frame, "").collect()) == 10


def test_leaderboard_view(spark):
    frame = totals(spark, [72.25, 90.0, 72.35], ["web", "machine_learning", "data"])
    shown = board.leaderboard_view(frame, width=4, limit=2).collect()
    assert [tuple(row) for row in shown] == [
        (1, "A", 90.0, "Machine_Learning", "task...", "2024-01-02"),
        (2, "A", 72.3, "Data", "task...", "2024-01-02"),
    ]


@pytest.mark.parametrize("values, expected", [
    ([], "insufficient_data"), ([50] * 9, "insufficient_data"), ([50] * 10, "stable"),
    ([50] * 5 + [55] * 5, "stable"), ([50] * 5 + [55.25] * 5, "improving"),
    ([55] * 5 + [50] * 5, "stable"), ([55.25] * 5 + [50] * 5, "declining"),
    ([0] * 50 + [50] * 5 + [56] * 5, "improving"),
])
def test_trend(spark, values, expected):
    assert [row[0] for row in board.recent_trend(totals(spark, values)).collect()] == [expected]


def test_trend_of_the_last_submissions_alone(spark):
    codes = ["x = ="] * 40 + ["def add(first, second):\n    return first + second"] * 5
    frame = spark.createDataFrame(
        [(at, "add", code, "web", None) for at, code in enumerate(codes)], schemas.SUBMISSIONS
    ).repartition(3)
    every = board.recent_trend(scoring.add_scores(frame)).collect()
    last = board.recent_trend(scoring.add_scores(rows.last_rows(frame, 10))).collect()
    assert every == last == [("improving",)]


def test_statistics_with_a_hot_and_an_unknown_category(spark):
    categories = ["web"] * 6 + ["data", "mystery", None]
    values = [n % 101 for n in range(900)]
    cells = stats.score_cells(totals(spark, values, categories))
    overall = stats.overall(cells).first()
    assert overall["total_submissions"] == 900 and overall["highest_score"] == 100.0
    assert overall["lowest_score"] == 0.0 and overall["average_score"] == sum(values) / 900
    by_category = {row["category"]: row for row in stats.category_performance(cells).collect()}
    assert set(by_category) == {"web", "data"}
    data = [value for at, value in enumerate(values) if at % 9 == 6]
    assert by_category["data"]["n_rows"] == 100 and by_category["data"]["average"] == sum(data) / 100
    assert by_category["data"]["best"] == max(data)
    view = stats.category_view(cells, tables.categories(spark)).collect()
    assert [row["name"] for row in view] == ["Web", "Data"]
    assert [row["average"] for row in view][1] == float(f"{sum(data) / 100:.1f}")


def test_grades_come_in_text_order(spark):
    frame = spark.createDataFrame(
        [("web", grade, 1.0) for grade in ("B", "A-", "A", "A+", "F", "A")],
        "category string, grade string, total_score double",
    )
    listed = stats.grade_distribution(stats.score_cells(frame)).collect()
    assert [tuple(row) for row in listed] == [("A", 2), ("A+", 1), ("A-", 1), ("B", 1), ("F", 1)]


def test_no_submissions_give_no_figures(spark):
    cells = stats.score_cells(totals(spark, []))
    assert stats.overall(cells).collect() == [] and stats.grade_distribution(cells).collect() == []
    assert stats.overall_view(cells, board.recent_trend(totals(spark, []))).collect() == []


def test_overall_view(spark):
    frame = totals(spark, [70.25] * 9)
    view = stats.overall_view(stats.score_cells(frame), board.recent_trend(frame)).collect()
    assert [tuple(row) for row in view] == [(9, 70.2, 70.2, "Insufficient Data")]


def scored_history(spark, codes):
    frame = spark.createDataFrame(
        [(at, "write a function", code, "web", "2024-05-06T07:08:09") for at, code in enumerate(codes)],
        schemas.SUBMISSIONS,
    )
    return scoring.score_rows(frame)


def test_history_appends_and_top_is_found_by_key(spark):
    path = shared_folder(spark, "history")
    assert history.read_history(spark, path).collect() == []
    codes = [f"def name{n}():\n    return {n}" if n % 3 else f"x{n} = = 1" for n in range(60)]
    scored = scored_history(spark, codes).cache()
    history.append_history(scored.filter("seq < 30"), path, "one")
    history.append_history(scored.filter("seq >= 30"), path, "two")
    stored = history.read_history(spark, path)
    assert sorted(stored.collect()) == sorted(scored.collect())
    assert board.top_stored_scores(stored).collect() == board.top_scores(stored).collect()
    assert board.top_stored_scores(stored.filter("seq < 0")).collect() == []
    history.write_leaderboard(stored, path + "-top")
    assert len(history.read_leaderboard(spark, path + "-top").collect()) == 10


def test_history_file_import(spark, tmp_path):
    file = tmp_path / "scores.json"
    file.write_text(
        '{\n "scores_history": [\n'
        '  {"instruction": "a", "generated_code": "x = 1", "timestamp": "2024-05-06T07:08:09.5",'
        ' "total_score": 61.5, "grade": "C+", "syntax_errors": [], "category": "web", "code_length": 5},\n'
        '  {"instruction": "b", "generated_code": "", "timestamp": "t", "total_score": 0.0, "grade": "F",'
        ' "syntax_errors": ["Empty code"]}\n ],\n "high_scores": [], "timestamp": "2024"\n}'
    )
    first, second = history.import_history_file(spark, str(file)).orderBy("seq").collect()
    assert (first["seq"], first["total_score"], first["style_issues"], first["code_length"]) == (0, 61.5, [], 5)
    assert (second["category"], second["complexity_estimate"], second["code_length"], second["style_score"]) == ("general", "low", 0, 0.0)
    assert second["seq"] == 1 and second["syntax_errors"] == ["Empty code"] and second["scored_at"] is None
    assert history.import_history_file(spark, str(file), "high_scores").collect() == []
    assert history.import_history_file(spark, str(tmp_path / "none.json")).collect() == []
    broken = tmp_path / "broken.json"
    broken.write_text("{ not json")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        history.import_history_file(spark, str(broken)).collect()
    later = history.import_history_file(spark, str(file), first_seq=7)
    assert sorted(row["seq"] for row in later.collect()) == [7, 8]
    assert history.next_seq(later) == 9 and history.next_seq(later.limit(0)) == 0


def test_history_lines_import(spark):
    path = shared_folder(spark, "lines")
    scored = scored_history(spark, ["x = 1", "y = = 2"]).cache()
    history.export_history(scored, path)
    assert sorted(history.import_history_lines(spark, path).collect()) == sorted(scored.collect())
    bare = shared_folder(spark, "bare")
    spark.createDataFrame([('{"seq": 3, "instruction": "a"}',)], "value string").write.text(bare)
    row = history.import_history_lines(spark, bare).first()
    assert (row["seq"], row["grade"], row["total_score"], row["suggestions"]) == (3, "F", 0.0, [])
    bad = shared_folder(spark, "bad")
    spark.createDataFrame([('{"seq": 3',)], "value string").write.text(bad)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        history.import_history_lines(spark, bad).collect()
