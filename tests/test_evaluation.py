from __future__ import annotations

import restatement
import samples
from codelens import schemas
from codelens.functions import python_ast
from codelens.operators import evaluation, outcomes
from codelens.plans import jobs
from codelens.plans.layout import shared_folder
from codelens.sources import reports, tables

KEYWORDS = [["def", "RETURN"], [], None, ["zzz"], ["class", "for"]]


def runs_of(spark, rows):
    """Rows of (result_id, case_id, code, seconds, success, output, error, exit code, generation error)."""
    return spark.createDataFrame(rows, schemas.RUNS)


def test_quality_equals_the_restatement(spark):
    codes = samples.codes()
    rows = [(at, code, KEYWORDS[at % 5]) for at, code in enumerate(codes)]
    frame = spark.createDataFrame(rows, "at int, generated_code string, expected_keywords array<string>")
    for row in evaluation.add_quality(frame).collect():
        code, keywords = row["generated_code"], row["expected_keywords"]
        assert row["estimated_quality"] == restatement.quality(code, keywords), code
        assert row["contains_keywords"] == (
            not keywords or any(word.lower() in code.lower() for word in keywords)
        )


def test_case_table(spark):
    cases = tables.builtin_cases(spark).collect()
    assert [row["case_id"] for row in cases] == list(range(19))
    per_category = {}
    for row in cases:
        per_category[row["category"]] = per_category.get(row["category"], 0) + 1
    assert list(per_category.values()) == [3] * 6 + [1]
    levels = [row["difficulty"] for row in cases]
    assert (levels.count("easy"), levels.count("medium"), levels.count("hard")) == (5, 10, 4)
    assert sum(bool(row["input_text"]) for row in cases) == 2


def test_gates(spark):
    deep = "x = " + "-" * 100_000 + "1"
    runs = runs_of(spark, [
        (1, 0, "def factorial(n): return n", 1.0, True, "out", "", None, None),
        (2, 0, "def factorial(:", 1.0, True, "out", "err", None, None),
        (3, 0, "def factorial(n): return n", 2.5, True, "out", "", None, "no model"),
        (4, 0, deep, 1.0, True, "out", "", None, None),
        (5, 0, "def f(): pass", 1.0, None, None, None, None, None),
        (6, 999, "x", 1.0, True, "", "", None, None),
        (7, None, "x", 1.0, True, "", "", None, None),
    ])
    cases = tables.builtin_cases(spark)
    judged = {r["result_id"]: r for r in evaluation.evaluate(runs, cases).collect()}
    assert sorted(tuple(row) for row in evaluation.unmatched(runs, cases).collect()) == [
        (6, 999, "unknown case"), (7, None, "no case number"),
    ]
    assert set(judged) == {1, 2, 3, 4, 5}
    assert judged[1]["syntax_valid"] and judged[1]["execution_success"] and judged[1]["execution_output"] == "out"
    assert not judged[2]["syntax_valid"] and not judged[2]["execution_success"]
    assert judged[2]["execution_output"] == judged[2]["execution_error"] == "" and judged[2]["contains_keywords"]
    failed = judged[3]
    assert failed["generated_code"] == "" and failed["notes"] == "Error: no model"
    assert failed["estimated_quality"] == "poor" and not failed["contains_keywords"]
    assert failed["execution_time"] == 2.5 and not failed["execution_success"]
    if restatement.parse(deep)[0] == python_ast.OTHER:
        assert judged[4]["notes"].startswith("Error: ") and judged[4]["generated_code"] == ""
    assert judged[5]["execution_success"] is False and judged[5]["execution_output"] == ""


def test_report_adds_up_with_a_hot_case(spark):
    rows = [(n, 0 if n % 3 else n % 19, "def f():\n    return 1" if n % 4 else "x = =", n % 8 / 8,
             n % 2 == 0, "", "", None, None) for n in range(400)]
    lost = [(n, 19 + n % 4, "x", 1.0, True, "", "", None, None) for n in range(400, 411)]
    path = shared_folder(spark, "judged")
    report = jobs.evaluate_runs(runs_of(spark, rows + lost), tables.builtin_cases(spark), path)
    assert sorted(row["result_id"] for row in report["unmatched"].collect()) == list(range(400, 411))
    details = report["detailed_results"].collect()
    summary = report["summary"].collect()
    assert len(details) == 400 and len(summary) == 1
    valid = sum(row["syntax_valid"] for row in details)
    assert summary[0]["total_tests"] == 400 and summary[0]["syntax_valid"] == valid == 300
    assert summary[0]["syntax_valid_rate"] == 75.0
    assert summary[0]["avg_execution_time"] == sum(row["execution_time"] for row in details) / 400
    by_category = {row["category"]: row for row in report["category_statistics"].collect()}
    assert sum(row["total"] for row in by_category.values()) == 400
    for name, row in by_category.items():
        mine = [d for d in details if d["category"] == name]
        assert row["total"] == len(mine) and row["keyword_match"] == sum(d["contains_keywords"] for d in mine)
        assert row["avg_time"] == sum(d["execution_time"] for d in mine) / len(mine)
    qualities = {row["estimated_quality"]: row["n_rows"] for row in report["quality_distribution"].collect()}
    assert sum(qualities.values()) == 400
    out = shared_folder(spark, "report")
    reports.write_report(report, out)
    again = reports.read_report_part(spark, out, "detailed_results", report["detailed_results"].schema)
    assert sorted(again.collect()) == sorted(details)


def test_the_mean_time_is_over_known_times(spark):
    rows = [(n, n % 2, "x = 1", seconds, True, "", "", None, None) for n, seconds in enumerate([1.0, None, 1.0, None, 4.0, None])]
    cells = evaluation.report_cells(evaluation.evaluate(runs_of(spark, rows), tables.builtin_cases(spark)))
    assert cells.agg({"timed": "sum"}).first()[0] == 3
    assert evaluation.summary(cells).first()["avg_execution_time"] == 2.0
    untimed = evaluation.report_cells(evaluation.evaluate(runs_of(spark, rows[1:2]), tables.builtin_cases(spark)))
    assert evaluation.summary(untimed).first()["avg_execution_time"] is None


def test_quality_keeps_the_callers_columns(spark):
    frame = spark.createDataFrame([(1, "x = 1", ["x"])], "_id int, generated_code string, expected_keywords array<string>")
    assert evaluation.add_quality(frame).columns == [*frame.columns, "contains_keywords", "estimated_quality"]


def test_empty_report_has_no_summary_row(spark):
    judged = evaluation.evaluate(runs_of(spark, []), tables.builtin_cases(spark))
    cells = evaluation.report_cells(judged)
    assert evaluation.summary(cells).collect() == [] and evaluation.category_statistics(cells).collect() == []


def test_outcome_classes(spark):
    rows = [
        (1, 0, "", 0.0, True, "", "warning", None, None),
        (2, 0, "", 0.0, False, "", "Code execution timed out after 10 seconds", None, None),
        (3, 0, "", 0.0, False, "", "Security violation: Blocked import: os", None, None),
        (4, 0, "", 0.0, False, "", "Sandbox error: x", None, None),
        (5, 0, "", 0.0, False, "", "Subprocess execution error: x", None, None),
        (6, 0, "", 0.0, False, "", "KeyError: 'a'\nTraceback", None, None),
        (7, 0, "", 0.0, False, "", "KeyError: 'a'", 1, None),
        (8, 0, "", 0.0, False, "", "no prefix here", None, None),
        (9, 0, "", 0.0, None, "", None, None, None),
    ]
    got = {r["result_id"]: (r["outcome"], r["exception_name"]) for r in outcomes.classify(runs_of(spark, rows)).collect()}
    assert got == {
        1: ("success", None), 2: ("timeout", None), 3: ("security_violation", None), 4: ("sandbox_error", None),
        5: ("subprocess_error", None), 6: ("exception", "KeyError"), 7: ("nonzero_exit", None),
        8: ("unknown", None), 9: ("unknown", None),
    }


def test_expectation_check(spark):
    frame = spark.createDataFrame([(True, True), (False, True), (None, True)], "a boolean, e boolean")
    assert evaluation.expectation_check(frame, "a", "e").collect() == [(1, 3, False)]
    assert evaluation.expectation_check(frame.limit(1), "a", "e").first()["all_passed"]
