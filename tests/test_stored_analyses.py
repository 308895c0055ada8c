"""Analyses kept across jobs, the filter before them, and tables bucketed by case."""

from __future__ import annotations

import random
import uuid

import pytest
from codelens import schemas
from codelens.functions import bloom
from codelens.operators import analysis, evaluation
from codelens.plans import layout
from codelens.plans.layout import shared_folder
from codelens.sources import analyses, bucketed, tables
from pyspark.sql import functions as F
from test_evaluation import runs_of
from test_plans import plan

CODES = ["import os", "import socket\nx = 1", "def f(:", "", None, "import os", "eval('1')", "é = 'ü'"]


def frame(spark, codes):
    return spark.createDataFrame(list(enumerate(codes)), "seq int, generated_code string")


@pytest.mark.parametrize("limit", [bloom.MAX_BYTES, 0])
def test_a_second_job_parses_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "MAX_BYTES", limit)
    path, rows = shared_folder(spark, "analyses"), frame(spark, CODES)
    assert analyses.add(rows, path) == 6  # null and empty are one text
    version = analyses.store(spark, path).latest()
    assert analyses.add(rows, path) == 0 and analyses.store(spark, path).latest() == version
    kept = analyses.attach(rows, path)
    assert "ArrowEvalPython" not in plan(kept)
    for policy in (analysis.Policy(), analysis.Policy(enable_networking=True)):
        assert sorted(analysis.scan(kept, policy).drop("analysis").collect(), key=str) == sorted(
            analysis.scan(analysis.analyse(rows), policy).drop("analysis").collect(), key=str
        )


def test_only_new_texts_are_parsed(spark):
    path = shared_folder(spark, "analyses")
    assert analyses.add(frame(spark, CODES[:3]), path) == 3
    assert analyses.add(frame(spark, CODES), path) == 3
    log = analyses.store(spark, path)
    assert log.compact() and analyses.add(frame(spark, [*CODES, "new = 1"]), path) == 1
    texts = [row[0] for row in log.rows().select(analyses.TEXT).collect()]
    assert sorted(texts) == sorted({code or "" for code in CODES} | {"new = 1"})
    missing = analyses.attach(frame(spark, ["never = 1", "import os"]), path)
    assert {row["seq"]: row["analysis"] is None for row in missing.collect()} == {0: True, 1: False}


def test_texts_with_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(analyses.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    path, rows = shared_folder(spark, "analyses"), frame(spark, CODES)
    assert analyses.add(rows, path) == 6
    found = {row["seq"]: row["analysis"]["status"] for row in analyses.attach(rows, path).collect()}
    assert found == {at: "syntax_error" if at == 2 else "ok" for at in range(len(CODES))}


def test_parse_tasks_are_bounded_and_come_in_whole_rounds(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 10)
    path, rows = shared_folder(spark, "analyses"), frame(spark, [f"x = {n}" for n in range(100)])
    log = analyses.store(spark, path)
    assert analyses.add(rows.limit(60), path) == 60 and len(log.entry(1)["files"]) == 8
    assert analyses.add(rows, path) == 40 and len(log.entry(2)["files"]) == 4
    assert sorted(row[0] for row in log.rows().select(analyses.TEXT).collect()) == sorted(f"x = {n}" for n in range(100))


def test_stored_texts_are_not_moved(spark):
    path, rows = shared_folder(spark, "analyses"), frame(spark, CODES)
    analyses.add(rows, path)
    lines = plan(analyses.attach(rows.hint("merge"), path).select("seq", "analysis")).splitlines()
    moved = [line for line in lines if "hashpartitioning" in line or "SortMergeJoin" in line]
    assert any("SortMergeJoin" in line for line in moved) and not any(analyses.TEXT in line for line in moved)


@pytest.mark.parametrize("limit", [layout.MAX_BROADCAST_BYTES, -1])
def test_repeated_texts_and_a_store_with_some_of_them(spark, monkeypatch, limit):
    monkeypatch.setattr(layout, "MAX_BROADCAST_BYTES", limit)
    path = shared_folder(spark, "analyses")
    assert analyses.add(frame(spark, ["a = 1"] * 50 + ["b = 1", None]), path) == 3
    rows = frame(spark, ["a = 1", "c = 1", "", "d ="] * 30)
    assert analyses.add(rows, path) == 2
    assert analyses.store(spark, path).rows().count() == 5
    statuses = analyses.attach(rows, path).groupBy("generated_code", "analysis.status").count().collect()
    assert sorted(map(tuple, statuses)) == [
        ("", "ok", 30), ("a = 1", "ok", 30), ("c = 1", "ok", 30), ("d =", "syntax_error", 30)
    ]


def test_the_filter_is_for_stores_larger_than_the_job(spark):
    path, rows = shared_folder(spark, "analyses"), frame(spark, [f"x = {n}" for n in range(100)])
    analyses.add(rows, path)
    few = rows.filter("seq < 5")
    assert "bitmap_construct_agg" in plan(analyses.attach(few, path))
    assert "bitmap_construct_agg" not in plan(analyses.attach(rows, path))
    assert analyses.add(few, path) == 0 and analyses.attach(few, path).filter("analysis is not null").count() == 5


def test_a_writer_that_saw_an_older_store_looks_again(spark, monkeypatch):
    path = shared_folder(spark, "analyses")
    real, late = analyses.settle, []

    def another_job_first(df):
        settled = real(df)
        if not late:
            late.append(True)
            analyses.add(frame(spark, CODES[:2]), path)
        return settled

    monkeypatch.setattr(analyses, "settle", another_job_first)
    assert analyses.add(frame(spark, CODES[:3]), path) == 1
    assert analyses.store(spark, path).rows().count() == 3


def test_no_rows_and_other_columns(spark):
    path = shared_folder(spark, "analyses")
    assert analyses.add(frame(spark, []), path) == 0
    assert analyses.attach(frame(spark, []), path).collect() == []
    extra = frame(spark, CODES).withColumn("analyses", F.lit(1)).withColumn("code", F.lit("x"))
    assert analyses.analyse_stored(extra, path).columns == [*extra.columns, "analysis"]
    assert analyses.attach(extra, path).count() == len(CODES)


def test_the_filter_never_misses_and_seldom_lies(spark):
    drawn = random.Random(3).sample(range(10**12), 6000)
    held, others = drawn[:3000], drawn[3000:]
    blocks = bloom.blocks_for(3000)
    made = bloom.build(spark.createDataFrame([(n,) for n in held], "key long"), F.col("key"), blocks)
    asked = spark.createDataFrame([(n, n in set(held)) for n in drawn], "key long, held boolean")
    found = bloom.may_hold(asked, F.col("key"), made, blocks).groupBy("held").count().collect()
    counts = {row["held"]: row["count"] for row in found}
    assert counts[True] == len(held) and counts.get(False, 0) < len(others) * 0.05
    assert bloom.blocks_for(10**9) is None


def _judging(spark, n=600, buckets=4):
    rows = [(at, None if at % 7 == 0 else 0 if at % 3 else at % 25, "def f():\n    return 1" if at % 4 else "x = =", at % 8 / 8,
             at % 2 == 0, "", "", None, None) for at in range(n)]
    runs, cases = runs_of(spark, rows), tables.builtin_cases(spark)
    name = f"t{uuid.uuid4().hex}"
    return runs, cases, bucketed.save_by_case(runs, cases, name, shared_folder(spark, name), buckets)


def test_judging_tables_by_case_moves_nothing(spark):
    runs, cases, (stored_runs, stored_cases) = _judging(spark)
    judged = evaluation.evaluate(stored_runs, stored_cases.hint("merge"))
    text = plan(judged)
    assert "Exchange" not in text and "SortMergeJoin" in text
    expected = evaluation.evaluate(runs, cases)
    assert judged.columns == expected.columns and sorted(judged.collect(), key=str) == sorted(expected.collect(), key=str)
    left_over = evaluation.unmatched(stored_runs, stored_cases.hint("merge"))
    assert "Exchange" not in plan(left_over)
    assert sorted(left_over.collect(), key=str) == sorted(evaluation.unmatched(runs, cases).collect(), key=str)


def test_a_hot_case_is_spread_over_buckets(spark):
    _, _, (runs, cases) = _judging(spark)
    per_part = runs.groupBy("case_id", evaluation.PART).count().collect()
    assert max(row["count"] for row in per_part) <= 600 / 4 * 1.3
    assert cases.filter("case_id = 0").count() > 1
    assert cases.filter("case_id = 18").count() == 1


def test_empty_tables_by_case(spark):
    name = f"t{uuid.uuid4().hex}"
    runs, cases = bucketed.save_by_case(runs_of(spark, []), spark.createDataFrame([], schemas.CASES), name, shared_folder(spark, name), 2)
    assert evaluation.evaluate(runs, cases).collect() == [] and evaluation.unmatched(runs, cases).collect() == []
