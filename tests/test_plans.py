"""The physical plans: what is read, what is shuffled, how often code is parsed."""

from __future__ import annotations

import contextlib
import io
import re
import time

from codelens import schemas
from codelens.operators import analysis, evaluation, rows, scoring, stats
from codelens.plans import jobs, layout
from codelens.plans.layout import shared_folder, spread
from codelens.sources import tables


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as printed:
        df.explain()
    return printed.getvalue()


def stored(spark, schema, parts=8):
    path = shared_folder(spark, "plan")
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_scoring_is_one_narrow_stage_with_one_parse(spark):
    text = plan(scoring.score_rows(stored(spark, schemas.SUBMISSIONS)))
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text and "Join" not in text


def test_filters_on_results_do_not_parse_again(spark):
    scanned = analysis.scan(analysis.analyse(stored(spark, schemas.SUBMISSIONS)))
    text = plan(scanned.filter("is_safe").filter("violation is null").select("seq", "scan_error"))
    assert text.count("ArrowEvalPython") == 1


def test_text_scores_leave_the_parser_and_unused_columns_out(spark):
    scored = scoring.add_scores(stored(spark, schemas.SUBMISSIONS))
    for name in ("functionality_score", "efficiency_score", "documentation_score", "complexity_estimate"):
        text = plan(scored.select("seq", name))
        assert "ArrowEvalPython" not in text, name
        assert "category:string" not in text and "timestamp:string" not in text
    assert "instruction:string" not in plan(scored.select("seq", "documentation_score"))


def test_only_the_code_column_goes_to_python(spark):
    text = plan(analysis.analyse(stored(spark, schemas.SUBMISSIONS)))
    assert "analyse_batch(coalesce(generated_code" in text and "MapInPandas" not in text


def test_blank_rows_are_refused_below_the_parser(spark):
    history = jobs.score_submissions(stored(spark, schemas.SUBMISSIONS)).history
    text = plan(history)
    assert text.index("ArrowEvalPython") < text.rindex("Filter")


def test_statistics_shuffle_cells_only(spark):
    cells = stats.score_cells(scoring.add_scores(stored(spark, schemas.SUBMISSIONS)))
    text = plan(cells)
    assert text.count("Exchange") == 1 and "partial_count" in text


def large_runs(spark):
    """Runs whose size Spark takes to be far above any broadcast limit."""
    return spark.range(10**9).selectExpr(
        "id as result_id", "id % 19 as case_id", "'x' as generated_code", "1D as execution_time",
        "true as execution_success", "'' as execution_output", "'' as execution_error",
        "cast(null as int) as exit_code", "cast(null as string) as generation_error",
    )


def test_cases_are_broadcast_and_runs_stay_in_place(spark):
    text = plan(evaluation.evaluate(large_runs(spark), tables.builtin_cases(spark)))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert text.count("ArrowEvalPython") == 1


def test_cases_of_unknown_size_are_measured(spark, monkeypatch):
    rows = tables.builtin_cases(spark).collect()
    unknown = spark.createDataFrame(rows, schemas.CASES)
    assert "hashpartitioning" in plan(evaluation.evaluate(large_runs(spark), unknown))
    text = plan(evaluation.evaluate(large_runs(spark), layout.broadcast_if_small(unknown)))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    monkeypatch.setattr(layout, "MAX_BROADCAST_BYTES", 100)
    assert layout.broadcast_if_small(unknown) is unknown


def test_samples_are_cut_by_a_pushed_filter(spark):
    path = shared_folder(spark, "sample")
    spark.range(0, 5000, 1, 4).selectExpr(
        "id as row_id", "'a' as instruction", "'' as input", "'b' as output"
    ).write.parquet(path)
    instructions, _ = tables.read_instructions(spark, path)
    text = plan(rows.first_rows(instructions, 1000))
    assert "LessThanOrEqual(row_id,999)" in text and "Exchange" not in text and "Limit" not in text
    assert rows.first_rows(instructions, 1000).count() == 1000


def test_spread_only_touches_small_inputs(spark):
    path = shared_folder(spark, "spread")
    spark.range(100).write.parquet(path)
    many = spark.read.parquet(path).repartition(16)
    assert spread(many, "id") is many
    one = spark.read.parquet(path).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_folders_lie_where_the_cluster_says(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "a"), shared_folder(spark, "a")
    assert first.startswith(base + "/a-") and first != second


def test_settled_rows_do_not_depend_on_their_input(spark):
    settled = layout.settle(spark.range(10).selectExpr("id % 2 as k").groupBy("k").count())
    assert "Range" not in plan(settled) and sorted(settled.collect()) == [(0, 5), (1, 5)]


def test_instruction_pairs_take_one_scan_and_one_shuffle(spark):
    from workload import inputs

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(inputs.pairs(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Join" not in text


def test_pairs_cross_blocks_of_turns(spark, monkeypatch):
    from workload import inputs

    before = sorted(tuple(r) for r in inputs.pairs(spark, "/root/testdata/sf0.001").collect())
    for size in (1, 2, 3):
        monkeypatch.setattr(inputs, "BLOCK", size)
        assert sorted(tuple(r) for r in inputs.pairs(spark, "/root/testdata/sf0.001").collect()) == before


def test_unknown_categories_are_not_parsed(spark):
    text = plan(jobs.performance_by_category(stored(spark, schemas.SUBMISSIONS)))
    assert text.index("ArrowEvalPython") < text.rindex("Filter")


def test_a_large_split_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 100)
    path = shared_folder(spark, "uneven")
    for rows in (1, 2, 3, 2000):
        spark.range(rows).coalesce(1).write.mode("append").parquet(path)
    with_one_large = spark.read.parquet(path)
    dealt = spread(with_one_large, "id")
    assert dealt.rdd.getNumPartitions() == 24
    assert max(dealt.rdd.glom().map(len).collect()) < 200 and dealt.count() == 2006
    assert spread(with_one_large.limit(0), "id").count() == 0


def test_shuffled_rows_leave_the_disk_with_their_job(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        return set(re.findall(r"shuffle_\d+", disk.getAllFiles().mkString(" ")))

    before, setting, path = shuffled(), spark.conf.get(name), shared_folder(spark, "dealt")
    with layout.shuffles_removed(spark):
        spark.range(1000).repartition(4, "id").write.parquet(path)
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(name) == setting == "false"
    assert spark.read.parquet(path).count() == 1000
