"""The registered queries: each runs one operator over whole derived tables.

Lists are joined into text and float means rounded to six digits, so that the
results compare exactly with those of another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens import schemas
from codelens.functions import vocab
from codelens.operators import (
    analysis,
    board,
    candidates,
    evaluation,
    lines,
    ordered,
    outcomes,
    prompts,
    rows,
    scoring,
    stats,
)
from codelens.plans import jobs
from codelens.plans.layout import shared_folder, stored_once
from codelens.sources import analyses, bucketed, files, history, jsonlists, reports, tables
from codelens.streaming import live
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]

SCORE_COLUMNS = (*scoring.SCALES, "total_score", "grade")
TOP_COLUMNS = ("seq", "category", "grade", "total_score")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def joined(df: DataFrame, separator: str, *names: str) -> DataFrame:
    return df.withColumns({name: F.array_join(name, separator) for name in names})


# Instruction rows


def sft_format(spark, folder):
    return prompts.format_rows(inputs.pairs(spark, folder))


def sft_prompt(spark, folder):
    return inputs.pairs(spark, folder).select(
        "row_id", prompts.inference_prompt(F.col("instruction"), F.col("input")).alias("prompt")
    )


def sft_sample(spark, folder):
    return rows.first_rows(inputs.pairs(spark, folder), 10)


def sft_max_samples(spark, folder):
    """A sample too large for a top-n; its cut-off key is found by counting."""
    return rows.first_rows(inputs.pairs(spark, folder), 150)


def sft_sample_by_text_key(spark, folder):
    """The first rows by their text, and where texts are equal by number."""
    return rows.first_rows_by(inputs.pairs(spark, folder), 150, "instruction", "row_id")


def sft_preview(spark, folder):
    return rows.preview(inputs.pairs(spark, folder))


def sft_count(spark, folder):
    return rows.row_count(inputs.pairs(spark, folder))


def sft_length(spark, folder):
    limited = jobs.prepare_training_rows(inputs.pairs(spark, folder), max_tokens=40)
    return limited.select("row_id", "n_tokens", "over_limit", "capped_text")


def response_extract(spark, folder):
    pair = inputs.pairs(spark, folder)
    prompt = prompts.inference_prompt(F.col("instruction"), F.col("input"))
    full = prompts.training_text(F.col("instruction"), F.col("input"), F.col("output"))
    return pair.select("row_id", prompt.alias("prompt"), full.alias("full")).select(
        "row_id", prompts.extract_response(F.col("full"), F.col("prompt")).alias("response")
    )


def _candidate_lists(spark, folder):
    """The lines of an answer stand for the candidates of its prompt."""
    return inputs.pairs(spark, folder).select("row_id", F.split("output", "\n").alias("candidates"))


def candidate_rows(spark, folder):
    return candidates.fan_out(_candidate_lists(spark, folder))


def candidate_merge(spark, folder):
    return _candidate_lists(spark, folder).select(
        "row_id", candidates.merge(F.col("candidates")).alias("merged")
    )


# Code analysis


def _submissions(spark, folder):
    return inputs.submissions(spark, folder).select(*schemas.SUBMISSIONS.names)


def reject_blank(spark, folder):
    _, refused = rows.split_blank(_submissions(spark, folder), "instruction", "generated_code")
    return refused.select("seq", "reason")


def default_category(spark, folder):
    blanked = inputs.submissions(spark, folder).select(
        "seq", F.when(F.col("category") != "general", F.col("category")).otherwise(" \t").alias("category")
    )
    return blanked.select("seq", rows.category_or_default(F.col("category")).alias("category"))


def _analysed(spark, folder):
    return analysis.analyse(_submissions(spark, folder).select("seq", "generated_code"))


def code_features(spark, folder):
    return analysis.features(_analysed(spark, folder)).select(
        "seq", "parse_status", "syntax_valid", "parse_error", "has_function", "has_class", "has_import"
    )


def name_quality(spark, folder):
    return analysis.features(_analysed(spark, folder)).select("seq", "n_names", "n_meaningful")


def code_inventory(spark, folder):
    listed = analysis.inventory(_analysed(spark, folder)).select("seq", "imports", "calls", "attributes")
    return joined(listed, ",", "imports", "calls", "attributes")


def _scanned(spark, folder, policy=analysis.Policy()):
    return analysis.scan(_analysed(spark, folder), policy).select("seq", "is_safe", "violation", "scan_error")


def security_scan(spark, folder):
    return _scanned(spark, folder)


def security_scan_stored(spark, folder):
    """One job stores the analyses, another scans them under its own policy."""
    path = shared_folder(spark, "analyses")
    submissions = _submissions(spark, folder).select("seq", "generated_code")
    analyses.add(submissions, path)
    kept = analyses.analyse_stored(submissions, path)
    policy = analysis.Policy(enable_networking=True)
    return analysis.scan(kept, policy).select("seq", "is_safe", "violation", "scan_error")


def security_scan_networking(spark, folder):
    return _scanned(spark, folder, analysis.Policy(enable_networking=True))


def _blocked(spark, folder, column):
    found = analysis.inventory(_analysed(spark, folder))
    return found.select("seq", F.array_join(column, ",").alias("blocked"))


def security_scan_allowed(spark, folder):
    return _scanned(spark, folder, analysis.Policy(allow_imports=("os", "urllib")))


def blocked_imports(spark, folder):
    return _blocked(spark, folder, analysis.blocked_imports(F.col("imports")))


def blocked_calls(spark, folder):
    return _blocked(spark, folder, analysis.blocked_calls(F.col("calls")))


def blocked_attributes(spark, folder):
    return _blocked(spark, folder, analysis.blocked_attributes(F.col("attributes")))


def violation_counts(spark, folder):
    return analysis.violation_counts(_scanned(spark, folder))


def usage_counts(spark, folder):
    return analysis.usage_counts(_analysed(spark, folder))


# Scores


def _scored(spark, folder):
    return scoring.add_scores(_submissions(spark, folder))


def _score_column(*names: str) -> Query:
    return lambda spark, folder: _scored(spark, folder).select("seq", *names)


def score_total(spark, folder):
    return rounded(_scored(spark, folder).select("seq", *SCORE_COLUMNS), "total_score")


def score_row(spark, folder):
    scored = jobs.score_submissions(_submissions(spark, folder)).history
    return rounded(scored, "total_score").select(
        "seq", "instruction", "generated_code", "timestamp", *SCORE_COLUMNS, "category",
        "complexity_estimate", "code_length",
    )


def feedback(spark, folder):
    return joined(_scored(spark, folder).select("seq", *scoring.FEEDBACK), " | ", *scoring.FEEDBACK)


def _prose_column(*names: str) -> Query:
    return lambda spark, folder: scoring.add_scores(inputs.prose(spark, folder)).select("doc_id", *names)


def prose_style_lines(spark, folder):
    facts = lines.add_line_facts(inputs.prose(spark, folder), "generated_code")
    return facts.select(
        "doc_id",
        *[F.col(f"_{name}").alias(name) for name in
          ("n_lines", "n_nonblank", "n_indents", "n_long", "commented")],
    )


# Evaluation


def _judged(spark, folder):
    return evaluation.evaluate(inputs.runs(spark, folder), inputs.cases(spark))


def _with_quality(spark, folder):
    return evaluation.add_quality(
        inputs.runs(spark, folder).join(inputs.cases(spark), "case_id")
    )


def keyword_match(spark, folder):
    return _with_quality(spark, folder).select("result_id", "contains_keywords")


def quality_class(spark, folder):
    return _with_quality(spark, folder).select("result_id", "estimated_quality")


def outcome_class(spark, folder):
    return outcomes.classify(inputs.runs(spark, folder)).select("result_id", "outcome", "exception_name")


def eval_gate(spark, folder):
    return _judged(spark, folder).select(
        "result_id", "syntax_valid", "execution_success", "execution_output", "execution_error", "notes"
    )


def eval_detail(spark, folder):
    return evaluation.details(_judged(spark, folder))


def eval_unmatched(spark, folder):
    return evaluation.unmatched(inputs.runs(spark, folder), inputs.cases(spark))


def _cells(spark, folder):
    return evaluation.report_cells(_judged(spark, folder))


def eval_summary(spark, folder):
    return rounded(
        evaluation.summary(_cells(spark, folder)),
        "syntax_valid_rate", "keyword_match_rate", "execution_success_rate", "avg_execution_time",
    )


def eval_categories(spark, folder):
    return rounded(evaluation.category_statistics(_cells(spark, folder)), "avg_time")


def eval_rates(spark, folder):
    rates = evaluation.category_rates(evaluation.category_statistics(_cells(spark, folder)))
    return rounded(rates, "syntax_rate", "keyword_rate", "avg_time")


def eval_quality(spark, folder):
    return evaluation.quality_distribution(_cells(spark, folder))


def eval_bucketed(spark, folder):
    """Runs and cases stored by case, most cases in several parts, and judged where they lie."""
    name = f"judging_{uuid.uuid4().hex}"
    stored = bucketed.save_by_case(inputs.runs(spark, folder), inputs.cases(spark), name, shared_folder(spark, name), 16)
    runs, cases = stored
    return evaluation.details(evaluation.evaluate(runs, cases.hint("merge")))


def eval_expectation(spark, folder):
    judged = _judged(spark, folder).select("execution_success", (F.col("result_id") % 2 == 0).alias("expected"))
    return evaluation.expectation_check(judged, "execution_success", "expected")


# Statistics and boards


def _score_cells(spark, folder):
    return stats.score_cells(_scored(spark, folder))


def stats_overall(spark, folder):
    return rounded(stats.overall(_score_cells(spark, folder)), "average_score", "highest_score", "lowest_score")


def grade_distribution(spark, folder):
    return stats.grade_distribution(_score_cells(spark, folder))


def category_performance(spark, folder):
    return rounded(jobs.performance_by_category(_submissions(spark, folder)), "average", "best")


def trend(spark, folder):
    latest = rows.last_rows(_submissions(spark, folder), 2 * vocab.TREND_ROWS)
    return board.recent_trend(scoring.add_scores(latest))


def stats_view(spark, folder):
    return stats.overall_view(_score_cells(spark, folder), trend(spark, folder))


def category_view(spark, folder):
    return stats.category_view(_score_cells(spark, folder), tables.categories(spark))


def high_scores(spark, folder):
    return rounded(board.high_scores(_scored(spark, folder).select(*TOP_COLUMNS)), "total_score")


def high_scores_category(spark, folder):
    scored = _scored(spark, folder).select(*TOP_COLUMNS)
    return rounded(board.high_scores(scored, "functions", 5), "total_score")


def leaderboard_view(spark, folder):
    return board.leaderboard_view(_scored(spark, folder))


def leaderboard_top5(spark, folder):
    return board.leaderboard_view(_scored(spark, folder), width=60, limit=5)


def high_score_entries(spark, folder):
    """Which submissions entered the ten best when they arrived."""
    return rounded(ordered.high_score_entries(_scored(spark, folder)), "total_score")


def trend_history(spark, folder):
    """The trend as it was after each submission."""
    return ordered.trend_history(_scored(spark, folder))


def empty_report(spark, folder):
    """How many rows each report has on no submissions and no runs."""
    cells = stats.score_cells(scoring.add_scores(_submissions(spark, folder).filter("seq < 0")))
    judged = evaluation.evaluate(inputs.runs(spark, folder).filter("result_id < 0"), inputs.cases(spark))
    reported = evaluation.report_cells(judged)
    parts = {
        "overall": stats.overall(cells), "grades": stats.grade_distribution(cells), "categories": stats.category_performance(cells),
        "summary": evaluation.summary(reported), "quality": evaluation.quality_distribution(reported),
        "cases": evaluation.category_statistics(reported),
    }
    counts = [rows.agg(F.lit(name).alias("part"), F.count("*").alias("n_rows")) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, counts)


# Stores. Each run writes to a new shared folder and reads it back.


def _history(spark, folder):
    path = shared_folder(spark, "history")
    history.append_history(jobs.score_submissions(_submissions(spark, folder)).history, path, "all")
    return history.read_history(spark, path)


def history_retry(spark, folder):
    """The same job twice: its run is stored once."""
    path = shared_folder(spark, "retried")
    for _ in range(2):
        history.append_history(jobs.score_submissions(_submissions(spark, folder)).history, path, "job")
    return rounded(history.read_history(spark, path), "total_score").select("seq", "total_score", "grade")


def history_import(spark, folder):
    """Exported rows of which only a few fields are left, moved behind what is stored."""
    path = shared_folder(spark, "fields")
    scored = jobs.score_submissions(_submissions(spark, folder)).history
    left = scored.select((F.col("seq") + 1000).alias("seq"), "instruction", "generated_code", "timestamp", "total_score")
    left.write.json(path)
    return rounded(history.import_history_lines(spark, path), "total_score").select(
        "seq", "total_score", "grade", "complexity_estimate", "category", "style_score", "code_length"
    )


def history_import_file(spark, folder):
    """All scored rows as one JSON object in one file, read by all tasks."""
    path = shared_folder(spark, "object")
    scored = jobs.score_submissions(_submissions(spark, folder)).history
    line = F.to_json(F.struct(*[name for name in scored.columns if name not in ("seq", "scored_at")]))
    # One file is the feature; all tasks write it.
    files.make_folder(spark, path)
    jsonlists.write_object(
        scored.select("seq", line.alias("value")), f"{path}/history.json",
        '{"scores_history": [', '], "high_scores": [], "timestamp": "now"}\n',
    )
    imported = history.import_history_file(spark, f"{path}/history.json")
    return rounded(imported, "total_score").select("seq", "total_score", "grade", "category", "timestamp", "code_length")


def sft_malformed(spark, folder):
    """Every third line is cut short before it is read."""
    path = shared_folder(spark, "lines")
    line = F.to_json(F.struct("row_id", "instruction", "input", "output"))
    cut = F.when(F.col("row_id") % 3 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    inputs.pairs(spark, folder).select(cut.alias("value")).write.text(path)
    kept, refused = tables.read_instructions(spark, path, "json")
    number = F.regexp_extract("line", '"row_id":([0-9]+)', 1).cast("long")
    return kept.select("row_id", F.lit("read").alias("status")).union(refused.select(number, "reason"))


def history_roundtrip(spark, folder):
    stored = rounded(_history(spark, folder), "total_score")
    return joined(stored, " | ", "style_issues").select("seq", "grade", "total_score", "style_issues", "timestamp")


def history_top(spark, folder):
    path = shared_folder(spark, "leaderboard")
    history.write_leaderboard(_history(spark, folder), path)
    return history.read_leaderboard(spark, path).select("seq", "generated_code", "grade")


def history_export(spark, folder):
    path = shared_folder(spark, "export")
    history.export_history(jobs.score_submissions(_submissions(spark, folder)).history, path)
    return rounded(spark.read.schema(schemas.HISTORY).json(path), "total_score").select(*TOP_COLUMNS)


def _stored_part(part: str, *means: str) -> Query:
    """One part of a report that was written and is read again."""

    def query(spark, folder):
        path = shared_folder(spark, "report")
        report = jobs.evaluate_runs(inputs.runs(spark, folder), inputs.cases(spark), shared_folder(spark, "judged"))
        reports.write_report(report, path)
        return rounded(reports.read_report_part(spark, path, part, report[part].schema), *means)

    return query


# Streams: the submissions arrive as several files, in several micro-batches.


def _score(spark, base):
    """Runs the scoring stream until it has seen all files that arrived, in a few micro-batches."""
    arrived = sum(name.endswith(".parquet") for name in files.names(spark, f"{base}/arriving"))
    live.score_stream(
        spark, f"{base}/arriving", f"{base}/history", f"{base}/score-state",
        available_now=True, files_per_batch=max(2, arrived // 4), tasks=spark.sparkContext.defaultParallelism,
    ).awaitTermination()


def _arrive(spark, base, rows):
    """Every task that made rows writes a file of them."""
    rows.write.mode("append").parquet(f"{base}/arriving")
    _score(spark, base)


def _arrived(spark, folder):
    """Runs the scoring stream over all submissions; returns its folder."""
    base = shared_folder(spark, "stream")
    _arrive(spark, base, _submissions(spark, folder))
    return base


def stream_restart(spark, folder):
    """Two runs of one query: the second goes on where the first ended."""
    base = shared_folder(spark, "restart")
    for half in (0, 1):
        _arrive(spark, base, _submissions(spark, folder).filter(F.col("seq") % 2 == half))
    return rounded(history.read_history(spark, f"{base}/history"), "total_score").select("seq", "total_score", "grade")


def _mixed(spark, folder):
    """Half of the submissions scored by a job, half by the stream."""
    base = shared_folder(spark, "mixed")
    rows_in = _submissions(spark, folder)
    scored = jobs.score_submissions(rows_in.filter("seq % 2 = 0"))
    history.append_history(scored.history, f"{base}/history", "job")
    _arrive(spark, base, rows_in.filter("seq % 2 = 1"))
    return base


def history_mixed(spark, folder):
    stored = history.read_history(spark, f"{_mixed(spark, folder)}/history")
    return rounded(stored, "total_score").select("seq", "total_score", "grade")


def _cells_of(spark, base):
    """Runs the statistics stream over what it has not seen; returns its cells."""
    live.statistics_stream(spark, f"{base}/history", f"{base}/cells", f"{base}/cells-state", available_now=True).awaitTermination()
    return live.running_cells(spark, f"{base}/cells")


def _overall(cells):
    return rounded(stats.overall(cells), "average_score", "highest_score", "lowest_score")


def history_mixed_stats(spark, folder):
    """Running statistics over a history that a job and a stream wrote."""
    return _overall(_cells_of(spark, _mixed(spark, folder)))


def _parts(spark, folder, n=4):
    """Scored submissions in several parts, as several jobs would save them."""
    return [jobs.score_submissions(_submissions(spark, folder).filter(F.col("seq") % n == part)).history for part in range(n)]


def history_interrupted(spark, folder):
    """Saves that end after writing their files, then are made again."""
    path = shared_folder(spark, "interrupted")
    log = history.run_log(spark, path)
    for number, part in enumerate(map(stored_once, _parts(spark, folder))):  # scored once, written twice
        part.write.parquet(f"{log.folder}/data/job-{number}-cut-off")
        history.append_history(part, path, f"job-{number}")
    return rounded(history.read_history(spark, path), "total_score").select("seq", "total_score", "grade")


def stream_late_files(spark, folder):
    """Half of the files that arrive are dated long before the others."""
    base = shared_folder(spark, "late")
    for half, days in ((0, 0), (1, 9)):
        part = f"{base}/part-{half}"
        _submissions(spark, folder).filter(F.col("seq") % 2 == half).write.parquet(part)
        files.make_folder(spark, f"{base}/arriving")
        for name in files.names(spark, part):
            if name.endswith(".parquet"):
                files.move(spark, f"{part}/{name}", f"{base}/arriving/{half}-{name}")
                files.set_age(spark, f"{base}/arriving/{half}-{name}", days)
    _score(spark, base)
    return rounded(history.read_history(spark, f"{base}/history"), "total_score").select("seq", "total_score", "grade")


def history_compacted(spark, folder):
    """Statistics that go on while runs are merged and their files deleted."""
    base = shared_folder(spark, "compacted")
    log = history.run_log(spark, f"{base}/history")
    for number, part in enumerate(_parts(spark, folder)):
        history.append_history(part, f"{base}/history", f"job-{number}")
        if number == 0:
            _cells_of(spark, base)
        if number == 2:
            log.compact()
            log.clean(hours=0)
    return _overall(_cells_of(spark, base))


def _corrected(spark, folder):
    """A history of which a third has a wrong score and category, and the right rows."""
    path = shared_folder(spark, "corrected")
    scored = stored_once(jobs.score_submissions(_submissions(spark, folder)).history)
    wrong = scored.withColumn("total_score", F.when(F.col("seq") % 3 == 0, 200.0).otherwise(F.col("total_score")))
    wrong = wrong.withColumn("category", F.when(F.col("seq") % 3 == 0, "web").otherwise(F.col("category")))
    history.append_history(wrong, f"{path}/history", "first")
    return path, scored.filter("seq % 3 = 0")


def history_corrected(spark, folder):
    """What readers see once a third of the rows was corrected."""
    base, right = _corrected(spark, folder)
    history.correct_history(right, f"{base}/history", "second")
    return rounded(history.read_history(spark, f"{base}/history"), "total_score").select("seq", "category", "total_score", "grade")


def stream_corrected(spark, folder):
    """Running statistics that saw the wrong rows before the right ones."""
    base, right = _corrected(spark, folder)
    _cells_of(spark, base)
    history.correct_history(right, f"{base}/history", "second")
    return rounded(stats.category_performance(_cells_of(spark, base)), "average", "best")


def history_refused(spark, folder):
    return history.read_refused(spark, f"{_arrived(spark, folder)}/history").select("seq", "reason")


def stream_scores(spark, folder):
    base = _arrived(spark, folder)
    return rounded(history.read_history(spark, f"{base}/history"), "total_score").select(
        "seq", "total_score", "grade"
    )


def _running_cells(spark, folder):
    return _cells_of(spark, _arrived(spark, folder))


def stream_stats(spark, folder):
    return rounded(stats.category_performance(_running_cells(spark, folder)), "average", "best")


def stream_overall(spark, folder):
    return _overall(_running_cells(spark, folder))


def stream_grades(spark, folder):
    return stats.grade_distribution(_running_cells(spark, folder))


def stream_top10(spark, folder):
    base = _arrived(spark, folder)
    live.top_stream(spark, f"{base}/history", f"{base}/top", f"{base}/top-state", available_now=True).awaitTermination()
    return rounded(live.running_top(spark, f"{base}/top"), "total_score").select(*TOP_COLUMNS)


def stream_trend(spark, folder):
    base = _arrived(spark, folder)
    live.trend_stream(spark, f"{base}/history", f"{base}/trend", f"{base}/trend-state", available_now=True).awaitTermination()
    return live.running_trend(spark, f"{base}/trend")


QUERIES: dict[str, Query] = {
    "sft_format": sft_format,
    "sft_prompt": sft_prompt,
    "sft_sample": sft_sample,
    "sft_max_samples": sft_max_samples,
    "sft_sample_by_text_key": sft_sample_by_text_key,
    "sft_preview": sft_preview,
    "sft_count": sft_count,
    "sft_length": sft_length,
    "response_extract": response_extract,
    "candidate_rows": candidate_rows,
    "candidate_merge": candidate_merge,
    "reject_blank": reject_blank,
    "default_category": default_category,
    "code_features": code_features,
    "name_quality": name_quality,
    "code_inventory": code_inventory,
    "security_scan": security_scan,
    "security_scan_networking": security_scan_networking,
    "security_scan_stored": security_scan_stored,
    "security_scan_allowed": security_scan_allowed,
    "blocked_imports": blocked_imports,
    "blocked_calls": blocked_calls,
    "blocked_attributes": blocked_attributes,
    "violation_counts": violation_counts,
    "usage_counts": usage_counts,
    "score_syntax": _score_column("syntax_score"),
    "score_functionality": _score_column("functionality_score"),
    "score_style": _score_column("style_score"),
    "score_efficiency": _score_column("efficiency_score"),
    "score_docs": _score_column("documentation_score"),
    "complexity": _score_column("complexity_estimate", "code_length"),
    "score_total": score_total,
    "score_row": score_row,
    "feedback": feedback,
    "prose_efficiency": _prose_column("efficiency_score"),
    "prose_docs": _prose_column("documentation_score"),
    "prose_complexity": _prose_column("complexity_estimate", "code_length"),
    "prose_style_lines": prose_style_lines,
    "keyword_match": keyword_match,
    "quality_class": quality_class,
    "outcome_class": outcome_class,
    "eval_gate": eval_gate,
    "eval_detail": eval_detail,
    "eval_unmatched": eval_unmatched,
    "eval_summary": eval_summary,
    "eval_categories": eval_categories,
    "eval_rates": eval_rates,
    "eval_quality": eval_quality,
    "eval_expectation": eval_expectation,
    "eval_bucketed": eval_bucketed,
    "stats_overall": stats_overall,
    "grade_distribution": grade_distribution,
    "category_performance": category_performance,
    "stats_view": stats_view,
    "category_view": category_view,
    "high_scores": high_scores,
    "high_scores_category": high_scores_category,
    "leaderboard_view": leaderboard_view,
    "leaderboard_top5": leaderboard_top5,
    "trend": trend,
    "trend_history": trend_history,
    "high_score_entries": high_score_entries,
    "empty_report": empty_report,
    "history_roundtrip": history_roundtrip,
    "history_top": history_top,
    "history_export": history_export,
    "report_roundtrip": _stored_part("category_statistics", "avg_time"),
    "report_summary_stored": _stored_part(
        "summary", "syntax_valid_rate", "keyword_match_rate", "execution_success_rate", "avg_execution_time"
    ),
    "report_quality_stored": _stored_part("quality_distribution"),
    "report_details_stored": _stored_part("detailed_results"),
    "report_unmatched_stored": _stored_part("unmatched"),
    "history_retry": history_retry,
    "history_mixed": history_mixed,
    "history_mixed_stats": history_mixed_stats,
    "history_refused": history_refused,
    "history_interrupted": history_interrupted,
    "history_compacted": history_compacted,
    "history_corrected": history_corrected,
    "history_import": history_import,
    "history_import_file": history_import_file,
    "sft_malformed": sft_malformed,
    "stream_restart": stream_restart,
    "stream_scores": stream_scores,
    "stream_stats": stream_stats,
    "stream_overall": stream_overall,
    "stream_grades": stream_grades,
    "stream_top10": stream_top10,
    "stream_trend": stream_trend,
    "stream_late_files": stream_late_files,
    "stream_corrected": stream_corrected,
}
