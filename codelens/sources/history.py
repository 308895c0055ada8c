"""The stored score history: runs that are saved once, and import of history files.

A history is one folder with two tables of runs (``runlog``): ``runs`` has what each
job or micro-batch added, ``refused`` what it refused. Saving a run twice adds
nothing, a save that was cut off is finished by saving it again, and readers see all
of a run or nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens import schemas
from codelens.operators import board
from codelens.sources import jsonlists
from codelens.sources.runlog import RunLog

RUNS, REFUSED = "runs", "refused"

# What a saved score has where its file leaves something out.
_DEFAULTS = {
    "syntax_score": 0.0, "functionality_score": 0.0, "style_score": 0.0, "efficiency_score": 0.0,
    "documentation_score": 0.0, "total_score": 0.0, "grade": "F", "code_length": 0,
    "complexity_estimate": "low", "category": "general",
}
_LISTS = ("syntax_errors", "style_issues", "positive_features", "suggestions")


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows if nothing was ever written there."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_log(spark: SparkSession, path: str) -> RunLog:
    """The table of scored runs, to read at a version, compact or clean."""
    return RunLog(spark, f"{path}/{RUNS}", schemas.HISTORY)


def append_history(scored: DataFrame, path: str, run: str) -> bool:
    """Adds scored rows as the run ``run``, unless that run is stored already."""
    return run_log(scored.sparkSession, path).add(scored, run)


def correct_history(scored: DataFrame, path: str, run: str) -> bool:
    """Adds rows that replace the stored rows with the same ``seq``; new ones are added."""
    return run_log(scored.sparkSession, path).add(scored, run, corrects=True)


def append_refused(refused: DataFrame, path: str, run: str) -> bool:
    return RunLog(refused.sparkSession, f"{path}/{REFUSED}", schemas.REFUSED).add(refused, run)


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows that count, whether jobs or streams added them, now or at an earlier version."""
    return run_log(spark, path).rows(version)


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    return RunLog(spark, f"{path}/{REFUSED}", schemas.REFUSED).rows()


def write_leaderboard(history: DataFrame, path: str) -> None:
    """Writes the ten best rows as a small table of their own."""
    board.top_stored_scores(history).coalesce(1).write.mode("overwrite").parquet(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.HISTORY)


def export_history(history: DataFrame, path: str) -> None:
    """The history as JSON Lines, written by all tasks in parallel."""
    history.write.mode("errorifexists").json(path)


def _with_defaults(rows: DataFrame) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.withColumns({
        **{name: F.coalesce(F.col(name), F.lit(value).cast(kinds[name])) for name, value in _DEFAULTS.items()},
        **{name: F.coalesce(F.col(name), F.array().cast("array<string>")) for name in _LISTS},
        "scored_at": F.try_to_timestamp("timestamp"),
    })


def import_history_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON Lines files, as exported, read in parallel; a bad line is an error."""
    return _with_defaults(spark.read.schema(schemas.HISTORY).option("mode", "FAILFAST").json(path))


def import_history_file(
    spark: SparkSession, path: str, part: str = "scores_history", first_seq: int = 0
) -> DataFrame:
    """Rows of one single-object JSON history file, numbered from ``first_seq`` in list order.

    ``part`` is scores_history or high_scores. All tasks read the file at once, in
    two passes that run now. Give a ``first_seq`` above what the history has, so
    that ties and the trend keep their order; ``import_into_history`` does. A missing
    file or a missing list has no rows; a file that is no such object is an error.
    """
    try:
        found = jsonlists.list_elements(spark, path, part)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.HISTORY)
    score = F.from_json("value", schemas.SCORE, {"mode": "FAILFAST"})
    return _with_defaults(found.select((F.col("position") + first_seq).alias("seq"), score.alias("score")).select("seq", "score.*"))


def import_into_history(spark: SparkSession, file: str, path: str, run: str) -> bool:
    """Adds a history file's rows behind what is stored, as the run ``run``."""
    return append_history(import_history_file(spark, file, first_seq=next_seq(read_history(spark, path))), path, run)


def next_seq(history: DataFrame) -> int:
    """The smallest number above all that are stored."""
    last = history.agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1
