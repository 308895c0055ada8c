"""Streaming queries around one stored history.

``score_stream`` parses and scores each arriving row once and adds each
micro-batch to the history as a run of its own; a replayed batch finds its run
stored and adds nothing. What it refuses is stored too. The statistics, the
high-score list and the trend follow the history's log: their offsets are versions
of it, so they see what any job or stream added, corrected or compacted, each once,
whatever its age, and neither parse again nor list what they have seen. Corrected
rows are taken out: only what they touched is made anew from the history.

Their results are a few rows, kept as one snapshot per micro-batch: a replayed
batch overwrites its own, and all but the last few are deleted. Each query continues
from its checkpoint folder after a restart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codelens import schemas
from codelens.functions import vocab
from codelens.operators import board, rows, scoring, stats
from codelens.plans.layout import tasks_for
from codelens.sources import files, history as stored
from codelens.sources.history import read_or_empty
from codelens.sources.runlog import RunLog, RunLogSource

SNAPSHOTS_KEPT = 3
ANY_AGE = "36500d"  # else files much older than the newest would be left out

CELLS = "category string, grade string, n_rows bigint, sum_score double, best_score double, worst_score double"
BOARD = StructType([
    field for field in schemas.HISTORY.fields
    if field.name in ("seq", "instruction", "timestamp", "category", "grade", "total_score")
])

TREND = "seq bigint, total_score double"


def _writer(stream: DataFrame, checkpoint: str, available_now: bool):
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def score_stream(
    spark: SparkSession,
    source: str,
    history: str,
    checkpoint: str,
    available_now: bool = False,
    files_per_batch: int | None = None,
    tasks: int | None = None,
) -> StreamingQuery:
    """Scores submissions as their Parquet files arrive in ``source``.

    The runs it adds are named after the checkpoint folder and the micro-batch:
    a stream that starts anew needs a new checkpoint folder, not an emptied one.
    With ``tasks``, each micro-batch is spread over that many tasks by ``seq``, or
    more if it is large; give it if batches consist of fewer files than there are cores.
    """
    reader = spark.readStream.schema(schemas.SUBMISSIONS).option("maxFileAge", ANY_AGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("category", rows.category_or_default(batch["category"]))
        kept, refused = rows.split_blank(named, "generated_code")
        if tasks:
            kept = kept.repartition(tasks_for(batch.count(), tasks), "seq")
        run = f"stream-{name}-{batch_id}"
        stored.append_refused(refused, history, run)
        stored.append_history(scoring.score_rows(kept), history, run)

    return _writer(reader.parquet(source), checkpoint, available_now).foreachBatch(save).start()


def _follow(
    spark: SparkSession, history: str, checkpoint: str, available_now: bool, update: Callable[[RunLog, int, int, int], None]
) -> StreamingQuery:
    """Calls ``update`` with the log, the versions after and up to which there is news, and the batch."""
    log = stored.run_log(spark, history)
    spark.dataSource.register(RunLogSource)
    positions = spark.readStream.format(RunLogSource.name()).option("path", log.folder).load()

    def pass_on(batch: DataFrame, batch_id: int) -> None:
        after, upto = batch.agg(F.min("after"), F.max("upto")).first()
        if upto is not None:
            update(stored.run_log(batch.sparkSession, history), after, upto, batch_id)

    return _writer(positions, checkpoint, available_now).foreachBatch(pass_on).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    prefix = "batch_id="
    found = [name.removeprefix(prefix) for name in files.names(spark, path) if name.startswith(prefix)]
    return sorted(int(number) for number in found if number.isdigit())


def _save_snapshot(rows_now: DataFrame, path: str, batch_id: int) -> None:
    """Writes a few rows, then deletes snapshots that no replay can ask for."""
    spark = rows_now.sparkSession
    rows_now.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    for old in _batches(spark, path):
        if old <= batch_id - SNAPSHOTS_KEPT:
            files.delete(spark, f"{path}/batch_id={old}")


def latest_snapshot(
    spark: SparkSession, path: str, schema, before: int | None = None
) -> DataFrame:
    """The snapshot with the highest batch number, below ``before`` if given."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    found = [number for number in _batches(spark, path) if before is None or number < before]
    if not found:
        return spark.createDataFrame([], schema)
    return read_or_empty(spark, f"{path}/batch_id={found[-1]}", schema)


def statistics_stream(
    spark: SparkSession, history: str, snapshots: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keeps the score cells, at most 96 rows however long it runs.

    A corrected row leaves its cell; as that cell's best and worst may have been
    its own, the cells that lost rows are made anew.
    """

    def update(log: RunLog, after: int, upto: int, batch_id: int) -> None:
        added, replaced = log.changes(after, upto)
        cells = latest_snapshot(log.spark, snapshots, CELLS, before=batch_id)
        if replaced is None:
            return _save_snapshot(stats.merge_cells(cells.unionByName(stats.score_cells(added))), snapshots, batch_id)
        touched = F.broadcast(replaced.select(stats.cell_category(F.col("category")).alias("category"), "grade").distinct())
        others = stats.score_cells(added).unionByName(cells).join(touched, ["category", "grade"], "left_anti")
        named = log.rows(upto).withColumn("category", stats.cell_category(F.col("category")))
        anew = stats.score_cells(named.join(touched, ["category", "grade"], "left_semi"))
        _save_snapshot(stats.merge_cells(others).unionByName(anew), snapshots, batch_id)

    return _follow(spark, history, checkpoint, available_now, update)


def running_cells(spark: SparkSession, snapshots: str) -> DataFrame:
    """The latest cells, for every function of ``operators.stats``."""
    return latest_snapshot(spark, snapshots, CELLS)


def _keep_rows(
    spark: SparkSession, history: str, snapshots: str, checkpoint: str, available_now: bool, schema: StructType,
    choose: Callable[[DataFrame], DataFrame], afresh: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Keeps the few rows that ``choose`` takes; made ``afresh`` when one of them was corrected."""

    def update(log: RunLog, after: int, upto: int, batch_id: int) -> None:
        added, replaced = log.changes(after, upto)
        before = latest_snapshot(log.spark, snapshots, schema, before=batch_id)
        if replaced is not None and replaced.join(F.broadcast(before), "seq", "left_semi").limit(1).count():
            kept = choose(afresh(log.rows(upto)))
        else:
            kept = choose(before.unionByName(choose(added.select(*schema.names))))
        _save_snapshot(kept, snapshots, batch_id)

    return _follow(spark, history, checkpoint, available_now, update)


def top_stream(
    spark: SparkSession, history: str, snapshots: str, checkpoint: str, k: int = vocab.TOP_SCORES, available_now: bool = False
) -> StreamingQuery:
    """Keeps the ``k`` best rows seen so far."""
    return _keep_rows(
        spark, history, snapshots, checkpoint, available_now, BOARD,
        lambda rows_now: board.top_scores(rows_now, k), lambda whole: board.top_stored_scores(whole, k).select(*BOARD.names),
    )


def trend_stream(spark: SparkSession, history: str, snapshots: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keeps the last rows by ``seq``, also those that arrive late, for the trend."""
    schema = StructType.fromDDL(TREND)
    return _keep_rows(spark, history, snapshots, checkpoint, available_now, schema, board.trend_rows, lambda whole: whole.select(*schema.names))


def running_trend(spark: SparkSession, snapshots: str) -> DataFrame:
    return board.recent_trend(latest_snapshot(spark, snapshots, TREND))


def running_top(spark: SparkSession, snapshots: str) -> DataFrame:
    return latest_snapshot(spark, snapshots, BOARD)
