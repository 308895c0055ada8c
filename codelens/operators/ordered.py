"""What each row meant when it arrived: views along the order of ``seq``, in range partitions.

Rows are range-sorted once and keep the number of their part. What a part needs of
the parts before it is a few rows of each: the ones just before it, or the best so
far. So no task sees more than its own part, however long the history.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import vocab
from codelens.operators.board import trend_name
from codelens.plans.layout import shared_folder

# Workers get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sorted(scored: DataFrame) -> DataFrame:
    """``seq, total_score`` in sorted ranges.

    Stored first: ranges are found by a sample, which would score every row a second time.
    """
    spark, place = scored.sparkSession, shared_folder(scored.sparkSession, "totals")
    scored.select("seq", "total_score").write.parquet(place)
    totals = spark.read.schema("seq long, total_score double").parquet(place)
    return totals.repartitionByRange("seq").sortWithinPartitions("seq")


def _placed(scored: DataFrame) -> DataFrame:
    """``seq, total_score`` and the number of the range they lie in, stored."""
    spark, place = scored.sparkSession, shared_folder(scored.sparkSession, "ranges")
    _sorted(scored).withColumn("_part", F.spark_partition_id()).write.parquet(place)
    return spark.read.schema("seq long, total_score double, _part int").parquet(place)


def _with_rows_before(placed: DataFrame, n: int) -> DataFrame:
    """``placed``, and copies (``_own`` false) of the ``n`` rows before each part in it.

    One row for each part reaches the driver: its size tells from which parts the
    rows come, several if some are smaller than ``n``.
    """
    sizes = sorted((row["_part"], row["count"]) for row in placed.groupBy("_part").count().collect())
    wanted = []
    for at, (part, _) in enumerate(sizes):
        missing = n
        for source, size in reversed(sizes[:at]):
            if missing <= 0:
                break
            wanted.append((part, source, min(size, missing)))
            missing -= size
    spark = placed.sparkSession
    wants = F.broadcast(spark.createDataFrame(wanted, "_target int, _part int, _n int"))
    from_end = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("seq")))
    edges = placed.withColumn("_place", from_end).filter(F.col("_place") <= n).join(wants, "_part").filter(F.col("_place") <= F.col("_n"))
    copies = edges.select("seq", "total_score", F.col("_target").alias("_part"), F.lit(False).alias("_own"))
    return placed.withColumn("_own", F.lit(True)).unionByName(copies)


def trend_history(scored: DataFrame) -> DataFrame:
    """``seq, recent_trend``: the trend as it was after each row."""
    n = vocab.TREND_ROWS
    last = F.collect_list("total_score").over(Window.partitionBy("_part").orderBy("seq").rowsBetween(1 - 2 * n, 0))
    rows = _with_rows_before(_placed(scored), 2 * n - 1).withColumn("totals", last)
    return rows.filter("_own").select("seq", trend_name(F.col("totals")).alias("recent_trend"))


def _arrivals(best: list[float], rows: Iterator[tuple[int, float]], k: int) -> Iterator[tuple[int, float, int]]:
    """Rows that were among the ``k`` best when they came, with their place; ``best`` is a heap and kept up to date."""
    for seq, total in rows:
        if len(best) < k or total > best[0]:
            yield seq, total, 1 + sum(other >= total for other in best)
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, total)


def high_score_entries(scored: DataFrame, k: int = vocab.TOP_SCORES) -> DataFrame:
    """``seq, total_score, position``: rows that entered the ``k`` best when they arrived.

    A part alone tells which of its rows can have entered: those that do within it.
    Of them, the best of the parts before decide. Only these few rows are stored and
    looked at again; the driver passes ``k`` numbers on from part to part.
    """
    spark = scored.sparkSession

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: list[float] = []
        for batch in batches:
            totals = batch.column(1).to_numpy()
            if len(best) == k:
                batch = batch.filter(pa.array(totals > best[0]))
            kept = list(_arrivals(best, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), k))
            yield pa.RecordBatch.from_pydict({
                "seq": pa.array([row[0] for row in kept], pa.int64()), "total_score": pa.array([row[1] for row in kept], pa.float64()),
                "_part": pa.array([TaskContext.get().partitionId()] * len(kept), pa.int32()),
            })

    place = shared_folder(spark, "candidates")
    schema = "seq long, total_score double, _part int"
    _sorted(scored).mapInArrow(candidates, schema).write.parquet(place)
    found = spark.read.schema(schema).parquet(place)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("total_score"), "seq"))
    best, before = [], {}
    for row in found.withColumn("_rank", rank).filter(F.col("_rank") <= k).orderBy("_part", "_rank").toLocalIterator():
        before.setdefault(row["_part"], list(best))
        if len(best) < k or row["total_score"] > best[0]:
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, row["total_score"])

    def decide(key: tuple, part: pa.Table) -> pa.Table:
        heap = list(before[key[0].as_py()])
        heapq.heapify(heap)
        part = part.sort_by("seq")
        kept = list(_arrivals(heap, zip(part["seq"].to_pylist(), part["total_score"].to_pylist()), k))
        return pa.table({
            "seq": pa.array([row[0] for row in kept], pa.int64()), "total_score": pa.array([row[1] for row in kept], pa.float64()),
            "position": pa.array([row[2] for row in kept], pa.int32()),
        })

    return found.groupBy("_part").applyInArrow(decide, "seq long, total_score double, position int")
