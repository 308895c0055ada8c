"""Where rows lie: enough tasks for the parser, shared folders, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.sources import files

CHECKPOINT_DIR = "spark.checkpoint.dir"
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
TASK_ROWS = 100_000  # code rows that one task should parse at most
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Shuffle by a unique key, only if the input has fewer tasks than cores or too many rows in one.

    Small inputs often come as one file with one row group, which would leave
    all parsing to one task, and a few bytes of a large one can hold millions of
    rows. Inputs with enough splits of at most ``TASK_ROWS`` rows are left alone.
    Only for a plain scan, whose rows are counted without reading a column;
    call it before columns are made larger.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    sizes = scan.groupBy(F.spark_partition_id().alias("_split")).count()
    rows, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    enough = scan.rdd.getNumPartitions() >= cores and largest <= TASK_ROWS
    return scan if enough else scan.repartition(tasks_for(rows, cores), key)


def tasks_for(rows: int, least: int) -> int:
    """How many tasks parse that many rows, none more than about ``TASK_ROWS``; whole rounds of ``least``."""
    return least * max(1, -(-rows // (TASK_ROWS * least)))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, measured, are small enough.

    For tables whose size Spark cannot know, such as one made from local rows:
    a join would shuffle the other side by the few keys it has. A larger table
    comes back without a hint and joins by shuffle, with skewed keys split.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= MAX_BROADCAST_BYTES else df


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="codelens-")
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(folder)
    return folder


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the shared folders that were made within it.

    For steps whose results are written elsewhere: no frame that reads what they
    stored on their way may be used afterwards.
    """
    token = _made.set([])
    try:
        yield
    finally:
        for folder in _made.get():
            files.delete(spark, folder)
        _made.reset(token)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What jobs within it shuffled leaves the disks when they end, not when the driver collects its garbage.

    For large steps that are stored and run once: a frame that is run again shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored_once(df: DataFrame) -> DataFrame:
    """As ``settle``, in Parquet: for many or long rows, of which later uses read some columns."""
    path = shared_folder(df.sparkSession, "once")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """The rows of ``df``, stored once and read from there by every later use."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
