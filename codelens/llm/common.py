"""Helpers that the operators share: stored steps, row ids, running totals, bytes.

Tables between steps are written under ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a rerun of its tasks and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.plans.layout import shared_folder


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` once to the shared folder; later steps read it from there."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(docs: DataFrame) -> DataFrame:
    """``row``: all columns of ``docs`` as one struct; ``rid``: a number for each row.

    The struct keeps columns of any name apart from an operator's own. The
    number is only fixed once the result is stored.
    """
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*columns(docs)).alias("row"))


def columns(df: DataFrame) -> list:
    """All columns, also those whose names hold dots."""
    return [df[f"`{name}`"] for name in df.columns]


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deals out few but heavy rows by key. A fixed number of tasks keeps Spark from
    joining tasks whose rows look small."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def ordered_id(doc_id, *ties):
    """Sorts as ``doc_id`` does, null after all others; then by ``ties``."""
    return F.struct(doc_id.isNull().alias("unknown"), doc_id.alias("doc_id"), *ties)


def running_totals(rows: DataFrame, order: list[str], value: str, total: str) -> DataFrame:
    """``rows`` and, as ``total``, the sum of ``value`` over all rows before each.

    Rows are range-sorted, added up within each part, and stored; one row for
    each part then gives the parts' offsets. Their number is that of the tasks,
    which bounds the broadcast. Ties in ``order`` must not matter to the caller.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values) + seen
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(sums - values)],
                names=schema.names,
            )
            seen = int(sums[-1]) if len(sums) else seen

    placed = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema), "running")
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = parts.select(
        "_part", F.expr("coalesce(sum(_sum) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_base")
    )
    return placed.join(F.broadcast(offsets), "_part").withColumn(total, F.col("_base") + F.col("_before")).drop("_part", "_base", "_before")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each starts (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def spans(starts: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``limit`` bytes; a longer text is a run of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, where each row grows into something larger."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def field_of(batch: pa.RecordBatch, name: str, column: str = "row") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).field(name)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Lists with the given sizes out of flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Lookup:
    """Rows of one part at a time, from a table stored in a folder for each part."""

    def __init__(self, folder: str) -> None:
        self.folder, self.part, self.rows = folder, None, None

    def of(self, part: int) -> pa.Table | None:
        if part != self.part:
            from pyarrow import parquet
            from pyarrow.fs import FileSelector, FileSystem, FileType

            files, inner = FileSystem.from_uri(self.folder)
            where = f"{inner}/part={part}"
            self.part, self.rows = part, None
            if files.get_file_info(where).type == FileType.Directory:
                names = [x.path for x in files.get_file_info(FileSelector(where)) if x.base_name.startswith("part-")]
                self.rows = pa.concat_tables([parquet.ParquetFile(files.open_input_file(name)).read() for name in sorted(names)])
        return self.rows


def in_folders(rows: DataFrame, purpose: str) -> str:
    """Stores ``rows`` in one folder for each ``part``."""
    folder = shared_folder(rows.sparkSession, purpose)
    rows.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return folder
