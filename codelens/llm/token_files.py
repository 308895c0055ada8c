"""Token counts from flat token files that have no index.

``write_token_files`` makes such files: the ids of one text after another, each
followed by the end-of-document id, as little-endian unsigned numbers of 16 bits, or
of 32 where the vocabulary has more ids.
``scan`` reads fixed-size blocks in parallel, finds the separators of each block
at once, and stitches texts that cross blocks: a prefix scan over the blocks'
counts numbers the separators, and the block whose count ends where another's
begins has the end before it. Long files are read in parts, and a text may cross
any number of blocks.

Null text counts as empty: no ids and a separator. Rows repeated are counted
each. A last text without separator counts, with ``terminated`` false. Texts
that hold the separator's name are encoded as ordinary text, so the separator
comes from ends of texts only. Only the named columns are read, so others may have
any names. An empty table gives no files and no rows.
Files are named by attempt and count only if their task's rows were stored, so
a lost executor leaves nothing but an unused file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import running_totals, spread_out, store
from codelens.llm.tokens import encode, id_kind, vocabulary
from codelens.plans.layout import shared_folder

END = 50256  # free in the rank file, so no text has it
BLOCK_TOKENS = 1 << 21


def write_token_files(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Writes one file for each task; ``file, file_no, ordinal, doc_id`` of every text in it."""
    folder, kind = shared_folder(docs.sparkSession, "token-files"), id_kind(path, end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        part, files, out, done = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, inner = FileSystem.from_uri(folder)
                files.create_dir(inner, recursive=True)
                name = f"{part:05d}-{uuid.uuid4().hex}.tokens"
                out = files.open_output_stream(f"{inner}/{name}")
            for text in batch.column(1):
                ids = encode(text.as_py() or "", path)
                out.write(np.append(ids, end).astype(kind).tobytes())
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{name}"] * count),
                    pa.array(np.full(count, part, np.int64)),
                    pa.array(np.arange(done, done + count)),
                    batch.column(0),
                ],
                names=["file", "file_no", "ordinal", "doc_id"],
            )
            done += count
        if out is not None:
            out.close()

    schema = "file string, file_no long, ordinal long, doc_id long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(write, schema), "token-file-rows")


def _blocks(files: DataFrame, block_tokens: int, kind: np.dtype) -> DataFrame:
    """``file, block, n_tokens`` (of the whole file), one row for each block."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store_of, inner = FileSystem.from_uri(uri)
                n_tokens = store_of.get_file_info(inner).size // kind.itemsize
                blocks = np.arange(-(-n_tokens // block_tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(blocks), pa.string()), pa.array(blocks), pa.array(np.full(len(blocks), n_tokens, np.int64))],
                    names=["file", "block", "n_tokens"],
                )

    return files.mapInArrow(sizes, "file string, block long, n_tokens long")


def scan(files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS, kind: np.dtype = np.dtype("<u2")) -> DataFrame:
    """``file, ordinal, start, n_tokens, terminated`` of every text in the files of column ``file``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for uri, block, n_tokens in zip(*(column.to_pylist() for column in batch.columns)):
                store_of, inner = FileSystem.from_uri(uri)
                first = block * block_tokens
                count = min(block_tokens, n_tokens - first)
                with store_of.open_input_file(inner) as file:
                    ids = np.frombuffer(file.read_at(count * kind.itemsize, first * kind.itemsize), kind)
                ends = np.flatnonzero(ids == end) + first
                is_open = bool(first + count == n_tokens and ids[-1] != end)
                ends = np.append(ends, n_tokens) if is_open else ends
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([block]), pa.array([is_open]), pa.array([len(ends)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "is_open", "n_ends", "ends"],
                )

    blocks = _blocks(files.select("file").distinct(), block_tokens, kind)
    found = store(spread_out(blocks, "file", "block").mapInArrow(search, "file string, block long, is_open boolean, n_ends long, ends array<long>"), "separators")
    # Blocks without a separator are part of a text; the numbers pass over them.
    counts = running_totals(found.select("file", "block", "n_ends"), ["file", "block"], "n_ends", "before")
    counts = store(counts, "separator-counts")
    at = counts.filter("n_ends > 0").select("file", "block", "before").join(found.filter("n_ends > 0"), ["file", "block"])
    ahead = at.select(
        F.col("file").alias("_file"), (F.col("before") + F.col("n_ends")).alias("before"), F.element_at("ends", -1).alias("_end")
    )
    bases = counts.filter("block = 0").select("file", F.col("before").alias("_base"))
    stitched = at.join(ahead, "before", "left").join(bases, "file").select(
        "file",
        "is_open",
        "ends",
        (F.col("before") - F.col("_base")).alias("first"),
        F.when(F.col("_file") == F.col("file"), F.col("_end") + 1).otherwise(0).alias("begin"),
    )
    each = stitched.select("file", "is_open", "ends", "first", "begin", F.posexplode("ends").alias("at", "stop"))
    start = F.when(F.col("at") == 0, F.col("begin")).otherwise(F.try_element_at("ends", F.greatest("at", F.lit(1))) + 1)
    return each.select(
        "file",
        (F.col("first") + F.col("at")).alias("ordinal"),
        start.alias("start"),
        (F.col("stop") - start).alias("n_tokens"),
        (~F.col("is_open") | (F.col("at") < F.size("ends") - 1)).alias("terminated"),
    )


def token_counts(docs: DataFrame, path: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, file_no, ordinal, start``: counted by scanning the files, not while encoding."""
    path = path or vocabulary()
    written = write_token_files(docs, path, end)
    # The rows of all documents take few bytes in files, many in memory: they must not look small enough to broadcast.
    return scan(written, end, block_tokens, id_kind(path, end)).join(written.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file_no", "ordinal", "start")
