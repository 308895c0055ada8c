"""Sequences packed along a space-filling curve.

Each text is encoded once. Its token counts, hashed to ``BUCKETS`` dimensions
and damped by a logarithm, are projected to ``AXES`` random directions; the cell
they fall in has a place on the Hilbert curve. Texts are range-sorted by that
place, and their ids, each text's followed by the end id, form one long stream
in that order, cut every ``length`` ids. Neighbours in a sequence are thus
neighbours on the curve, and only the last sequence is padded.

Ids are those that the vocabulary's own library gives, so a text that quotes an
added token, such as ``<|endoftext|>``, has that token's id there.

Only narrow rows are sorted: running totals of the token counts give each text
its place in the stream; the ids move once, to be cut. Null text counts as empty
and is the end id alone. Texts on one place of the curve are ordered by id, null
first; repeated rows are packed each. Long texts cover many sequences. Only the named
columns are read, so others may have any names. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import few_rows, running_totals, spans, store
from codelens.llm.tokens import encode, id_kind, vocabulary

LENGTH, END = 2048, 1
PIECES = 4096  # handed on at a time
BUCKETS, AXES, BITS = 1024, 4, 12
DIRECTIONS = np.random.default_rng(2048).normal(size=(BUCKETS, AXES))


def project(ids: np.ndarray) -> np.ndarray:
    """A text's place in the unit cube: about uniform along each axis for unrelated texts."""
    if not len(ids):
        return np.full(AXES, 0.5)
    hashed = np.bincount((ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(22), minlength=BUCKETS)
    damped = np.log1p(hashed)
    return 1 / (1 + np.exp(-1.702 * (damped @ DIRECTIONS) / np.linalg.norm(damped)))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells, given as a row of coordinates each.

    By Skilling's transposition (AIP Conference Proceedings 707, 2004): undo the
    rotations from the highest bit down, Gray-decode, interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        top, below = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for axis in range(n):
            is_set = (x[axis] & top) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(is_set, below, np.uint64(0)) ^ swap
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[n - 1] & np.uint64(1 << bit), np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << np.uint64(1)) | ((x[axis] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Stored: ``rid, doc_id, curve, n_tokens, ids`` (of ``id_kind``, with the end id)."""
    kind = id_kind(path, end)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("curve", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            ids = [np.append(encode(text.as_py() or "", path, added=True), end).astype(kind) for text in batch.column(2)]
            places = np.array([project(own[:-1]) for own in ids]).reshape(len(ids), AXES)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(hilbert(np.minimum((places * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))),
                    pa.array([len(own) for own in ids], pa.int64()),
                    pa.array([own.tobytes() for own in ids], pa.binary()),
                ],
                names=schema.names,
            )

    return store(rows.mapInArrow(encode_texts, schema), "encoded")


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, end: int = END) -> DataFrame:
    """Every piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A sequence is its
    pieces in the order of their offsets.
    """
    path = path or vocabulary()
    kind = id_kind(path, end)
    texts = encoded(docs, path, end)
    places = running_totals(texts.select("rid", "curve", "doc_id", "n_tokens"), ["curve", "doc_id", "rid"], "n_tokens", "place")
    rows = texts.select("rid", "doc_id", "n_tokens", "ids").join(places.select("rid", "place"), "rid")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, place = (batch.column(at).to_numpy() for at in (2, 4))
        sequence = place // length
        counts = (place + size - 1) // length - sequence + 1
        doc = np.repeat(np.arange(len(size)), counts)
        sequence = np.repeat(sequence, counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.maximum(sequence * length, place[doc])
        stop = np.minimum((sequence + 1) * length, (place + size)[doc])
        ids = np.frombuffer(b"".join(batch.column(3).to_pylist()), kind)  # a text's pieces are in its order
        edges = np.concatenate([[0], np.cumsum(stop - begin)])
        for first in range(0, len(doc), PIECES):
            own = slice(first, min(first + PIECES, len(doc)))
            at = edges[own.start : own.stop + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(doc[own])),
                    pa.array((begin - place[doc])[own]),
                    pa.array((stop - begin)[own]),
                    pa.Array.from_buffers(pa.binary(), own.stop - own.start, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(ids[at[0] : at[-1]].astype("<u4"))]),
                    pa.array(size[doc[own]]),
                    pa.array(sequence[own]),
                    pa.array((begin - sequence * length)[own]),
                ],
                names=names,
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])
            for first, last in spans(starts):
                yield from pieces(batch.slice(first, last - first))

    return rows.mapInArrow(cut, schema)


def report(docs: DataFrame) -> DataFrame:
    """Every piece with the checksum of its ids instead of the ids."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
