"""Exact dedup by content-defined chunk recipes.

Each text is normalised (every run of blanks becomes one space) and cut where a
rolling hash of its last 32 bytes says so. A chunk's identifier is its hash and
size, verified: all bytes behind one identifier are compared, and if they differ
each variant gets its own number. Two texts are equal if and only if their
ordered identifier lists are equal, so whole texts are not compared or moved
again; every chunk moves once, after equal chunks of a task were merged.

Null text counts as empty, and all empty texts are equal. A null ``doc_id``
ranks after all others. Rows repeated with one ``doc_id`` are separate rows of
a group: one stays. Other columns are carried along untouched. A text may be as
long as Spark allows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import field_of, lists, numbered, ordered_id, spans, store, utf8

BLANKS_TO_SPACE = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
SPACES = re.compile(rb" {2,}")
WINDOW, LEAST, MOST, MASK = 32, 256, 8192, (1 << 10) - 1
MIX = np.array([xxhash.xxh32_intdigest(bytes([byte])) for byte in range(256)], np.uint32)
CHUNK = T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType())])


def normalise(text: bytes) -> bytes:
    return SPACES.sub(b" ", text.translate(BLANKS_TO_SPACE))


def marks(data: np.ndarray) -> np.ndarray:
    """Places after which a cut may come: a rolling hash over 32 bytes has ten zero bits."""
    rolled, width = MIX[data], 1
    while width < WINDOW:
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width] << np.uint32(width)
        rolled, width = rolled + older, 2 * width
    return np.flatnonzero((rolled >> np.uint32(16)) & np.uint32(MASK) == 0) + 1


def chunk_ends(marked: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of one text; they depend on its own bytes alone."""
    ends, at = [], start
    while end - at > LEAST:
        found = int(np.searchsorted(marked, at + LEAST))
        cut = min(int(marked[found]) if found < len(marked) else end, at + MOST, end)
        ends.append(cut)
        at = cut
    if at < end:
        ends.append(end)
    return ends


def _normalised(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    data, starts = utf8(texts)
    whole = data.tobytes()
    for first, last in spans(starts):
        yield first, [normalise(whole[starts[at] : starts[at + 1]]) for at in range(first, last)]


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Stored: ``rid, row, text_sha256, recipe`` with the chunks' hashes and sizes."""
    rows = numbered(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.ArrayType(CHUNK))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, keys, sizes = [], [], [], []
            for _, texts in _normalised(field_of(batch, "text")):
                joined = b"".join(texts)
                marked, at = marks(np.frombuffer(joined, np.uint8)), 0
                for text in texts:
                    ends = chunk_ends(marked, at, at + len(text))
                    for start, end in zip([at, *ends], ends):
                        keys.append(xxhash.xxh64_intdigest(joined[start:end]) >> (64 - hash_bits))
                        sizes.append(end - start)
                    counts.append(len(ends))
                    digests.append(hashlib.sha256(text).hexdigest())
                    at += len(text)
            flat = pa.StructArray.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32))], names=["key", "size"]
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.string()), lists(flat, np.array(counts, np.int64))], names=schema.names
            )

    return store(rows.mapInArrow(cut, schema), "recipes")


def chunks(cut: DataFrame) -> DataFrame:
    """Each chunk of each row with its bytes: ``rid, at, key, size, bytes``."""
    schema = "rid long, at int, key long, size int, bytes binary"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, recipe = batch.column(0).to_numpy(), batch.column(2)
            for first, texts in _normalised(batch.column(1)):
                own = recipe.slice(first, len(texts))
                counts, flat = np.diff(own.offsets.to_numpy()), own.flatten()
                sizes = flat.field(1).to_numpy()
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                pieces = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(b"".join(texts))])
                at = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rids[first : first + len(texts)], counts)), pa.array(at.astype(np.int32)), flat.field(0), flat.field(1), pieces],
                    names=["rid", "at", "key", "size", "bytes"],
                )

    return cut.select("rid", F.col("row.text").alias("text"), "recipe").mapInArrow(slices, schema)


def identified(cut: DataFrame) -> DataFrame:
    """``cut`` and ``ids``: its recipe with verified identifiers (hash, size, variant)."""
    pieces = chunks(cut)
    seen = pieces.groupBy("key", "size").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    clashes = store(seen.filter("least <> most").select("key", "size"), "clashes")
    plain = F.transform("recipe", lambda chunk: F.struct(chunk.key.alias("key"), chunk.size.alias("size"), F.lit(0).alias("variant")))
    if clashes.isEmpty():  # as nearly always: every identifier stands for one content
        return cut.withColumn("ids", plain)
    clashing = pieces.join(clashes, ["key", "size"])
    kinds = clashing.select("key", "size", "bytes").distinct()
    variants = kinds.withColumn("variant", F.expr("row_number() OVER (PARTITION BY key, size ORDER BY bytes)"))
    own = clashing.join(variants, ["key", "size", "bytes"]).groupBy("rid").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "variant"))).alias("_variants")
    )
    numbered_ids = F.transform(
        "recipe",
        lambda chunk, at: F.struct(
            chunk.key.alias("key"), chunk.size.alias("size"), F.coalesce(F.element_at("_variants", at), F.lit(0)).alias("variant")
        ),
    )
    return cut.join(own, "rid", "left").withColumn("ids", numbered_ids).drop("_variants")


def decisions(cut: DataFrame) -> DataFrame:
    """One row for each row: ``rid, doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = identified(cut.select("rid", F.struct("row.doc_id", "row.text").alias("row"), "text_sha256", "recipe"))
    rows = rows.select("rid", F.col("row.doc_id").alias("doc_id"), "text_sha256", "ids")
    groups = rows.groupBy("ids").agg(F.min(ordered_id(F.col("doc_id"), F.col("rid"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = store(groups, "groups")  # so that the join shuffles both sides and can split a large group
    return rows.join(groups, "ids", "left").select(
        "rid",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest ``doc_id`` of each equal text."""
    cut = recipes(docs)
    kept = decisions(cut).filter("kept").select("rid")
    return cut.join(kept, "rid", "left_semi").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """What happens to every row, dropped ones too."""
    return decisions(recipes(docs.select("doc_id", "text"))).drop("rid")
