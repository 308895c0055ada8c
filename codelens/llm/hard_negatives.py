"""Hard negatives by a vertical scan of vectors.

The rows that take part are stored in blocks, turned on their side: for each block
one run of values for each dimension, with the least and the most of it, rows sorted
by label. For an anchor, a block's dimensions are read in descending order of the
anchor's own magnitude. What the unread dimensions can still add lies between the
sums of their least and most contributions, so each row's score lies in an interval,
and after every few dimensions the bitmap of candidates shrinks:

- for positives (rows of the anchor's label) to rows that can still reach the k-th
  best lower bound;
- for negatives (other labels) to rows that can still lie in a positive's window of
  scores and reach the k-th best of the rows that lie in it for certain.

Rows left at the end have exact scores. A task carries what it has found from block
to block, so later blocks are pruned by earlier ones, and hands on ``k`` rows for
each anchor (and positive). Positives are complete before negatives are looked for,
as windows come from their scores. Anchors are a stated set against all rows, taken
in blocks of ``ANCHOR_BYTES`` of components; a hot label lies in many blocks.

A component ``x`` counts as ``floor(256 * x)``; scores are integer inner products.
Rows with a null label or vector, or a null or non-finite component, take no part.
Components too large for sums in 64 bits are an error. A shorter vector counts as
continued by zeros. Each row is its own, also one that repeats an id: such rows are
one another's candidates, and each anchor row is answered. Equal scores are ordered by
id, null last. Only the named columns are read, so others may have any names. An empty
table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codelens.llm.best import first_rows
from codelens.llm.common import spread_out, store

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # hundredths of the positive's score
BLOCK_ROWS, ANCHOR_BYTES = 8192, 1 << 23
#: Shares of the dimensions after which the bitmap is made anew.
STOPS = (0.5, 0.625, 0.75, 0.875, 1.0)

BLOCKS = "rids binary, ids binary, known binary, labels array<string>, ends array<int>, least array<bigint>, most array<bigint>, dims array<binary>"
FOUND = "anchor long, positive long, rid long, id long, score long, part int"


def participants(vectors: DataFrame, anchor: Column) -> DataFrame:
    """Stored: ``rid, id, label, vector, is_anchor`` of the rows that take part, components as whole numbers."""
    component = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  not true of NaN, which is above all
    whole = F.transform("vector", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return store(
        vectors.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", component)).select(
            F.monotonically_increasing_id().alias("rid"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
            whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )


def matrix(vectors: list, dims: int) -> np.ndarray:
    """One row for each vector."""
    out = np.zeros((len(vectors), dims), np.int64)
    for line, vector in zip(out, vectors):
        line[: len(vector)] = vector
    largest = max(int(out.max(initial=0)), -int(out.min(initial=0)))
    if dims * largest * largest >= 1 << 62:
        raise ValueError(f"components up to {largest} / 256 in {dims} dimensions leave 64 bits")
    return out


def turned(rows: DataFrame, dims: int) -> DataFrame:
    """Stored: blocks of rows, turned on their side."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(first, BLOCK_ROWS)
                values = matrix([vector.values.to_numpy() for vector in own.column(3)], dims)
                labels, codes = np.unique(np.array(own.column(2).to_pylist(), object), return_inverse=True)
                order = np.argsort(codes, kind="stable")
                values, ids = np.ascontiguousarray(values[order].T), own.column(1).take(pa.array(order))
                row = {
                    "rids": own.column(0).to_numpy()[order].tobytes(), "ids": ids.fill_null(0).to_numpy().tobytes(),
                    "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "labels": labels.tolist(),
                    "ends": np.cumsum(np.bincount(codes)).tolist(), "least": values.min(axis=1).tolist(), "most": values.max(axis=1).tolist(),
                    "dims": [line.tobytes() for line in values],
                }
                columns = [pa.array([value], kind) for value, kind in zip(row.values(), (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())))]
                yield pa.RecordBatch.from_arrays(columns, names=list(row))

    return store(rows.mapInArrow(turn, BLOCKS), "turned")


class Block:
    """Rows whose dimensions are read one after the other."""

    def __init__(self, row: dict):
        self.rids, self.ids = (np.frombuffer(row[name], np.int64) for name in ("rids", "ids"))
        self.known = np.frombuffer(row["known"], bool)
        self.dims = [np.frombuffer(line, np.int64) for line in row["dims"]]
        self.least, self.most = (np.array(row[name], np.int64) for name in ("least", "most"))
        self.spans = {label: (first, end) for label, first, end in zip(row["labels"], [0, *row["ends"]], row["ends"])}

    def labelled(self, label: str) -> np.ndarray:
        """The bitmap of the rows with that label."""
        bitmap = np.zeros(len(self.rids), bool)
        bitmap[slice(*self.spans.get(label, (0, 0)))] = True
        return bitmap

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, left: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``left(lower, upper)`` leaves in the bitmap, and their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, other = anchor[order] * self.least[order], anchor[order] * self.most[order]
        # What the dimensions from each place on can add at least and at most.
        rest = [np.concatenate([np.cumsum(side[::-1])[::-1], [0]]) for side in (np.minimum(one, other), np.maximum(one, other))]
        rows, done = np.flatnonzero(bitmap), 0
        scores = np.zeros(len(rows), np.int64)
        for stop in [round(share * len(order)) for share in STOPS]:
            for at in order[done:stop]:
                scores += anchor[at] * (self.dims[at] if len(rows) == len(bitmap) else self.dims[at][rows])
            done = stop
            kept = left(scores + rest[0][done], scores + rest[1][done])
            rows, scores = rows[kept], scores[kept]
            if not len(rows):
                break
        return rows, scores


def reach(scores: np.ndarray, k: int) -> int | None:
    """The ``k``-th highest score, if there are so many."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


class Best:
    """The first ``k`` rows so far, by score, then id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known, self.rids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def take(self, block: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, block.ids[rows]])
        known, rids = np.concatenate([self.known, block.known[rows]]), np.concatenate([self.rids, block.rids[rows]])
        order = np.lexsort((rids, ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known, self.rids = scores[order], ids[order], known[order], rids[order]

    def rows(self, anchor: int, positive: int, part: int) -> pa.RecordBatch:
        n = len(self.scores)
        columns = [np.full(n, anchor), np.full(n, positive), self.rids, pa.array(self.ids, mask=~self.known), self.scores, np.full(n, part, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["anchor", "positive", "rid", "id", "score", "part"])


def _over_blocks(blocks: DataFrame, visit: Callable[[Block, dict], None]) -> DataFrame:
    """What ``visit`` has found in the blocks of each task, by (anchor, positive)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                visit(Block(batch.slice(at, 1).to_pylist()[0]), best)
        for (anchor, positive), found in best.items():
            yield found.rows(anchor, positive, TaskContext.get().partitionId())

    return blocks.mapInArrow(read, FOUND)


def _positives(blocks: DataFrame, anchors: list[Row], dims: int, k: int) -> DataFrame:
    asked = [(row["rid"], row["label"], vector) for row, vector in zip(anchors, matrix([row["vector"] for row in anchors], dims))]

    def visit(block: Block, best: dict) -> None:
        for rid, label, vector in asked:
            if label in block.spans:
                own = best.setdefault((rid, rid), Best(k))

                def left(lower: np.ndarray, upper: np.ndarray, own: Best = own) -> np.ndarray:
                    least = reach(np.concatenate([own.scores, lower]), k)
                    return upper >= least if least is not None else np.ones(len(upper), bool)

                own.take(block, *block.scan(vector, block.labelled(label) & (block.rids != rid), left))

    return _over_blocks(blocks, visit)


def _negatives(blocks: DataFrame, anchors: list[Row], dims: int, k: int, low: int, high: int) -> DataFrame:
    # A window holds whole numbers from the first, rounded up, to the last, rounded down.
    asked = [
        (row["rid"], row["label"], vector, [(p["rid"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in row["positives"]])
        for row, vector in zip(anchors, matrix([row["vector"] for row in anchors], dims))
    ]

    def visit(block: Block, best: dict) -> None:
        for rid, label, vector, all_windows in asked:
            windows = [(best.setdefault((rid, positive), Best(k)), first, last) for positive, first, last in all_windows if first <= last]

            def left(lower: np.ndarray, upper: np.ndarray, windows: list = windows) -> np.ndarray:
                bitmap = np.zeros(len(lower), bool)
                for own, first, last in windows:
                    inside = (lower >= first) & (upper <= last)
                    least = reach(np.concatenate([own.scores, lower[inside]]), k)
                    bitmap |= (upper >= (first if least is None else max(first, least))) & (lower <= last)
                return bitmap

            if windows:
                rows, scores = block.scan(vector, ~block.labelled(label), left)
                for own, first, last in windows:
                    inside = (scores >= first) & (scores <= last)
                    own.take(block, rows[inside], scores[inside])

    return _over_blocks(blocks, visit)


def hard_negatives(
    vectors: DataFrame, anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels within the window.

    ``vectors`` has ``id``, ``label`` and ``vector``; ``anchor`` says which rows are
    anchors. Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    rows = participants(vectors, anchor)
    dims, n_anchors = rows.agg(F.max(F.size("vector")), F.count_if("is_anchor")).first()
    found = vectors.sparkSession.createDataFrame([], f"{FOUND}, positive_id long, positive_score long")
    if n_anchors:
        blocks = store(spread_out(turned(rows.drop("is_anchor"), dims), "rids"), "blocks")
        n = -(-n_anchors * 8 * max(dims, 1) // ANCHOR_BYTES)
        order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]
        for block in range(n):
            own = rows.filter(F.col("is_anchor") & (F.pmod(F.xxhash64("rid"), F.lit(n)) == block)).select("rid", "label", "vector").collect()
            positives = store(first_rows(_positives(blocks, own, dims, n_positives), ["anchor"], order, n_positives, "part"), "positives")
            scores = {}
            for p in positives.select("anchor", "rid", "score").collect():  # at most n_positives for each anchor of the block
                scores.setdefault(p["anchor"], []).append(p)
            asked = [Row(**row.asDict(), positives=scores[row["rid"]]) for row in own if row["rid"] in scores]
            negatives = store(_negatives(blocks, asked, dims, n_negatives, low, high), "negatives")
            matched = positives.select("anchor", F.col("rid").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            found = found.unionByName(negatives.join(matched, ["anchor", "positive"]))
        ranked = first_rows(found, ["anchor", "positive"], order, n_negatives, "part")
    else:
        ranked = found.withColumn("rank", F.lit(1))
    return ranked.join(rows.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def report(embeddings: DataFrame) -> DataFrame:
    """Anchors are rows whose ``vec_id`` is divisible by 100; labels of every seventh are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(vectors, F.col("id") % 100 == 0)
