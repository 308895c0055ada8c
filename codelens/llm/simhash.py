"""SimHash near-duplicates by a binary trie joined with itself.

A text's fingerprint has a bit set if more than half of its word shingles'
hashes have it. Two fingerprints link if at most ``budget`` bits differ. Of five
parts of the bits at least one is then equal, so fingerprints are dealt out by
part, and each part's groups are tries over the sorted fingerprints. Pairs of
nodes go down the trie together, add up the bits in which they differ, and are
dropped once they exceed the budget; small pairs of nodes are compared directly.
A group hands on only a forest of its links, so a dense group of n texts
gives fewer than n rows. Groups above ``GROUP`` fingerprints are dealt out again
by the parts of their other bits, until none is larger. Equal fingerprints are joined first, so
copies cost nothing here.

Null and empty texts have the fingerprint zero and are linked like any other.
Texts of fewer words than a shingle are one shingle. Null ids are ignored for a
component's smallest id, unless it has no other. Repeated rows are rows of one
component. Texts may be long: shingles are hashed a block at a time. An empty
table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import columns, ordered_id, store
from codelens.llm.components import components

WORDS, BUDGET, SEED = 4, 4, 42
GROUP = 1 << 15
KEYS, PAIRS, LEAF = 1 << 18, 1 << 21, 64  # fingerprints, comparisons at a time; size of pairs compared directly


def simhash(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, size = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(first)
    for at in range(0, total, 255 << 6):
        block = np.array([hashed(joined[i:j], SEED) for i, j in zip(first[at : at + (255 << 6)], last[at : at + (255 << 6)])], np.uint64)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carried: list[str], words: int = WORDS) -> DataFrame:
    """Stored: ``rid``, ``row`` with the carried columns, ``fingerprint`` as a long."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*columns(docs.select(*[f"`{name}`" for name in carried]))).alias("row"), "text"
    )
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("fingerprint", T.LongType())])

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(text.as_py(), words) for text in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints)], names=schema.names)

    return store(rows.mapInArrow(hash_texts, schema), "fingerprints")


def trie_links(keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked keys, in blocks; each group ``keys[begin:end]`` is sorted and free of repeats.

    A node is a range of keys with equal leading bits. Pairs of nodes wait on a
    stack and are split bit by bit, so memory is bounded also for dense groups.
    """
    own = ends - begins > 1
    stack = [(63, begins[own], ends[own], begins[own], ends[own], np.zeros(own.sum(), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, cost = stack.pop()
        work = (a1 - a0) * (b1 - b0)
        small = (work <= LEAF) | (bit < 0)
        yield from _compare(keys, a0[small], a1[small], b0[small], b1[small], budget)
        a0, a1, b0, b1, cost = (x[~small] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            continue
        if len(a0) > PAIRS // 8:
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, cost))), (bit, *(x[half:] for x in (a0, a1, b0, b1, cost)))]
            continue
        low, high = int(min(a0.min(), b0.min())), int(max(a1.max(), b1.max()))
        ones = np.concatenate([[0], np.cumsum((keys[low:high] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = (end - (ones[end - low] - ones[begin - low]) for begin, end in ((a0, a1), (b0, b1)))
        same = a0 == b0
        children = [
            (a0, am, b0, bm, cost, np.ones(len(a0), bool)),
            (am, a1, bm, b1, cost, np.ones(len(a0), bool)),
            (a0, am, bm, b1, cost + 1, np.ones(len(a0), bool)),
            (am, a1, b0, bm, cost + 1, ~same),  # the mirror image of the one before, within one node
        ]
        joined = [np.concatenate(column) for column in zip(*children)]
        c0, c1, d0, d1, spent, wanted = joined
        alive = wanted & (spent <= budget) & (c1 > c0) & (d1 > d0) & ((c0 != d0) | (c1 - c0 > 1))
        stack.append((bit - 1, c0[alive], c1[alive], d0[alive], d1[alive], spent[alive]))


def _compare(keys, a0, a1, b0, b1, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    work = (a1 - a0) * (b1 - b0)
    total = np.cumsum(work)
    at = 0
    while at < len(work):
        # At most PAIRS comparisons at a time; a pair of nodes at the last bit may have one key each only.
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        count = work[at:end]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(b1[at:end] - b0[at:end], count)
        i = np.repeat(a0[at:end], count) + nth // width
        j = np.repeat(b0[at:end], count) + nth % width
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & ((np.repeat(a0[at:end] != b0[at:end], count)) | (i < j))
        yield i[near], j[near]
        at = end


def forest(keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For each key the place of one key of its component within its group."""
    root = np.arange(len(keys))
    for i, j in trie_links(keys, begins, ends, budget):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, above := root[root]):
                root = above
    return root


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, budget: int) -> list[int]:
    """The masks that add one of budget + 1 parts of the other bits, of which one is equal if at most ``budget`` bits differ."""
    bits = [bit for bit in range(64) if not mask >> bit & 1]
    return [mask | sum(1 << bit for bit in part.tolist()) for part in np.array_split(bits, budget + 1)] if len(bits) > budget else []


def _dealt(prints: DataFrame, masks: set[int], budget: int) -> DataFrame:
    """``fingerprint, mask``, dealt out by each of the finer masks, with the masked ``value``."""
    spark, steps = prints.sparkSession, [(mask, child) for mask in sorted(masks) for child in finer(mask, budget)]
    table = spark.createDataFrame([(_signed(mask), _signed(child)) for mask, child in steps], "mask long, child long")
    return prints.join(F.broadcast(table), "mask").select(
        "fingerprint", F.col("child").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("child")).alias("value")
    )


def groups(prints: DataFrame, budget: int, group: int) -> DataFrame:
    """``mask, value, fingerprint``: groups in which any two linked fingerprints meet, none above ``group``."""
    group = max(group, 2 << budget)  # more than can differ in the last bits, so that a larger one can be split
    dealt = _dealt(prints.withColumn("mask", F.lit(0).cast("long")), {0}, budget)
    small = None
    while True:
        sizes = store(dealt.groupBy("mask", "value").count(), "group-sizes")
        heavy = sizes.filter(F.col("count") > group).select("mask", "value")
        again = {row["mask"] & (1 << 64) - 1 for row in heavy.select("mask").distinct().collect()}  # of few masks
        if not again:
            return dealt if small is None else small.unionByName(dealt)
        light = dealt.join(heavy, ["mask", "value"], "left_anti")
        small = light if small is None else small.unionByName(light)
        dealt = _dealt(dealt.join(heavy, ["mask", "value"], "left_semi").select("fingerprint", "mask"), again, budget)
        dealt = store(dealt.distinct(), "dealt-again")


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """A forest that joins what links join, from distinct ``fingerprint``: ``a, b``."""

    def join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(rows: np.ndarray) -> pa.RecordBatch:
            changes = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            begins = np.concatenate([[0], changes])
            keys = rows[:, 2].copy().view(np.uint64)
            order = np.lexsort((keys, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))))
            keys = keys[order]
            root = forest(keys, begins, np.append(begins[1:], len(rows)), budget)
            child = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(keys[child].view(np.int64)), pa.array(keys[root[child]].view(np.int64))], names=["a", "b"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(np.stack([column.to_numpy().astype(np.int64) for column in batch.columns], axis=1))
            size += len(waiting[-1])
            if size >= KEYS:  # all groups but the last are complete
                rows = np.concatenate(waiting)
                last = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield joined(rows[:cut])
                waiting, size = [rows[cut:]], len(rows) - cut
        if size:
            yield joined(np.concatenate(waiting))

    sorted_groups = groups(prints, budget, group).select("mask", "value", "fingerprint").repartition("mask", "value").sortWithinPartitions("mask", "value", "fingerprint")
    return sorted_groups.mapInArrow(join_tries, "a long, b long")


def classes(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """``rid, doc_id, fingerprint, component_id, kept`` of every row of ``fingerprints``."""
    rows = prints.select("rid", F.col("row.doc_id").alias("doc_id"), "fingerprint")
    distinct = store(rows.select("fingerprint").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, budget, group))
    rows = rows.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rows = store(rows.withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    groups = rows.groupBy("root").agg(F.min(ordered_id(F.col("doc_id"), F.col("rid"))).alias("first"), F.count("*").alias("n"))
    groups = store(groups.filter("n > 1").select("root", "first"), "groups")
    return rows.join(groups, "root", "left").select(
        "rid",
        "doc_id",
        "fingerprint",
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    prints = fingerprints(docs, docs.columns)
    kept = classes(prints.select("rid", F.struct("row.doc_id").alias("row"), "fingerprint")).filter("kept").select("rid")
    return prints.join(kept, "rid", "left_semi").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (hexadecimal), ``component_id`` of every row."""
    found = classes(fingerprints(docs, ["doc_id"]))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
