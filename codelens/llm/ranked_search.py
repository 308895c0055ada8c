"""Ranked lexical search by sequential reads of impact-sorted lists.

``indexed`` counts the terms of each whole text once; the stored counts serve any
queries. A term's weight and a document's length factor come from counts over all
documents. ``search`` reads the index in blocks of documents. In a block, each
query term has a list of (document, impact) with the highest impacts first, and
the lists of a query are read from the top in steps, never by document:

- a document's score is at least the sum of what was read of it, and at most that
  plus, for each list it was not yet seen in, the last impact read there;
- the k-th highest lower bound, here or among the documents of earlier blocks of
  the task, is the score to reach;
- reading goes on until every document that could reach it, one that was not seen
  at all included, has equal bounds. So membership, ties and scores are exact. A
  list that all such documents were seen in is not read further.

What moves are ``k`` rows for each query and task; a frequent term's list lies in
as many pieces as there are blocks. Queries are taken in blocks of ``BLOCK`` terms,
which bounds what the driver sends out; each block reads the index, not the texts.

Null and empty texts have no terms: as documents they only lack in the counts, as
queries they find nothing. Long texts are counted in pieces. Each row is a document
of its own, also one that repeats an id or has none; equal scores are ordered by
id, null last. A query with a repeated or null id is answered for each row. Only
the named columns are read, so others may have any names. An empty table, of
documents or of queries, gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.best import first_rows
from codelens.llm.common import lists, spans, store, utf8
from codelens.plans.layout import broadcast_if_small

K = 10
BLOCK = 1 << 18
PIECE = 1 << 20
FIRST, FASTER = 64, 4  # entries of each list read in the first step; each later step goes so many times as deep
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
FOUND = "number long, doc_id long, score long, part int"


def count_terms(text: bytes) -> Counter:
    """Occurrences of each term, lower-cased from A to Z only; a long text is cut between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        found.update(TERM.findall(text[at:end].lower()))
        at = end
    return found


def indexed(rows: DataFrame) -> DataFrame:
    """Stored: all columns but the last, which is the text, and ``n_terms, terms, counts``."""
    counted = [T.StructField("n_terms", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([*rows.schema.fields[:-1], *counted])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(batch.num_columns - 1))
            for first, last in spans(starts):
                found = [count_terms(data[starts[at] : starts[at + 1]].tobytes()) for at in range(first, last)]
                sizes = np.array([len(own) for own in found], np.int64)
                terms = pa.array([term for own in found for term in own], pa.binary()).cast(pa.string())
                counts = np.array([n for own in found for n in own.values()], np.int64)
                kept = [column.slice(first, last - first) for column in batch.columns[:-1]]
                totals = pa.array([own.total() for own in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, totals, lists(terms, sizes), lists(pa.array(counts), sizes)], names=schema.names)

    return store(rows.mapInArrow(count, schema), "terms")


def length_factors(n_terms: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``25 + (75 * n * N) div L``, also where the product leaves 64 bits."""
    if not len(n_terms) or int(n_terms.max()) * 75 * documents < 1 << 63:
        return 25 + 75 * n_terms * documents // terms
    return np.array([25 + 75 * int(n) * documents // terms for n in n_terms], np.int64)


class Lists:
    """The impact-sorted lists of a block of documents, one after the other."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, doc_ids: np.ndarray, known: np.ndarray):
        order = np.lexsort((-impacts, terms))
        self.docs, self.impacts, self.doc_ids, self.known = docs[order], impacts[order], doc_ids, known
        self.sizes = np.bincount(terms, minlength=n_terms)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple) -> tuple:
        """The first ``k`` of ``best``, (scores, ids, known ids) of earlier blocks, and of this block."""
        has = (self.sizes[terms] > 0) & (weights > 0)
        starts, sizes, weights = self.starts[terms[has]], self.sizes[terms[has]], weights[has]
        if not len(starts):
            return best
        lower = np.zeros(len(self.doc_ids), np.int64)
        frontier = weights * self.impacts[starts]
        read, depth = np.zeros(len(starts), np.int64), FIRST
        seen_docs, seen_lists = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach, upper = best[0][k - 1] if len(best[0]) >= k else 1, None
        wanted = np.full(len(starts), frontier.sum() >= reach)
        while wanted.any():
            until = np.where(wanted, np.minimum(sizes, depth), read)
            step = until - read
            which = np.repeat(np.arange(len(step)), step)
            at = np.arange(len(which)) + np.repeat(starts + read - (np.cumsum(step) - step), step)
            np.add.at(lower, self.docs[at], weights[which] * self.impacts[at])
            seen_docs, seen_lists = np.concatenate([seen_docs, self.docs[at]]), np.concatenate([seen_lists, which])
            read, depth = until, depth * FASTER
            frontier = np.where(read < sizes, weights * self.impacts[starts + np.maximum(read, 1) - 1], 0)
            upper = lower + frontier.sum()
            np.subtract.at(upper, seen_docs, frontier[seen_lists])
            scores = np.concatenate([best[0], lower[lower > 0]])
            if len(scores) >= k:
                reach = np.partition(scores, len(scores) - k)[len(scores) - k]
            unsure = (upper > lower) & (upper >= reach)
            seen_by = np.bincount(seen_lists[unsure[seen_docs]], minlength=len(starts))
            wanted = (frontier > 0) & (seen_by < unsure.sum())
        if upper is None:
            return best
        exact = np.flatnonzero((lower == upper) & (lower >= reach))
        return first_of(np.concatenate([best[0], lower[exact]]), np.concatenate([best[1], self.doc_ids[exact]]), np.concatenate([best[2], self.known[exact]]), k)


def first_of(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> tuple:
    order = np.lexsort((ids, ~known, -scores))[:k]
    return scores[order], ids[order], known[order]


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Queries with about ``BLOCK`` terms at a time."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // BLOCK)
    for block in range(n):
        yield items.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("number"), F.lit(n)) == block)).collect()


def _searched(index: DataFrame, items: list[Row], documents: int, terms: int, k: int) -> DataFrame:
    vocabulary = sorted({term for item in items for term in item["terms"]})
    number = {term: at for at, term in enumerate(vocabulary)}
    weight = {term: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for item in items for term, df in zip(item["terms"], item["dfs"])}
    queries = [
        (item["number"], np.array([number[term] for term in item["terms"]]), np.array([n * weight[term] for term, n in zip(item["terms"], item["counts"])], np.int64))
        for item in items
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best, values = {}, pa.array(vocabulary, pa.string())
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for first, last in spans(starts):
                own = batch.slice(first, last - first)
                at = pc.index_in(own.column(2).flatten(), value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
                docs = np.repeat(np.arange(last - first), sizes[first:last])
                counts = own.column(3).flatten().to_numpy()
                wanted = at >= 0
                at, docs, counts = at[wanted], docs[wanted], counts[wanted]
                factors = length_factors(own.column(1).to_numpy(), documents, terms)
                ids = own.column(0)
                block = Lists(
                    at, docs, 1_000_000_000 * counts // (1000 * counts + 8 * factors[docs]), len(vocabulary),
                    ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False),
                )
                for query, own_terms, weights in queries:
                    best[query] = block.search(own_terms, weights, k, best.get(query, none))
        part = TaskContext.get().partitionId()
        for query, (scores, ids, known) in best.items():
            columns = [np.full(len(scores), query), pa.array(ids, mask=~known), scores, np.full(len(scores), part, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["number", "doc_id", "score", "part"])

    return store(index.mapInArrow(read, FOUND), "found")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query, best first."""
    index = indexed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter("n_terms > 0")
    documents, terms = index.agg(F.count("*"), F.sum("n_terms")).first()
    queries = indexed(items.select(F.monotonically_increasing_id().alias("number"), "item_id", "text"))
    asked = queries.select("number", F.explode(F.arrays_zip("terms", "counts")).alias("entry")).select("number", "entry.*")
    vocabulary = broadcast_if_small(asked.select(F.col("terms").alias("term")).distinct())
    dfs = index.select(F.explode("terms").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    met = asked.join(dfs, asked["terms"] == dfs["term"])
    grouped = met.groupBy("number").agg(F.collect_list(F.struct("term", "counts", "df")).alias("entries"))
    ready = store(grouped.select("number", *(F.col(f"entries.{name}").alias(alias) for name, alias in (("term", "terms"), ("counts", "counts"), ("df", "dfs")))), "queries")
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in _blocks(ready):
        found = found.union(_searched(index, block, documents, terms, k))
    best = first_rows(found, ["number"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "part")
    return best.join(queries.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
