"""Benchmark decontamination by winnowing: DataFrame functions only.

Of every ``WINDOW - GRAM + 1`` neighbouring word grams of a text the one with
the smallest hash is its fingerprint, so any two texts that share ``WINDOW``
words in a row have a fingerprint in common, at the same place of what they
share. Documents' fingerprints meet the benchmark's; each hit is checked word by
word and extended to both sides, and counts if ``WINDOW`` words are equal.
Benchmark items of fewer words are looked up whole. Which words are hit and
which items occur is thus exact.

Documents are not shuffled. Where the benchmark's fingerprints and the words around
them are few bytes, they are broadcast and met in one pass over the documents. Where
they are more, only their keys are, as numbers, ``KEYS`` at a time and a pass for
each; the documents' fingerprints with such a key, a small part of all, are stored
with the words around them and joined by shuffle. Equal surroundings of different
items are one row. Only hits and one short row for each document are shuffled.

Null texts have no words, and no item occurs in them. Items without words never
occur; an item with a null id hits words but is not listed. Repeated rows are
separate documents; a repeated item id is listed once. Other columns are carried
along. A very long text is one row, as any other. Empty tables give no rows, or
documents without hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import numbered, store
from codelens.plans.layout import MAX_BROADCAST_BYTES

WINDOW, GRAM = 13, 8
REACH = WINDOW - GRAM
KEYS = 1 << 22
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HEADER = 0  # the window size under which every document gives its word count


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.size(values))


def _least(one: Column, other: Column) -> Column:
    return F.least(one, other)


def _paired(rows: DataFrame, by: int, kind) -> DataFrame:
    """Each value of ``marks`` joined with the value ``by`` places on; at the end, with null."""
    return rows.withColumn("marks", F.zip_with("marks", _shifted(F.col("marks"), by), kind))


def winnowed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``words``, and ``marks``: 32 bits of hash, 32 of place, of each fingerprint.

    A gram's hash is built from those of its halves, and the least of six from
    those of two and four. Incomplete grams at the end only add fingerprints.
    """
    rows = rows.withColumn("marks", F.transform("words", lambda word: F.xxhash64(word)))
    for by in (1, 2, 4):
        rows = _paired(rows, by, lambda left, right: F.xxhash64(left, right))
    rows = rows.withColumn("marks", F.transform("marks", lambda mark, at: F.shiftleft(mark, 32).bitwiseOR(at.cast("long"))))
    rows = _paired(rows, 1, _least)
    rows = rows.withColumn("fours", F.zip_with("marks", _shifted(F.col("marks"), 2), _least))
    rows = rows.withColumn("marks", F.zip_with("fours", _shifted(F.col("marks"), 4), _least)).drop("fours")
    return rows.withColumn("marks", F.array_distinct("marks"))


def _places(marks: Column) -> Column:
    return F.transform(
        marks,
        lambda mark: F.struct(
            F.lit(WINDOW).alias("size"),
            F.shiftright(mark, 32).alias("key"),
            mark.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"),
        ),
    )


def _whole(size: int) -> Column:
    """Places of all runs of ``size`` words, for items that have no more."""
    last = F.size("words") - size
    runs = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(
            F.lit(size).alias("size"), F.shiftright(F.xxhash64(F.slice("words", at + 1, F.lit(size))), 32).alias("key"), at.alias("at")
        ),
    )
    return runs


def _around(at: Column, size: Column) -> list[Column]:
    """The gram at a place, the words before it from the nearest on, and the words after it."""
    is_short = size < WINDOW
    begin = F.greatest(at - REACH, F.lit(0))
    return [
        F.slice("words", at + 1, F.when(is_short, size).otherwise(GRAM)).alias("gram"),
        F.when(is_short, F.array().cast("array<string>")).otherwise(F.reverse(F.slice("words", begin + 1, at - begin))).alias("left"),
        F.when(is_short, F.array().cast("array<string>")).otherwise(F.slice("words", at + GRAM + 1, F.lit(REACH))).alias("right"),
    ]


def benchmark_anchors(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: distinct surroundings of fingerprints with a number each, and the items that have them."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    long = winnowed(items.filter(F.size("words") >= WINDOW)).select("item_id", "words", F.inline(_places(F.col("marks"))))
    hashed = F.shiftright(F.xxhash64("words"), 32)
    short = items.filter(F.size("words") < WINDOW).select("item_id", "words", F.size("words").alias("size"), hashed.alias("key"), F.lit(0).alias("at"))
    anchors = long.unionByName(short).select("item_id", "size", "key", *_around(F.col("at"), F.col("size")))
    kinds = ["size", "key", "gram", "left", "right"]
    distinct = anchors.select(*kinds).distinct().withColumn("anchor", F.monotonically_increasing_id())
    distinct = store(distinct, "anchors")
    return distinct, store(anchors.filter("item_id IS NOT NULL").join(distinct, kinds).select("anchor", "item_id").distinct(), "anchor-items")


def _equal_run(one: str, other: str) -> Column:
    """How many words two lists have in common from their beginning on."""
    same = F.zip_with(one, other, lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def _fingerprints(rows: DataFrame, short_sizes: list[int], more: list[Column]) -> DataFrame:
    """``rid, doc_id, words, n_words, size, key, at`` of every fingerprint, whole run of a short size, and of ``more``."""
    cut = winnowed(rows.select("rid", F.col("row.doc_id").alias("doc_id"), words(F.col("row.text")).alias("words")))
    places = F.concat(*more, _places(F.col("marks")), *(_whole(size) for size in short_sizes))
    return cut.select("rid", "doc_id", "words", F.size("words").alias("n_words"), F.inline(places))


def _checked(met: DataFrame) -> DataFrame:
    """``rid, doc_id, n_words, start, stop, anchor`` of what has enough equal words, and of headers."""
    met = met.filter((F.col("size") == HEADER) | (F.col("gram") == F.col("gram2")))
    met = met.withColumns({"before": _equal_run("left", "left2"), "after": _equal_run("right", "right2")})
    met = met.filter((F.col("size") < WINDOW) | (F.col("before") + GRAM + F.col("after") >= WINDOW))
    return met.select(
        "rid",
        "doc_id",
        "n_words",
        (F.col("at") - F.col("before")).alias("start"),
        (F.col("at") + F.size("gram") + F.col("after")).alias("stop"),
        "anchor",
    )


def _in_one_pass(rows: DataFrame, known: DataFrame, short_sizes: list[int]) -> DataFrame:
    """Every checked hit, and a row without anchor for each document."""
    header = rows.sparkSession.range(1).selectExpr(
        f"{HEADER} AS size", "0L AS key", "array('') AS gram2", "array('') AS left2", "array('') AS right2", "CAST(NULL AS BIGINT) AS anchor"
    )
    mark = F.array(F.struct(F.lit(HEADER).alias("size"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("at")))
    met = _fingerprints(rows, short_sizes, [mark]).join(F.broadcast(known.unionByName(header)), ["size", "key"])
    return _checked(met.select("rid", "doc_id", "n_words", "anchor", "size", "at", "gram2", "left2", "right2", *_around(F.col("at"), F.col("size"))))


def _by_keys(rows: DataFrame, known: DataFrame, short_sizes: list[int], n_keys: int) -> DataFrame:
    """The same, with no more than keys in memory."""
    rows = store(rows, "documents")  # read for each block of keys, with the same row numbers
    number = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 32) - 1))).alias("number")
    keys = store(known.select(number).distinct(), "keys")
    n_blocks = -(-keys.count() // n_keys)
    each = _fingerprints(rows, short_sizes, []).withColumn("number", number)
    candidates = None
    for block in range(n_blocks):
        own = keys.filter(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == block)
        met = each.join(F.broadcast(own), "number", "left_semi")
        met = store(met.select("rid", "doc_id", "n_words", "size", "key", "at", *_around(F.col("at"), F.col("size"))), "candidates")
        candidates = met if candidates is None else candidates.unionByName(met)
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("start", "int"), ("stop", "int"), ("anchor", "long"))]
    headers = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.size(words(F.col("row.text"))).alias("n_words"), *nothing)
    return headers.unionByName(_checked(candidates.join(known.hint("merge"), ["size", "key"])))


def contamination(rows: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, n_keys: int = KEYS) -> DataFrame:
    """``rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``numbered`` documents."""
    anchors, items = benchmark_anchors(benchmark)
    # At most twelve sizes, and the number of bytes: all that the driver gets.
    short_sizes = sorted(row.size for row in anchors.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    size = anchors.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    known = anchors.withColumnsRenamed({"gram": "gram2", "left": "left2", "right": "right2"})
    hits = _in_one_pass(rows, known, short_sizes) if size <= max_bytes else _by_keys(rows, known, short_sizes, n_keys)
    hits = store(hits, "hits")
    spans = hits.filter("anchor IS NOT NULL").select("rid", "start", "stop").distinct()
    reached = "max(stop) OVER (PARTITION BY rid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce("reached", F.lit(0))))
    n_hit = spans.withColumn("reached", F.expr(reached)).groupBy("rid").agg(F.sum(fresh).alias("n_hit"))
    listed = hits.filter("anchor IS NOT NULL").select("rid", "anchor").distinct().join(items, "anchor").select("rid", "item_id").distinct()
    listed = listed.groupBy("rid").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"),
    )
    documents = hits.filter("anchor IS NULL").select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    result = documents.join(n_hit, "rid", "left").join(listed, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return result.select(
        "rid",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of which a twentieth or more is benchmark text."""
    rows = store(numbered(docs), "documents")
    found = contamination(rows, benchmark).filter("contaminated").select("rid")
    return rows.join(found, "rid", "left_anti").select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What of the benchmark every document holds."""
    return contamination(numbered(docs.select("doc_id", "text")), benchmark).drop("rid")
