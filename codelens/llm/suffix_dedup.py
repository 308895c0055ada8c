"""Repeated substrings removed by longest-previous-factor arrays.

A byte goes if some ``length`` bytes around it also start earlier: in an earlier
document, or earlier in its own. To bring equal strings together without a row
for every byte, each string of ``length`` bytes is told by its anchor, the gram
of ``GRAM`` bytes in it whose hash is least. Equal strings have equal anchors.

1. Anchors that occur once in the corpus are settled; for the others, the bytes
   of all strings with that anchor, one segment, go to the anchor's group.
2. Of equal segments all but the first are repeats as a whole.
3. In a group, the strings that start in the remaining segments are sorted as
   truncated suffixes. Of each, the nearest in suffix order to either side with
   a smaller position give its longest previous factor; it repeats if that has
   ``length`` bytes.
4. Spans found are united for each document and cut out.

Texts are read three times and never shuffled. Rows are numbered in stored parts
as large as a task's input, and what a part needs to know (its repeated anchors,
its spans) is written beside it, one folder for each part, which tasks look up.
Equal segments of a batch are one row. An anchor with more than ``CROWD`` distinct
segments, as at the edge of a passage that very many documents share, is split by
further bytes: its strings are told by their second least gram too, then by their
third, at last by all their bytes, and cut into segments anew. Equal segments are
told apart from their first by a pre-aggregated minimum over their bytes; the
distinct ones of each part are sorted as above. So no group that is sorted is larger.

Null text counts as empty. Texts shorter than ``length`` keep every byte. A null
id ranks last; rows with one id, repeated or not, follow one another in the
order read. What is kept may cut a character, so it is given as bytes. Other
columns are carried along. An empty table gives no rows. A long text needs about
forty times its size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import Lookup, columns, few_rows, in_folders, spans, store, utf8

LENGTH, GRAM = 100, 24
CROWD = 4096
FURTHER = 2  # further least grams that split a crowd, before all bytes do
STARTS = 1 << 17  # strings sorted at a time, more only if one group has more
BLOCK = 1 << 21  # bytes whose anchors are found at a time

_MIX = np.random.default_rng(6).integers(1, 1 << 62, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = pa.schema(
    [("hash", pa.int64()), ("part", pa.int64()), ("rid", pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("bytes", pa.binary())]
)
SEGMENT = "hash long, part long, rid long, rank long, start long, stop long, bytes binary"
SPAN = "part long, rid long, start long, stop long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on; the last places are meaningless."""

    def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        out = left * np.uint64(pow(_BASE, width, 1 << 64))
        out[: len(out) - width] += right[width:]
        return out

    sums = {1: _MIX[data]}
    for width in (1, 2, 4, 8):
        sums[2 * width] = joined(sums[width], sums[width], width)
        if width < 8:
            del sums[width]
    out = sums[16] * np.uint64(pow(_BASE, 8, 1 << 64))
    out[: max(0, len(out) - 16)] += sums[8][16:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another: each anchor's text and hash, and the first and last string that has it."""
    n_grams = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    hashes = gram_hashes(data)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while 2 * width <= n_grams:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = n_grams - width
    if rest:
        least[:-rest] = np.minimum(least[:-rest], least[rest:])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(np.arange(len(data)) + length <= starts[1:][text])
    if not len(at):
        return none, none.astype(np.uint64), none, none
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(change[1:], len(at)) - 1
    return text[at[change]], hashes[anchor[change]], at[change], at[last]


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = batch.column(0).to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
    for at, end in zip(edges[:-1], edges[1:]):
        yield int(part[at]), batch.slice(at, end - at)


def numbered_parts(docs: DataFrame) -> DataFrame:
    """Stored: ``part, rid, rank, row``; ``rank`` and then ``rid`` give the documents' order."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(
        F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("rid"), rank.alias("rank"), F.struct(*columns(docs)).alias("row")
    )
    return store(rows, "parts")


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``part, hash`` of every anchor that occurs more than once in the corpus."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _by_part(batch):
                data, starts = utf8(own.column(1))
                found = [np.zeros(0, np.uint64)]
                for at, end in spans(starts, BLOCK):
                    found.append(anchors(data[starts[at] : starts[end]], starts[at : end + 1] - starts[at], length)[1])
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), part)), pa.array(counts)], names=["hash", "part", "n"]
                )

    seen = texts.select("part", "text").mapInArrow(find, "hash long, part long, n long")
    # At most one row for each batch has a hash, however often it occurs.
    return seen.select("part", "hash", F.expr("sum(n) OVER (PARTITION BY hash)").alias("n")).filter("n > 1").select("part", "hash")


def segments(texts: DataFrame, repeated: str, length: int) -> DataFrame:
    """Stored: the distinct segments of repeated anchors, and, without bytes, spans of later equal ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(repeated)
        for batch in batches:
            for part, own in _by_part(batch):
                known = lookup.of(part)
                if known is None:
                    continue
                wanted = np.unique(known.column("hash").to_numpy().view(np.uint64))
                rids, ranks = own.column(1).to_numpy(), own.column(2).to_numpy()
                data, starts = utf8(own.column(3))
                for at, end in spans(starts, BLOCK):
                    yield from segment(part, rids[at:end], ranks[at:end], data[starts[at] : starts[end]], starts[at : end + 1] - starts[at], wanted)

    def segment(part, rids, ranks, data, starts, wanted) -> Iterator[pa.RecordBatch]:
        text, hashes, first, last = anchors(data, starts, length)
        place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        again = wanted[place] == hashes
        text, hashes, first, stop = text[again], hashes[again], first[again], last[again] + length
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist())]
        # Segments in the documents' order: the first of equal ones stands for the others.
        order = np.lexsort((first, rids[text], ranks[text])).tolist()
        seen: set[bytes] = set()
        keep = np.zeros(len(pieces), bool)
        for one in order:
            if pieces[one] not in seen:
                seen.add(pieces[one])
                keep[one] = True
        offset = starts[text]
        chosen = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[chosen].view(np.int64)), pa.array(np.full(len(chosen), part)), pa.array(rids[text[chosen]]), pa.array(ranks[text[chosen]]),
                pa.array((first - offset)[chosen]), pa.array((stop - offset)[chosen]), pa.array([pieces[one] for one in chosen], pa.binary()),
            ],
            schema=_SEGMENT,
        )
        own, begin, end = united(text[~keep], (first - offset)[~keep], (stop - offset)[~keep])
        nothing = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, pa.array(np.full(len(own), part)), pa.array(rids[own]), pa.array(ranks[own]), pa.array(begin), pa.array(end), pa.nulls(len(own), pa.binary())],
            schema=_SEGMENT,
        )

    return store(texts.select("part", "rid", "rank", "text").mapInArrow(cut, SEGMENT), "segments")


def united(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch, of one key, as one."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    new = np.append(True, key[1:] != key[:-1])
    # The furthest stop so far, starting anew with each key.
    shift = np.cumsum(new) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1]


def string_words(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings at some places, as big-endian words: [words, strings]. Bytes beyond ``length`` are zero."""
    n_words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * n_words, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * n_words)[at]
    rows[:, length:] = 0
    return np.ascontiguousarray(rows.view(">u8").T.astype(np.uint64))


def suffix_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of the strings by group and content. Only ties are sorted again by the next word."""
    order = np.lexsort((words[0], group))
    same = (group[order][1:] == group[order][:-1]) & (words[0][order][1:] == words[0][order][:-1])
    for word in words[1:]:
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        if not len(tied):
            break
        run = np.cumsum(~np.append(False, same))[tied]
        resorted = order[tied][np.lexsort((word[order[tied]], run))]
        order[tied] = resorted
        equal = word[resorted][1:] == word[resorted][:-1]
        still = np.zeros(len(same), bool)
        inner = (np.diff(tied) == 1) & same[tied[:-1]] & equal
        still[tied[:-1][inner]] = True
        same = still
    return order


def nearest_smaller(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest to the left, and to the right, with a smaller position; -1 and n if there is none."""
    n = len(position)
    bounded = np.concatenate([[-1], position, [-1]])  # a smaller one at either end
    out = []
    for step in (-1, 1):
        near = np.arange(n + 2) + step
        near[0], near[-1] = 0, n + 1
        todo = np.arange(1, n + 1)
        while len(todo := todo[bounded[near[todo]] >= bounded[todo]]):
            near[todo] = near[near[todo]]
        out.append(near[1:-1] - 1)
    return out[0], out[1]


def longest_previous(position: np.ndarray, group: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each string the longest beginning, up to ``length``, that starts earlier in its group."""
    order = suffix_order(group, words)
    out = np.zeros(len(order), np.int64)
    for near in nearest_smaller(position[order]):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        one, other = order[has], order[near[has]]
        inside = group[one] == group[other]
        one, other = one[inside], other[inside]
        common, equal = np.zeros(len(one), np.int64), np.ones(len(one), bool)
        for word in words:
            differ = word[one] ^ word[other]
            # Leading equal bytes of the first word that differs, eight for each before.
            zeros = 8 - (np.frexp(differ.astype(np.float64))[1] + 7) // 8
            top = (differ >> np.uint64(53)) != 0
            zeros[top] = 8 - (np.frexp((differ[top] >> np.uint64(32)).astype(np.float64))[1] + 32 + 7) // 8
            common += np.where(equal, zeros, 0)
            equal &= differ == 0
        out[one] = np.maximum(out[one], np.minimum(common, length))
    return out


def group_spans(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, rid, start, stop of what repeats among the segments of whole groups."""
    group, part, rid, rank, start, stop = (rows.column(name).to_numpy() for name in ("hash", "part", "rid", "rank", "start", "stop"))
    pieces = rows.column("bytes").to_pylist()
    order = np.lexsort((start, rid, rank, group))
    first: dict[tuple[int, bytes], int] = {}
    covered, distinct = [], []
    for at in order.tolist():
        key = (int(group[at]), pieces[at])
        if first.setdefault(key, at) != at:
            covered.append(at)
        else:
            distinct.append(at)
    distinct = np.array(distinct, np.int64)
    size = np.bincount(np.unique(group[distinct], return_inverse=True)[1])
    distinct = distinct[np.repeat(size, size) > 1]  # sorted by group, and alone means without a match
    found = [(part[covered], rid[covered], start[covered], stop[covered])]
    if len(distinct):
        data = np.frombuffer(b"".join(pieces[at] for at in distinct.tolist()), np.uint8)
        sizes = (stop - start)[distinct]
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(distinct)), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        words = string_words(data, (np.cumsum(sizes) - sizes)[owner] + nth, length)
        # Segments are in the documents' order within a group, so their numbers are positions.
        again = longest_previous(np.arange(len(owner)), group[distinct][owner], words, length) >= length
        at, begin = distinct[owner[again]], nth[again]
        found.append((part[at], rid[at], start[at] + begin, start[at] + begin + length))
    return tuple(np.concatenate(column) for column in zip(*found))


def _span_batch(part, rid, start, stop) -> pa.RecordBatch:
    names = ["part", "rid", "start", "stop"]
    if len(rid):
        key, place = np.unique(np.stack([part, rid]), axis=1, return_inverse=True)
        own, start, stop = united(place.reshape(-1), start, stop)
        part, rid = key[0][own], key[1][own]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (part, rid, start, stop)], names=names)


def split_segments(pieces: list[bytes], hashes: np.ndarray, length: int, further: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts segments by the ``further`` least gram of their strings after the anchor, or by all bytes (-1).

    Returns each new segment's old one, its hash, and its first and last string there.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(piece) for piece in pieces], np.int64)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[owner] + nth
    if further < 0:
        raw = data.tobytes()
        own = np.array([xxhash.xxh3_64_intdigest(raw[a : a + length]) for a in at.tolist()], np.uint64)
    else:
        grams, nth_least = gram_hashes(data), min(further, length - GRAM)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([grams, np.zeros(length, np.uint64)]), length - GRAM + 1)
        own = np.concatenate([np.partition(windows[at[a : a + (1 << 16)]], nth_least, axis=1)[:, nth_least] for a in range(0, len(at), 1 << 16)] or [np.zeros(0, np.uint64)])
    mixed = (hashes.view(np.uint64)[owner] ^ (own * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(_BASE)
    mixed ^= mixed >> np.uint64(32)
    begins = np.flatnonzero(np.append(True, (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1]))[: len(mixed)])
    lasts = np.append(begins[1:], len(mixed))[: len(begins)] - 1
    return owner[begins], mixed[begins].view(np.int64), nth[begins], nth[lasts]


def _resplit(rows: DataFrame, length: int, further: int) -> DataFrame:
    """Stored: the distinct new segments of crowded ones, and, without bytes, spans of later equal ones."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 2000):
            pieces = batch.column(6).to_pylist()
            hashes, part, rid, rank, start = (batch.column(at).to_numpy() for at in range(5))
            old, new, first, last = split_segments(pieces, hashes, length, further)
            stops = last + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(new), pa.array(part[old]), pa.array(rid[old]), pa.array(rank[old]), pa.array(start[old] + first), pa.array(start[old] + stops),
                 pa.array([pieces[one][a:b] for one, a, b in zip(old.tolist(), first.tolist(), stops.tolist())], pa.binary())],
                schema=_SEGMENT,
            )

    cut = store(rows.mapInArrow(split, SEGMENT), "split")
    firsts = store(cut.groupBy("hash", "bytes").agg(F.min(F.struct("rank", "rid", "start", "part", "stop")).alias("first"), F.count("*").alias("n")), "split-firsts")
    distinct = firsts.select("hash", "first.part", "first.rid", "first.rank", "first.start", "first.stop", "bytes")
    again = cut.join(firsts.filter("n > 1").select("hash", "bytes", "first"), ["hash", "bytes"])
    again = again.filter("struct(rank, rid, start) <> struct(first.rank, first.rid, first.start)")
    nothing = [F.lit(None).cast("long").alias("hash"), "part", "rid", "rank", "start", "stop", F.lit(None).cast("binary").alias("bytes")]
    return store(distinct.union(again.select(*nothing)), "split-segments")


def repeats(cut: DataFrame, length: int, crowd: int) -> DataFrame:
    """``part, rid, start, stop``: spans of strings that start earlier in the corpus."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size * 40 < STARTS:
                continue
            rows = pa.Table.from_batches(waiting)
            groups = rows.column("hash").to_numpy()
            last = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if last:
                for at, end in _group_blocks(groups[:last]):
                    yield _span_batch(*group_spans(rows.slice(at, end - at), length))
            waiting, size = rows.slice(last).to_batches(), len(groups) - last
        if waiting:
            rows = pa.Table.from_batches(waiting)
            for at, end in _group_blocks(rows.column("hash").to_numpy()):
                yield _span_batch(*group_spans(rows.slice(at, end - at), length))

    found, further = None, 1
    while True:
        early = cut.filter("bytes IS NULL").select("part", "rid", "start", "stop")
        found = early if found is None else found.union(early)
        rows = cut.filter("bytes IS NOT NULL")
        crowded = store(rows.groupBy("hash").count().filter(F.col("count") > crowd).select("hash"), "crowded")
        calm = rows if further < 0 else rows.join(crowded, "hash", "left_anti")  # told by all bytes, a group has one distinct segment
        calm = calm.repartition("hash").sortWithinPartitions("hash")
        found = found.union(calm.mapInArrow(search, SPAN))
        if further < 0 or crowded.isEmpty():
            return found
        further = further if further <= FURTHER else -1
        cut = _resplit(rows.join(crowded, "hash", "left_semi"), length, further)
        further = further + 1 if further > 0 else further


def _group_blocks(groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole groups, of about as many segments as can be sorted at a time."""
    begins = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
    at = 0
    while at < len(groups):
        end = int(begins[max(np.searchsorted(begins, at + STARTS // 40, "right") - 1, np.searchsorted(begins, at, "right"))])
        yield at, end
        at = end


def deduplicated(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``row`` with all columns of ``docs``, ``n_bytes``, ``removed`` (start and stop of each span cut out), ``kept`` (bytes)."""
    if length < GRAM:
        raise ValueError(f"strings of less than {GRAM} bytes have no anchor")
    parts = numbered_parts(docs)
    texts = parts.select("part", "rid", "rank", F.col("row.text").alias("text"))
    repeated = in_folders(repeated_anchors(texts, length), "repeated")
    found = in_folders(repeats(segments(texts, repeated, length), length, crowd), "spans")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    row = parts.schema["row"]
    schema = T.StructType([row, T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(found)
        last, known = None, {}
        for batch in batches:
            for part, own in _by_part(batch):
                if part != last:
                    rows, last, known = lookup.of(part), part, {}
                    if rows is not None:
                        key, start, stop = united(*(rows.column(name).to_numpy() for name in ("rid", "start", "stop")))
                        for rid, a, b in zip(key.tolist(), start.tolist(), stop.tolist()):
                            known.setdefault(rid, []).append((a, b))
                removed, kept, sizes = [], [], []
                for rid, text in zip(own.column(1).to_pylist(), own.column(2).field("text")):
                    raw, cuts = (text.as_py() or "").encode(), known.get(rid, [])
                    edges = [0, *(edge for cut in cuts for edge in cut), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else raw)
                    removed.append([{"start": a, "stop": b} for a, b in cuts])
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [own.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=schema.names
                )

    return parts.select("part", "rid", "row").mapInArrow(remove, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    rows = deduplicated(docs.select("doc_id", "text"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
