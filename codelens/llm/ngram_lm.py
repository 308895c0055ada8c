"""Cross-entropy difference of two matched bigram models.

The target model is counted over the documents labelled good, the background
model over all documents. Both share one vocabulary and one set of bigrams, all
that occur, and have the same smoothing. A text is scored by models that lack its
own counts, so that it cannot vouch for itself; its copies can.

Texts are stored in blocks, in the order they are read. A block asks for the counts
of its distinct bigrams, words and contexts, each told by a hash, and sends what it
has of them itself: a row for each part of the keys. A part adds up what all blocks
have and answers each with the sums for its keys. The answers are stored in a folder
for each task's blocks, which look them up to score their texts. However often a
bigram occurs, a block asks for it once, so no key and no text is hot, and nothing
but three totals reaches the driver. Texts are never shuffled.

The number of parts grows with the corpus. Above ``FAN`` parts, blocks ask only
``FAN`` larger parts; groups of blocks are added up there and ask the final
parts, and the answers go back the same way. So rows stay few and long.

A token is a run of ASCII letters, digits and non-ASCII bytes, in lower case
(A-Z only), or a single other visible character. A text's losses are its tokens'
mean negative log-probabilities in nats, each after the token before it or the
beginning; ``score`` is target less background loss, so lower is more like the
target.

Null, empty and blank texts have no tokens and null losses; so has the target
loss of everything if no document is labelled good. Null and repeated labels:
null is ignored, the largest of several counts. Rows with a null id are in the
background only. Repeated rows count each time. A long text is a block of its
own. A key is told by 48 bits within its part (64 above ``FAN`` parts). Only the named columns are read, so others may have any names. Empty tables
give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import Lookup, in_folders, store, utf8

PRIOR = 10.0  # how many tokens the unigrams count as in each context
PART = 1 << 24  # bytes of text for each part of the keys
FAN = 4096  # parts that a block asks, and blocks that ask together above that
BLOCK = 1 << 22  # bytes of text in a block
BEGIN, WORD, ANY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
ONE = np.uint64(1)

ASKED = "part long, home long, block long, keys binary, counts binary"
ANSWERED = "home long, block long, part long, keys binary, counts binary, n_words long, n_target long, n_background long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
_MIX = np.random.default_rng(5).integers(1, 1 << 62, (2, 256), dtype=np.uint64)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after another: each token's text and hash."""
    data = _LOWER[data]
    word, blank = _IN_WORD[data], _BLANK[data]
    begins = ~blank
    begins[1:] &= ~(word[1:] & word[:-1])
    firsts = starts[:-1][starts[:-1] < len(data)]
    begins[firsts] = ~blank[firsts]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = (np.arange(1, len(data) + 1) - at[np.cumsum(begins) - 1]).astype(np.uint64)
    mixed = np.where(blank, np.uint64(0), _MIX[0][data] * place * place + _MIX[1][data])
    return np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(at, starts))), np.add.reduceat(mixed, at)


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = before * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    key = (key + word) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


@dataclass(frozen=True)
class Keyed:
    """A block's distinct keys: bigrams, then words, then contexts (words, and the beginning).

    Words' keys are odd, all others even. Entries are the distinct bigrams of each
    text, with their numbers of occurrences.
    """

    keys: np.ndarray
    n_pairs: int
    n_words: int
    text: np.ndarray
    pair: np.ndarray
    n: np.ndarray
    word: np.ndarray  # of each entry
    context: np.ndarray

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Occurrences of each key, a text's with the text's weight."""
        n = self.n * weight[self.text]
        parts = ((self.pair, self.n_pairs), (self.word, self.n_words), (self.context, self.n_words + 1))
        return np.concatenate([np.bincount(at, n, size) for at, size in parts]).astype(np.int64)

    def own(self, at: np.ndarray) -> np.ndarray:
        """Of each entry, how often its text has the word or context ``at``."""
        _, place = np.unique(self.text * (self.n_words + 1) + at, return_inverse=True)
        return np.bincount(place, self.n)[place]


def keyed(text: np.ndarray, hashes: np.ndarray) -> Keyed:
    words, word = np.unique(hashes, return_inverse=True)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.flatnonzero(np.append(True, text[1:] != text[:-1])[: len(text)])] = len(words)
    pairs, pair = np.unique(before * max(len(words), 1) + word, return_inverse=True)
    codes, n = np.unique(text * max(len(pairs), 1) + pair, return_counts=True)
    text, pair = codes // max(len(pairs), 1), codes % max(len(pairs), 1)
    contexts = np.append(words, BEGIN)
    context_of, word_of = pairs // max(len(words), 1), pairs % max(len(words), 1)
    keys = [_mixed(contexts[context_of], words[word_of]) & ~ONE, _mixed(np.full(len(words), WORD), words) | ONE, _mixed(contexts, ANY) & ~ONE]
    return Keyed(np.concatenate(keys), len(pairs), len(words), text, pair, n, word_of[pair], context_of[pair])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes, of two, four and eight, and those compressed."""
    top = int(counts.max(initial=0))
    return zlib.compress(counts.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes(), 1)


def _wide(counts: bytes, n: int) -> np.ndarray:
    """Two rows, target and background, of ``n`` counts."""
    counts = zlib.decompress(counts)
    return np.frombuffer(counts, f"<u{len(counts) // (2 * n)}" if n else "<u2").astype(np.int64).reshape(2, n)


def _packed(keys: np.ndarray, width: int) -> bytes:
    """Keys of ``width`` bytes in their order: steps of the first two bytes, which are small, then the others."""
    planes = keys.astype("<u8").view("<u2").reshape(-1, 4).T[: width // 2]
    steps = zlib.compress(np.diff(planes[-1].astype(np.int64), prepend=0).astype("<u2").tobytes(), 1)
    return len(steps).to_bytes(4, "little") + steps + np.ascontiguousarray(planes[:-1]).tobytes()


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(packed[:4], "little")
    top = np.cumsum(np.frombuffer(zlib.decompress(packed[4 : 4 + size]), "<u2"), dtype=np.uint64) & np.uint64(0xFFFF)
    rest = np.frombuffer(packed[4 + size :], "<u2").reshape(width // 2 - 1, len(top)).astype(np.uint64)
    keys = top << np.uint64(8 * width - 16)
    for at, plane in enumerate(rest):
        keys |= plane << np.uint64(16 * at)
    return keys


def _batch(columns: dict, kinds: str) -> pa.RecordBatch:
    kind = {"long": pa.int64(), "binary": pa.binary()}
    fields = [(name, kind[one]) for name, one in (field.split() for field in kinds.split(", "))]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), one) for name, one in fields], names=[name for name, _ in fields])


def _order(keys: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """The keys' order in requests: by part, then by what is sent of them."""
    if width == 8:
        return np.lexsort((keys, part))
    sent = np.uint64(8 * width)  # parts are few enough for the other bits
    return np.argsort(part.astype(np.uint64) << sent | keys & ((ONE << sent) - ONE))


def _requests(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, block: int, home: int, width: int) -> Iterator[pa.RecordBatch]:
    """A row for each part with its keys."""
    order = _order(keys, part, width)
    keys, counts, part = keys[order], counts[:, order], part[order]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    spans = list(zip(edges[:-1], edges[1:]))
    for first in range(0, len(spans), 256):
        own = spans[first : first + 256]
        yield _batch({
            "part": [int(part[a]) for a, _ in own], "home": [home] * len(own), "block": [block] * len(own),
            "keys": [_packed(keys[a:b], width) for a, b in own], "counts": [_narrow(counts[:, a:b]) for a, b in own],
        }, ASKED)


def blocked(docs: DataFrame) -> DataFrame:
    """Stored: ``part, block, ids, starts, data`` of texts that lie one after another; ``part`` is the task that read them."""
    rows = docs.select("doc_id", "text")
    names = ["part", "block", "ids", "starts", "data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def joined() -> pa.RecordBatch:
            ids = pa.concat_arrays([own.column(0) for own in held])
            parts = [utf8(own.column(1)) for own in held]
            starts = np.cumsum(np.concatenate([[0], *(np.diff(own) for _, own in parts)])).astype("<i8")
            data = np.concatenate([data for data, _ in parts])
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns = [pa.array([part], pa.int64()), pa.array([(part << 32) + number]), listed, pa.array([starts.tobytes()]), pa.array([data.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            _, starts = utf8(batch.column(1))
            first = 0
            while first < batch.num_rows:
                # As many texts as the block has room for, at least one in an empty block.
                last = int(np.searchsorted(starts, starts[first] + BLOCK - size, "right")) - 1
                last = min(max(last, first + (not held)), batch.num_rows)
                if last > first:
                    held.append(batch.slice(first, last - first))
                    size += int(starts[last] - starts[first])
                first = last
                if first < batch.num_rows or size >= BLOCK:
                    yield joined()
                    number, held, size = number + 1, [], 0
        if held:
            yield joined()

    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType)), *(T.StructField(name, T.BinaryType()) for name in names[3:]),
    ])
    return store(rows.mapInArrow(pack, schema), "blocks")


def good_texts(blocks: DataFrame, labels: DataFrame) -> str:
    """The folder of ``block, at`` of the texts labelled good, by part. Only ids are shuffled, at any size."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    ids = blocks.select("part", "block", F.posexplode("ids").alias("at", "doc_id"))
    return in_folders(ids.join(good.hint("merge"), "doc_id", "left_semi").select("part", "block", "at"), "good-texts")


def _in_target(good: Lookup, part: int, block: int, n_texts: int) -> np.ndarray:
    flags, known = np.zeros(n_texts, bool), good.of(part)
    if known is not None:
        flags[known.column("at").to_numpy()[known.column("block").to_numpy() == block]] = True
    return flags


def _texts_of(starts: bytes, data: bytes) -> tuple[Keyed, int]:
    starts = np.frombuffer(starts, "<i8")
    return keyed(*tokens(np.frombuffer(data, np.uint8), starts)), len(starts) - 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[dict]]:
    """Rows that are equal in ``names`` and follow one another."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and any(row[name] != held[0][name] for name in names):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _added(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some requests, their counts, and where each request's keys are among them."""
    keys = [_unpacked(row["keys"], width) for row in rows]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_wide(row["counts"], len(own)) for row, own in zip(rows, keys)], axis=1)
    sums = np.stack([np.bincount(place, own, len(distinct)) for own in counts]).astype(np.int64)
    return distinct, sums, np.split(place, np.cumsum([len(own) for own in keys])[:-1])


def _answered(requests: DataFrame, parts: int, width: int, with_keys: bool) -> DataFrame:
    """For each request the sums of all requests for its keys; and, of no home, the part's totals."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part"):
            keys, sums, places = _added(rows, width)
            is_word = (keys & ONE) == 1
            totals = [int(is_word.sum()), *map(int, sums[:, is_word].sum(axis=1))]
            yield _batch({"home": [-1], "part": [rows[0]["part"]], **{name: [value] for name, value in zip(("n_words", "n_target", "n_background"), totals)}}, ANSWERED)
            for row, place in zip(rows, places):
                yield _batch({**{name: [row[name]] for name in ("home", "block", "part")}, "keys": [row["keys"] if with_keys else None], "counts": [_narrow(sums[:, place])]}, ANSWERED)

    return requests.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, ANSWERED)


def _answered_in_two(requests: DataFrame, parts: int, fan: int, n_blocks: int) -> DataFrame:
    """The same by way of groups of blocks, which ask together; ``part`` of ``requests`` is the larger one."""
    within = -(-parts // fan)
    group = F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // fan)))
    requests = store(requests.withColumn("group", group), "requests")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part", "group"):
            keys, sums, _ = _added(rows, 8)
            yield from _requests(keys, sums, _part_of(keys, parts), rows[0]["group"], 0, 8)

    names = "part", "group"
    merged = requests.repartition(*names).sortWithinPartitions(*names, "block").mapInArrow(together, ASKED)
    answers = store(_answered(merged, parts, 8, True), "group-answers")

    def hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part", "group"):
            got = [row for row in rows if row["is_answer"]]
            keys = [_unpacked(row["keys"], 8) for row in got]
            counts = np.concatenate([_wide(row["counts"], len(own)) for row, own in zip(got, keys)], axis=1)
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[:, order]
            for row in rows:
                if not row["is_answer"]:
                    place = np.searchsorted(keys, _unpacked(row["keys"], 8))
                    yield _batch({**{name: [row[name]] for name in ("home", "block", "part")}, "counts": [_narrow(counts[:, place])]}, ANSWERED)

    columns = ["part", "group", "home", "block", "keys", "counts", "is_answer"]
    back = answers.filter("home >= 0").select(
        F.expr(f"part div {within}").alias("part"), F.col("block").alias("group"), "home", "block", "keys", "counts", F.lit(True).alias("is_answer")
    )
    both = requests.withColumn("is_answer", F.lit(False)).select(columns).union(back)
    returned = both.repartition(*names).sortWithinPartitions(*names, "is_answer", "block").mapInArrow(hand_back, ANSWERED)
    return returned.union(answers.filter("home < 0"))


def whole_losses(blocks: DataFrame, labels: DataFrame, part_bytes: int = PART, fan: int = FAN) -> DataFrame:
    """``doc_id, n_tokens, target_sum, background_sum`` of every text; sums are null without tokens, target_sum without a target."""
    spark = blocks.sparkSession
    good = good_texts(blocks, labels)
    n_blocks, size = blocks.agg(F.count("*"), F.sum(F.octet_length("data"))).first()
    parts = (size or 0) // part_bytes + 1
    two = parts > fan
    within, width = (-(-parts // fan), 8) if two else (1, 6)

    def asked_part(keys: np.ndarray) -> np.ndarray:
        return _part_of(keys, parts) // within

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(good)
        for row in _rows(batches):
            own, n_texts = _texts_of(row["starts"], row["data"])
            if len(own.n):
                weights = _in_target(known, row["part"], row["block"], n_texts), np.ones(n_texts, bool)
                yield from _requests(own.keys, np.stack([own.sums(weight) for weight in weights]), asked_part(own.keys), row["block"], row["part"], width)

    requests = blocks.select("part", "block", "starts", "data").mapInArrow(ask, ASKED)
    answers = _answered_in_two(requests, parts, fan, n_blocks) if two else _answered(requests, parts, width, False)
    answered = in_folders(answers.withColumnsRenamed({"part": "asked", "home": "part"}), "answers")
    names = "n_words", "n_target", "n_background"
    try:  # a row for each part, in a folder of their own
        of_parts = spark.read.schema(", ".join(f"{name} long" for name in names)).parquet(f"{answered}/part=-1")
        totals = of_parts.agg(*(F.sum(name) for name in names)).first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        totals = 0, 0, 0  # no text has a token

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, found = Lookup(good), Lookup(answered)
        for row in _rows(batches):
            own, n_texts = _texts_of(row["starts"], row["data"])
            n_tokens = np.bincount(own.text, own.n, n_texts).astype(np.int64)
            sums = [np.zeros(n_texts)] * 2
            if len(own.n):
                part = asked_part(own.keys)
                order = _order(own.keys, part, width)
                sizes = np.bincount(part)
                got = found.of(row["part"])
                got = got.filter(pc.equal(got.column("block"), row["block"])).select(["asked", "counts"]).to_pylist()
                counts = np.empty((2, len(order)), np.int64)
                counts[:, order] = np.concatenate([_wide(one["counts"], sizes[one["asked"]]) for one in sorted(got, key=lambda one: one["asked"])], axis=1)
                sums = losses(own, counts, _in_target(flags, row["part"], row["block"], n_texts), n_tokens, totals)
            none = n_tokens == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], ids_kind), pa.array(n_tokens), pa.array(sums[0], mask=none | (totals[1] == 0)), pa.array(sums[1], mask=none)],
                names=["doc_id", "n_tokens", "target_sum", "background_sum"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = blocks.schema["ids"].dataType.elementType
    ids_kind = to_arrow_type(kind)
    return blocks.mapInArrow(score, T.StructType([T.StructField("doc_id", kind), *(T.StructField(name, one) for name, one in (("n_tokens", T.LongType()), ("target_sum", T.DoubleType()), ("background_sum", T.DoubleType())))]))


def losses(own: Keyed, counts: np.ndarray, in_target: np.ndarray, n_tokens: np.ndarray, totals: tuple) -> list[np.ndarray]:
    """Of each text the sum of its tokens' losses under both models, without its own counts."""
    n_words, *sizes = totals
    own_word, own_context = own.own(own.word), own.own(own.context)
    out = []
    for side, size in enumerate(sizes):
        mine = in_target[own.text].astype(np.int64) if side == 0 else 1
        pairs, words, contexts = np.split(counts[side], [own.n_pairs, own.n_pairs + own.n_words])
        alone = (words[own.word] - mine * own_word + 1) / (size - mine * n_tokens[own.text] + n_words)
        seen, after = pairs[own.pair] - mine * own.n, contexts[own.context] - mine * own_context
        out.append(np.bincount(own.text, own.n * (np.log(after + PRIOR) - np.log(seen + PRIOR * alone)), len(n_tokens)))
    return out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row, by models of every token and bigram."""
    means = [(F.col(f"{name}_sum") / F.col("n_tokens")).alias(f"{name}_loss") for name in ("target", "background")]
    found = whole_losses(blocked(docs), labels).select("doc_id", "n_tokens", *means)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
