"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank gets features of its own bytes and of the lines
before and after it; the field labels each line good or bad. A document's score
is the mean of its lines' forward-backward marginals for good, weighted by their
lengths in bytes.

The field is fitted to a bounded sample: of the labelled documents that may be
learned from, the ``sample`` ones whose ids hash lowest, whole texts, one for each
id, as long as they have ``LINES`` lines together; one that has more than are left
is passed over. Lines are latent: a document's label is a noisy witness of each of
its lines, right with probability ``AGREE``, so a good document may have bad lines,
and the field learns how labels change from line to line. Only line features reach
the driver. Scoring is one pass over all rows without a shuffle.

A text without a visible character (null, empty, blank) scores the share of good
labels in the sample. Without any labelled row everything scores one half; with
one kind of label only, its share. Null and repeated labels: null is ignored,
the largest of several counts. A null id counts as held out. Language, source,
id and labels are never inputs of a score. Repeated rows are scored each; a text
of one line is a chain of one, a very long one is scored in a run of its own;
labels of any whole number type count; other columns are carried along under any
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import columns, field_of, spans, store, utf8

SAMPLE, LINES = 4000, 400_000
AGREE = 0.99
CHAIN = 512  # lines of one chain in fitting; scoring has no such cut
THRESHOLD = 0.3
STEPS, RATE, SHRINK = 300, 0.1, 1e-5

# Classes of bytes: each feature counts those of one class in a line.
_SETS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "other": bytes(range(128, 256)),
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "bar": b"|",
    "bang": b"!",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
}
_CLASS = np.zeros(256, np.uint8)
for _at, _bytes in enumerate(_SETS.values()):
    _CLASS[list(_bytes)] = _at + 1
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_MIX = np.random.default_rng(8).integers(1, 1 << 62, 256, dtype=np.uint64)
N_FEATURES = 22


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another: each visible line's text, bytes, and features."""
    edges = np.unique(np.concatenate([starts[:-1], np.flatnonzero(data == 10) + 1]))
    edges = edges[edges < len(data)]
    if not len(edges) or _BLANK[data].all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N_FEATURES), np.float32)
    size = np.diff(np.append(edges, len(data)))
    kind, seen = _CLASS[data], ~_BLANK[data]
    counts = {name: np.add.reduceat(kind == at + 1, edges, dtype=np.int64) for at, name in enumerate(_SETS)}
    visible = np.add.reduceat(seen, edges, dtype=np.int64)
    # A word's hash depends on its bytes and their places in it.
    begins = seen.copy()
    begins[1:] &= ~seen[:-1]
    begins[edges] = seen[edges]
    at_word = np.flatnonzero(begins)
    place = np.arange(1, len(data) + 1) - at_word[np.cumsum(begins) - 1]
    word = np.add.reduceat(np.where(seen, _MIX[data] * place.astype(np.uint64), np.uint64(0)), at_word)
    line_of_word = np.searchsorted(edges, at_word, "right") - 1
    n_words = np.bincount(line_of_word, minlength=len(edges))

    def share_of_repeats(distance: int) -> np.ndarray:
        same = (word[distance:] == word[:-distance]) & (line_of_word[distance:] == line_of_word[:-distance])
        return np.bincount(line_of_word[distance:][same], minlength=len(edges)) / np.maximum(n_words, 1)

    # A line that its text had before, by the sum of its words' hashes and places.
    nth = np.arange(len(word)) - (np.cumsum(n_words) - n_words)[line_of_word]
    whole = np.zeros(len(edges), np.uint64)
    np.add.at(whole, line_of_word, word * (2 * nth + 1).astype(np.uint64))
    text = np.searchsorted(starts, edges, "right") - 1
    order = np.lexsort((np.arange(len(edges)), whole, text))
    again = np.zeros(len(edges), bool)
    again[order[1:]] = (text[order][1:] == text[order][:-1]) & (whole[order][1:] == whole[order][:-1])

    letters = np.maximum(counts["upper"] + counts["lower"] + counts["other"], 1)
    full = np.maximum(visible, 1)
    upper, sign, bang, bar = counts["upper"] / letters, counts["sign"] / full, counts["bang"] / full, counts["bar"] / full
    once, twice = share_of_repeats(1), share_of_repeats(2)
    features = np.stack(
        [
            np.ones(len(edges)),
            np.log1p(n_words) / 8,
            n_words <= 2,
            upper, upper > 0.3, upper > 0.7,
            sign, sign > 0.05, sign > 0.2,
            bang, bang > 0.1,
            bar, bar > 0.05,
            counts["digit"] / full,
            counts["stop"] / full,
            counts["other"] / full,
            np.minimum(visible / np.maximum(n_words, 1), 40) / 20,
            once, once > 0.2, once > 0.6,
            twice > 0.3,
            again,
        ],
        axis=1,
    ).astype(np.float32)
    shown = visible > 0
    return text[shown], size[shown], features[shown]


def with_neighbours(text: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after, zero at a text's ends."""
    wide = np.zeros((len(text), 3 * N_FEATURES), np.float32)
    wide[:, :N_FEATURES] = features
    inside = text[1:] == text[:-1]
    wide[1:, N_FEATURES : 2 * N_FEATURES][inside] = features[:-1][inside]
    wide[:-1, 2 * N_FEATURES :][inside] = features[1:][inside]
    return wide


@dataclass(frozen=True)
class Field:
    """Weights of the features for good, and of moves between bad (0) and good (1)."""

    weights: np.ndarray
    moves: np.ndarray
    prior: float


def marginals(field: Field, text: np.ndarray, wide: np.ndarray, pairs: bool = False, witness: np.ndarray | None = None):
    """Of each line the probability of good; with ``pairs`` also the expected moves of all lines.

    ``witness`` has the probability of what is known of each line if it is bad, and if it is good.
    All texts advance together, line by line; texts with more lines come first.
    """
    if not len(text):
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    good = 1 / (1 + np.exp(-np.clip(wide @ field.weights, -30, 30)))
    emit = np.stack([1 - good, good], axis=1)
    emit = emit if witness is None else emit * witness
    move = np.exp(field.moves)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    n_lines = np.diff(np.append(first, len(text)))
    by_length = np.argsort(-n_lines, kind="stable")
    first, n_lines = first[by_length], n_lines[by_length]
    alive = np.searchsorted(-n_lines, -np.arange(1, n_lines[0] + 1), "right")
    ahead = np.zeros_like(emit)
    for step, n in enumerate(alive):
        at = first[:n] + step
        reached = emit[at] if step == 0 else (ahead[at - 1] @ move) * emit[at]
        ahead[at] = reached / reached.sum(1, keepdims=True)
    behind = np.ones_like(emit)
    expected = np.zeros((2, 2))
    for step in range(len(alive) - 1, 0, -1):
        at = first[: alive[step]] + step
        after = behind[at] * emit[at]
        if pairs:
            joint = ahead[at - 1][:, :, None] * move * after[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = after @ move.T
        behind[at - 1] = back / back.sum(1, keepdims=True)
    both = ahead * behind
    p_good = both[:, 1] / both.sum(1)
    return (p_good, expected) if pairs else p_good


def fit_field(text: np.ndarray, features: np.ndarray, label_of_text: np.ndarray, prior: float) -> Field:
    """Gradient ascent on the mean log-likelihood of what the labels say of the sample's lines, weights shrunk."""
    wide = with_neighbours(text, features).astype(np.float64)
    label_of_line = label_of_text[text]
    # Chains advance together line by line, so a very long one is fitted as several.
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    text = np.cumsum(np.append(True, (text[1:] != text[:-1]) | (nth[1:] % CHAIN == 0))[: len(text)]) - 1
    weights, moves = np.zeros(wide.shape[1]), np.zeros((2, 2))
    if not len(text) or label_of_text.min() == label_of_text.max():
        return Field(np.zeros(3 * N_FEATURES), moves, prior)
    good = label_of_line == 1
    witness = np.stack([np.where(good, 1 - AGREE, AGREE), np.where(good, AGREE, 1 - AGREE)], axis=1)
    state = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    for step in range(1, STEPS + 1):
        field = Field(weights, moves, prior)
        p_good, expected = marginals(field, text, wide, pairs=True)
        p_known, seen = marginals(field, text, wide, pairs=True, witness=witness)
        slope = np.concatenate([wide.T @ (p_known - p_good), (seen - expected).ravel()]) / len(text)
        slope -= SHRINK * np.concatenate([weights, moves.ravel()])
        state = [0.9 * state[0] + 0.1 * slope, 0.99 * state[1] + 0.01 * slope**2]
        change = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + change[:-4], moves + change[-4:].reshape(2, 2)
    return Field(weights, moves, prior)


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits a field to at most ``sample`` labelled documents."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Of rows with one id the first text counts, so there are at most ``sample``.
    rows = store(met.groupBy("doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "sample")
    sizes = rows.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"), F.xxhash64("doc_id").alias("hash")).collect()
    left, fitting = LINES, []
    for row in sorted(sizes, key=lambda row: (row.hash, row.doc_id)):
        if row.n <= left:
            left -= row.n
            fitting.append(row.doc_id)
    rows = rows if len(fitting) == len(sizes) else rows.filter(F.col("doc_id").isin(fitting))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(2))
            for at, end in spans(starts, 1 << 21):
                text, _, features = line_features(data[starts[at] : starts[end]], starts[at : end + 1] - starts[at])
                lines = np.split(features, np.searchsorted(text, np.arange(1, end - at)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array([x.tobytes() for x in lines], pa.binary())],
                    names=["doc_id", "quality", "lines"],
                )

    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("lines", T.BinaryType())])
    measured = rows.mapInArrow(measure, schema).collect()
    measured.sort(key=lambda row: (row.doc_id, row.quality, row.lines))
    blocks = [np.frombuffer(row.lines, np.float32).reshape(-1, N_FEATURES) for row in measured]
    label = np.array([row.quality for row in measured], np.int64)
    text = np.repeat(np.arange(len(blocks)), [len(block) for block in blocks])
    features = np.concatenate(blocks) if blocks else np.zeros((0, N_FEATURES), np.float32)
    return fit_field(text, features, label, float(label.mean()) if len(label) else 0.5)


def _lines(field: Field, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of texts, then each visible line's text, bytes and marginal, a few megabytes at a time."""
    data, starts = utf8(texts)
    for at, end in spans(starts, 1 << 21):
        text, size, features = line_features(data[starts[at] : starts[end]], starts[at : end + 1] - starts[at])
        if field.weights.any():
            p_good = marginals(field, text, with_neighbours(text, features))
        else:
            p_good = np.full(len(text), field.prior)
        yield end - at, text, size, p_good


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``row`` with all columns of ``docs``, ``score``, ``predicted``."""
    rows = docs.select(F.struct(*columns(docs)).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for n, text, size, p_good in _lines(field, field_of(batch, "text")):
                weight = np.bincount(text, size, n)
                scores.append(np.where(weight > 0, np.bincount(text, size * p_good, n) / np.maximum(weight, 1), field.prior))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=schema.names)

    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, line, n_bytes, p_good, good`` of every visible line; lines are numbered without blank ones."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0), 0
            for n, text, size, p_good in _lines(field, batch.column(1)):
                line = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + done)), pa.array(line), pa.array(size), pa.array(p_good)], names=["doc_id", "line", "n_bytes", "p_good"]
                )
                done += n

    lines = docs.select("doc_id", "text").mapInArrow(label, "doc_id long, line long, n_bytes long, p_good double")
    return lines.withColumn("good", F.col("p_good") >= 0.5)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a field fitted to ``labels`` predicts to be good."""
    return scored(docs, fit(docs, labels)).filter("predicted = 1").select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
