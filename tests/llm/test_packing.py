from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codelens.llm import packing, tokens

TEXTS = [
    (1, "Hello world"), (2, None), (3, ""), (4, "a <|endoftext|> b"), (5, "naïve Ελλάδα 中文"), (6, "word " * 700),
    (None, "null id"), (7, "twice"), (7, "twice"), (None, None), (8, "x y z " * 3000),
]


PLAIN = Tokenizer.from_file(f"{tokens.vocabulary()}.json")


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def test_curve_visits_every_cell_in_steps_of_one():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [7, 2048])
def test_pieces_hold_every_id_once(spark, length):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    pieces = packing.packed(frame, length).collect()
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    total = sum(len(ids_of(text)) for _, text in TEXTS)
    assert [p.sequence_id * length + p.offset for p in stream] == np.cumsum([0, *(p.length for p in stream[:-1])]).tolist()
    assert sum(p.length for p in stream) == total and max(p.sequence_id for p in stream) == (total - 1) // length
    assert all(0 < p.length and p.offset + p.length <= length for p in stream)
    # A document's pieces follow one another, so the stream splits into documents.
    got, at = [], []
    for p in stream:
        assert p.start == sum(len(x) for x in at) // 4 and len(p.ids) == 4 * p.length
        at.append(bytes(p.ids))
        if p.start + p.length == p.doc_tokens:
            got.append((p.doc_id, np.frombuffer(b"".join(at), "<u4").tolist()))
            at = []
    assert sorted(got, key=repr) == sorted(((i, ids_of(t)) for i, t in TEXTS), key=repr)


def test_checksums_and_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.report(docs).collect()
    for r in rows[:80]:
        own = np.array(ids_of(texts[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
    places = {i: packing.project(np.array(ids_of(t)[:-1])) for i, t in texts.items()}
    order = list(dict.fromkeys(r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))))
    walk = np.array([places[i] for i in order])
    shuffled = walk[np.random.default_rng(0).permutation(len(walk))]
    assert np.abs(np.diff(walk, axis=0)).sum() < 0.5 * np.abs(np.diff(shuffled, axis=0)).sum()


def test_empty_table_and_other_columns(spark):
    assert packing.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, "a", 5, "x")], "doc_id long, text string, rid int, ids string")
    assert [r.doc_tokens for r in packing.report(odd).collect()] == [2]


def test_added_tokens_have_their_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  <|endoftext|>  <|endoftext", "<|ENDOFTEXT|> \u00e9<|endoftext|>'s", "no"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {p.doc_id: np.frombuffer(bytes(p.ids), "<u4").tolist() for p in packing.packed(docs, 1 << 16).collect()}
    expected = {at: PLAIN.encode(text, add_special_tokens=False).ids for at, text in enumerate(texts)}
    assert expected[0] == [64, 220, 50256, 275]
    assert got == {at: [*ids, packing.END] for at, ids in expected.items()}
    assert [tokens._slow(tokens.vocabulary(), True).encode(text, add_special_tokens=False).ids for text in texts] == list(expected.values())


def test_ids_beyond_16_bits_are_kept(spark, monkeypatch):
    assert tokens.id_kind(tokens.vocabulary(), 1).itemsize == 2 and tokens.n_ids(tokens.vocabulary()) < 1 << 16
    assert tokens.id_kind(tokens.vocabulary(), 1 << 16).itemsize == 4
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    monkeypatch.setattr(packing, "PIECES", 3)
    pieces = sorted(packing.packed(docs, 500, end=70_000).collect(), key=lambda p: (p.sequence_id, p.offset))
    stream = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in pieces])
    assert (stream == 70_000).sum() == len(TEXTS) and len(stream) == sum(len(ids_of(text)) for _, text in TEXTS)
