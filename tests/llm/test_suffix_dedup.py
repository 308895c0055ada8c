from __future__ import annotations

import hashlib

import numpy as np
import pytest

from codelens.llm import suffix_dedup as sd


def brute(docs, length):
    """Documents in the order given, which must be that of their ids."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            piece = raw[at : at + length]
            if piece in seen:
                gone[at : at + length] = True
            seen.add(piece)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        n_spans = int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return [
        (r.row.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in df.select("row", "n_bytes", "removed", "kept").collect()
    ]


def cases(seed):
    rng = np.random.default_rng(seed)
    text = lambda n, k=26: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé\n\0 "[:k]), n))
    shared = [text(int(n)) for n in rng.integers(20, 300, 6)] + ["é" * 90, "ab" * 70]
    docs = [(0, None), (1, ""), (2, "x" * 29), (3, "y" * 400), (4, "y" * 31), (5, "ab" * 50)]
    for n in range(50):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            own = shared[int(rng.integers(0, len(shared)))]
            begin = int(rng.integers(0, len(own)))
            parts += [text(int(rng.integers(0, 90)), 30), own if rng.random() < 0.6 else own[begin:]]
        docs.append((10 + n, "".join(parts)))
    docs += [(100, docs[20][1]), (101, docs[20][1]), (102, text(3000, 2)), (103, text(20_000, 30) + docs[9][1]), (104, docs[20][1] + "!")]
    return docs


@pytest.mark.parametrize(("length", "crowd", "starts"), [(30, 4096, 1 << 17), (30, 1, 1 << 17), (24, 5, 400), (100, 4096, 1 << 17)])
def test_equals_brute_force(spark, monkeypatch, length, crowd, starts):
    monkeypatch.setattr(sd, "STARTS", starts)
    monkeypatch.setattr(sd, "BLOCK", 3000)
    docs = cases(length + crowd)
    order = np.random.default_rng(0).permutation(len(docs))
    frame = spark.createDataFrame([docs[n] for n in order], "doc_id long, text string").repartition(5)
    assert sorted(rows_of(sd.deduplicated(frame, length, crowd))) == sorted(brute(docs, length))


def test_crowds_are_split_into_small_groups(spark, monkeypatch):
    """A passage in very many documents, each with other words around it: no sorted group exceeds the limit."""
    rng = np.random.default_rng(11)
    passage = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400))
    around = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 150))
    docs = [(n, around() + passage + around()) for n in range(300)]
    largest = []
    cut = sd.segments(*_segments_of(spark, docs))
    for further in (1, 2, -1):
        rows = cut.filter("bytes IS NOT NULL")
        largest.append(rows.groupBy("hash").count().agg({"count": "max"}).first()[0])
        cut = sd._resplit(rows, 100, further)
    largest.append(cut.filter("bytes IS NOT NULL").groupBy("hash").count().agg({"count": "max"}).first()[0])
    assert largest == sorted(largest, reverse=True) and largest[0] > 100 and largest[-1] == 1
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(rows_of(sd.deduplicated(frame, 100, 20))) == sorted(brute(docs, 100))


def _segments_of(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    texts = sd.numbered_parts(frame).select("part", "rid", "rank", sd.F.col("row.text").alias("text"))
    return texts, sd.in_folders(sd.repeated_anchors(texts, 100), "repeated"), 100


def test_longest_previous_factors():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[250:255] = 0
    at = np.arange(len(data) - 19)
    got = sd.longest_previous(at, (at >= 300).astype(np.int64), sd.string_words(data, at, 20), 20)
    raw = data.tobytes()
    for n in at.tolist():
        best = 0
        for earlier in range(300 if n >= 300 else 0, n):
            same = 0
            while same < 20 and raw[earlier + same] == raw[n + same]:
                same += 1
            best = max(best, same)
        assert got[n] == best


def test_leading_equal_bytes_of_any_size():
    data = np.frombuffer(bytes([0, 255, 255, 255, 255, 255, 255, 255] * 2 + [1] + [255] * 15), np.uint8)
    at = np.array([0, 8, 16])
    words = sd.string_words(data, at, 8)
    assert sd.longest_previous(np.arange(3), np.zeros(3, np.int64), words, 8).tolist() == [0, 8, 0]


def test_every_string_has_one_anchor_that_its_copies_share():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[3000:3400] = data[1000:1400]
    starts = np.array([0, 2000, 2050, 2050, 5000])
    text, hashes, first, last = sd.anchors(data, starts, 100)
    covered = sorted(at for a, b in zip(first, last) for at in range(a, b + 1))
    assert covered == [at for a, b in zip(starts, starts[1:]) for at in range(a, b - 99)]
    anchor = {at: h for h, a, b in zip(hashes, first, last) for at in range(a, b + 1)}
    assert all(anchor[1000 + n] == anchor[3000 + n] for n in range(301))


def test_order_of_rows_with_equal_or_no_ids(spark):
    rng = np.random.default_rng(3)
    one = "".join(rng.choice(list("abcdefgh"), 300))
    frame = spark.createDataFrame([(None, one, 1, "x"), (7, one, 1, "x"), (7, one, 2, None)], "doc_id long, text string, part int, hash string").coalesce(1)
    got = rows_of(sd.deduplicated(frame))
    assert sorted((r[0] or 0, r[2]) for r in got) == [(0, 300), (7, 0), (7, 300)]
    assert sd.deduplicated(frame).select("row.*").columns == frame.columns


def test_empty_table(spark):
    assert sd.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
