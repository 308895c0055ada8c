from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from codelens.llm import crf_quality as crf

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    text = np.repeat([0, 2, 3, 5], [3, 1, 6, 4])
    wide = rng.normal(size=(len(text), 5))
    field = crf.Field(rng.normal(size=5), rng.normal(size=(2, 2)), 0.5)
    got, moves = crf.marginals(field, text, wide, pairs=True)
    expected, all_moves = [], np.zeros((2, 2))
    for own in np.unique(text):
        scores = wide[text == own] @ field.weights
        total, good, pairs = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(scores)):
            weight = np.exp(scores @ np.array(path) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            good += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        expected += list(good / total)
        all_moves += pairs / total
    assert np.allclose(got, expected) and np.allclose(moves, all_moves)


def features_of(*texts):
    raw = [text.encode() for text in texts]
    return crf.line_features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def test_features_of_a_line_depend_on_its_text_only():
    texts = ["One two three.\n\nTHE!! BIG!! SHOUT!!\nOne two three.", "", "the the the the", " \n ", "a | b | c\nx*** y$$$", "é"]
    text, size, together = features_of(*texts)
    alone = np.concatenate([features_of(x)[2] for x in texts])
    assert text.tolist() == [0, 0, 0, 2, 4, 4, 5]
    assert np.array_equal(together, alone)
    assert together.shape[1] == crf.N_FEATURES
    assert together[:, -1].tolist() == [0, 0, 1, 0, 0, 0, 0]  # the first text repeats a line
    assert together[3, 17] == 0.75  # three of four words repeat the one before


@pytest.fixture(scope="module")
def report(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    return crf.report(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id", "left").toPandas()


def test_held_out_accuracy(report):
    assert len(report) == 1000 and report.score.between(0, 1).all()
    assert (report.predicted == (report.score >= 0.3)).all()
    assert (report.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in report.doc_id]).all()
    judged = report[report.held_out & report.quality.notna()]
    assert len(judged) > 50
    assert (judged.predicted == judged.quality).mean() > 0.95
    assert judged[judged.toxic == 1].predicted.equals(judged[judged.toxic == 1].quality.astype("int32"))


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "Fine words here."), (4, "x" * 400_000), (5, "a\n" * 30_000), (6, "same"), (6, "same")]


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = crf.report(docs, none).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    one_kind = spark.createDataFrame([(n, 1, None) for n in range(9)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in crf.report(docs, one_kind).collect()} == {1.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert crf.report(empty, none).collect() == []
    lines = crf.label_lines(docs, crf.fit(docs, none)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in lines} == {None: 1, 4: 1, 5: 30_000, 6: 2}


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2.0, "r"), (2, None, None, None)], "doc_id long, text string, score double, row string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = crf.good_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2


def test_the_sample_is_bounded_in_rows_and_lines(spark, monkeypatch):
    monkeypatch.setattr(crf, "STEPS", 5)
    reached = []
    fit = crf.fit_field
    monkeypatch.setattr(crf, "fit_field", lambda text, features, label, prior: reached.append((len(label), len(text))) or fit(text, features, label, prior))
    docs = [(7, "a line\n" * 12)] * 3000 + [(n, "one line\nand another") for n in range(100, 160)] + [(n, "long\n" * 5000) for n in range(200, 210)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(n, n % 2) for n in (7, *range(100, 160), *range(200, 210))], "doc_id long, quality long")
    crf.fit(frame, labels, sample=10)
    monkeypatch.setattr(crf, "LINES", 700)
    crf.fit(frame, labels)
    (rows, _), (all_rows, lines) = reached
    assert 0 < rows <= 10 and 30 < all_rows <= 61 and lines <= 700


def test_lines_are_latent(spark):
    """A good document may have bad lines, which the field thinks less of, so labels change within a text."""
    good, bad = "Plain words stand here in a row.", "!!! *** BUY || NOW ||| ### !!!"
    docs = [(n, "\n".join([good] * 8 + [bad] * (n % 3) + [good] * 4)) for n in range(0, 200, 2)] + [(n, "\n".join([bad] * 9 + [good] * (n % 2))) for n in range(1, 200, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    field = crf.fit(frame, spark.createDataFrame([(n, 1 - n % 2) for n, _ in docs], "doc_id long, quality short"))
    marginal = [row.p_good for row in crf.label_lines(frame.filter("doc_id = 2"), field).orderBy("line").collect()]
    assert max(marginal[8:10]) < min(marginal[:7] + marginal[11:])
    assert np.exp(field.moves).min() > 1e-3  # moves from good to bad and back have weight


def test_long_chains_are_fitted_in_pieces(monkeypatch):
    monkeypatch.setattr(crf, "STEPS", 2)
    seen = []
    own = crf.marginals
    monkeypatch.setattr(crf, "marginals", lambda field, text, *more, **named: seen.append(np.bincount(text)) or own(field, text, *more, **named))
    crf.fit_field(np.repeat([0, 1], [1300, 3]), np.random.default_rng(1).random((1303, crf.N_FEATURES), np.float32), np.array([0, 1]), 0.5)
    assert seen[0].tolist() == [512, 512, 276, 3]
