from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.llm import hard_negatives


def brute_force(rows, is_anchor, k_pos=5, k_neg=10, low=30, high=90):
    kept = [
        (at, i, label, [math.floor(256 * float(x)) for x in vector])
        for at, (i, label, vector) in enumerate(rows)
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]

    def best(scored, k):
        return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = []
    for at, anchor, label, vector in kept:
        if anchor is not None and is_anchor(anchor):
            scored = [(sum(a * b for a, b in zip(vector, other)), i, own == label) for there, i, own, other in kept if there != at]
            for ps, positive, _ in best([row for row in scored if row[2]], k_pos):
                inside = [row for row in scored if not row[2] and low * ps <= 100 * row[0] <= high * ps]
                out += [(anchor, positive, rank, i, ps, ns) for rank, (ns, i, _) in enumerate(best(inside, k_neg), 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every, parts=3, **more):
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], "id long, label int, vector array<double>, rid string, score int")
    got = hard_negatives.hard_negatives(frame.repartition(parts), F.col("id") % every == 0, **more)
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, dims, seed, labels=4):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels, dims)) * 0.3
    rows = []
    for at in range(n):
        label = int(pick.choice(labels, p=[0.5, *[0.5 / (labels - 1)] * (labels - 1)]))  # one label holds half of all rows
        rows.append((at, label, [float(x) for x in centres[label] * pick.integers(0, 2) + pick.normal(size=dims) * 0.2]))
    return rows


@pytest.mark.parametrize("block,anchors", [(8192, 1 << 23), (40, 1 << 9)])
def test_equals_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", anchors)
    rows = vectors(400, 16, 1)
    nan, inf = float("nan"), float("inf")
    rows += [rows[40], rows[40], rows[41], (50, None, [0.1] * 16), (60, 1, None), (70, 1, [nan] + [0.1] * 15), (80, 2, [inf] * 16)]
    rows += [(90, 2, [None] + [0.1] * 15), (None, 1, [0.3] * 16), (None, 0, [0.3] * 16), (120, 1, []), (1000, 2, [0.5] * 3), (1001, 3, [-0.5] * 16)]
    expected = brute_force(rows, lambda i: i % 20 == 0)
    got = mined(spark, rows, 20)
    # Rows without an id, or with the same one, can swap places where they tie: they are then equal in all that is shown.
    assert len(expected) > 100 and got == expected


def test_ties_and_few_rows(spark):
    rows = [(at, at % 2, [0.25, 0.5]) for at in range(30)]
    assert mined(spark, rows, 10, low=30, high=100) == brute_force(rows, lambda i: i % 10 == 0, high=100)
    assert mined(spark, rows, 10) == []  # all scores equal: none within nine tenths
    few = [(0, 1, [1.0]), (1, 1, [0.9]), (2, 2, [0.5]), (3, 2, [-0.5])]
    assert mined(spark, few, 100) == brute_force(few, lambda i: i % 100 == 0) != []


def test_intervals_hold_every_score():
    pick = np.random.default_rng(3)
    values = pick.integers(-300, 300, (500, 24))
    labels = np.sort(pick.integers(0, 3, 500)).astype(str)
    turned = np.ascontiguousarray(values.T)
    block = hard_negatives.Block({
        "rids": np.arange(500).tobytes(), "ids": np.arange(500).tobytes(), "known": np.ones(500, bool).tobytes(),
        "labels": ["0", "1", "2"], "ends": np.cumsum(np.unique(labels, return_counts=True)[1]).tolist(),
        "least": turned.min(axis=1).tolist(), "most": turned.max(axis=1).tolist(), "dims": [line.tobytes() for line in turned],
    })
    anchor, bitmap, widths = values[7], labels == "1", []

    def left(lower, upper):
        exact = (values @ anchor)[bitmap]
        assert (lower <= exact).all() and (exact <= upper).all()
        widths.append(int((upper - lower).max()))
        return np.ones(len(lower), bool)

    rows, scores = block.scan(anchor, bitmap, left)
    assert scores.tolist() == (values @ anchor)[rows].tolist() and rows.tolist() == np.flatnonzero(bitmap).tolist()
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0


def test_the_bitmap_shrinks_before_the_last_dimension(spark):
    rows = vectors(3000, 32, 5)
    values = hard_negatives.matrix([np.floor(256 * np.array(row[2])).astype(int) for row in rows], 32)
    turned = np.ascontiguousarray(values.T)
    block = hard_negatives.Block({
        "rids": np.arange(3000).tobytes(), "ids": np.arange(3000).tobytes(), "known": np.ones(3000, bool).tobytes(), "labels": ["x"], "ends": [3000],
        "least": turned.min(axis=1).tolist(), "most": turned.max(axis=1).tolist(), "dims": [line.tobytes() for line in turned],
    })
    sizes = []

    def left(lower, upper):
        sizes.append(len(lower))
        return upper >= hard_negatives.reach(lower, 5)

    block.scan(values[0], block.labelled("x"), left)
    assert sizes[0] == 3000 and sizes[-1] < 300


def test_components_that_leave_64_bits_are_refused():
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.matrix([np.array([1 << 32])], 1)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 10) == mined(spark, [(5, 1, [0.5])], 10) == mined(spark, [(0, 1, [0.5])], 10) == mined(spark, [(0, 1, [])], 10) == []


def test_labels_of_every_seventh_row_are_moved_on(spark):
    frame = spark.createDataFrame([(0, 9, [1.0]), (1, 0, [0.9]), (7, 1, [0.5]), (8, 9, [0.5]), (9, 3, [0.1])], "vec_id long, label int, embedding array<float>")
    got = sorted(map(tuple, hard_negatives.report(frame).collect()))
    assert [(row[0], row[1], row[3]) for row in got] == [(0, 1, 7), (0, 1, 8)]
