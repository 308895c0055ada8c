from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from codelens.llm import exact_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha256) for each row, sorted."""
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(BLANKS.sub(" ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(own, ids[0], len(ids), at == 0, digest) for at, own in enumerate(ids)]
    return sorted(out, key=repr)


def texts():
    rng = np.random.default_rng(4)
    words = ["alpha", "béta", "\t", "\n\n", "gamma", "ω" * 40, "x"]
    longs = [" ".join(rng.choice(words, 3000)) for _ in range(3)]
    return [
        (1, "a  b"), (2, "a\t\nb"), (3, "a b "), (4, ""), (5, None), (6, " "), (7, "\n"), (None, "a b"), (None, None),
        (8, longs[0]), (9, longs[0].replace(" ", "\r ")), (10, longs[0][:-1] + "y"), (11, longs[1]), (12, longs[2]),
        (13, longs[2]), (13, longs[2]), (14, "z" * 300_000), (15, "z" * 300_000), (16, "z" * 299_999),
    ]


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force_even_if_hashes_clash(spark, bits):
    frame = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = exact_dedup.decisions(exact_dedup.recipes(frame, bits)).drop("rid").collect()
    assert sorted(map(tuple, got), key=repr) == brute(texts())


def test_cuts_depend_on_own_bytes_only():
    rng = np.random.default_rng(1)
    one, other = (rng.integers(97, 123, n, np.uint8) for n in (20_000, 9_000))
    alone = exact_dedup.chunk_ends(exact_dedup.marks(one), 0, len(one))
    both = np.concatenate([other, one])
    after = exact_dedup.chunk_ends(exact_dedup.marks(both), len(other), len(both))
    assert [end - len(other) for end in after] == alone
    assert len(alone) > 8 and max(np.diff([0, *alone])) <= exact_dedup.MOST


def test_keeps_all_columns(spark):
    rows = [(1, "a", 5, None, 7), (2, "a", 6, "x", 8), (3, "b", None, "y", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rid int, recipe string, `a.b` int")
    kept = exact_dedup.exact_dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.report(frame).collect() == [] and exact_dedup.exact_dedup(frame).collect() == []
