from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codelens.llm import ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    """Every query against every document, from the formula alone."""
    counted = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counted = [(doc_id, own) for doc_id, own in counted if own]
    n_docs, n_terms = len(counted), sum(own.total() for _, own in counted)
    df = Counter(term for _, own in counted for term in own)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, own in counted:
            m = 100 - 75 + (75 * own.total() * n_docs) // n_terms
            score = 0
            for term in terms_of(text):
                if own[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * own[term]) // (1000 * own[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if unknown else doc_id, -score) for rank, (score, unknown, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10, parts=4):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, number int").repartition(parts)
    items = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    return sorted(map(tuple, ranked_search.search(docs, items, k).collect()), key=repr)


def texts(seed, n, vocabulary=60):
    pick = random.Random(seed)
    words = [f"w{at}" for at in range(vocabulary)] + ["É", "Straße", "中文", "X9"]
    weights = [1 / (at + 1) for at in range(len(words))]
    return [" ".join(pick.choices(words, weights, k=pick.choice([0, 1, 3, 10, 40]))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 50)  # several blocks of queries
    docs = list(enumerate(texts(1, 400)))
    docs += [(3, docs[3][1]), (None, "w1 w2 w3"), (None, None), (7001, "W1, w2; É"), (7000, "W1, w2; É"), (7002, ""), (9000, "w5 " * 4000 + "w6 " * 3)]
    items = list(enumerate(texts(2, 30))) + [(5, "w1 w1 w1 w3"), (None, "É w2"), (88, None), (89, ""), (90, "unknown words")]
    assert found(spark, docs, items, k) == brute_force(docs, items, k)


def test_ties_at_the_last_rank_go_to_the_smallest_ids(spark):
    docs = [(at, "same words here") for at in range(200, 0, -1)] + [(500, "other text")]
    rows = found(spark, docs, [(1, "words same")], 10, parts=5)
    assert [row[2] for row in sorted(rows, key=lambda row: row[1])] == list(range(1, 11))
    assert rows == brute_force(docs, [(1, "words same")])


def test_a_very_long_text_is_counted_in_pieces(monkeypatch):
    text = ("Ab" * 40 + " c9 é,") * 500
    whole = ranked_search.count_terms(text.encode())
    monkeypatch.setattr(ranked_search, "PIECE", 64)
    assert ranked_search.count_terms(text.encode()) == whole == Counter(term.encode() for term in terms_of(text))


def test_reading_stops_early(monkeypatch):
    """Lists in which all that matters was seen are not read to their end."""
    n = 20_000
    impacts = np.concatenate([[900, 800], np.full(n - 2, 5), [900, 800], np.full(n - 2, 5)])
    docs = np.concatenate([np.arange(n), np.arange(n)])
    block = ranked_search.Lists(np.repeat([0, 1], n), docs, impacts, 2, np.arange(n), np.ones(n, bool))
    read = []
    add = np.add.at

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            @staticmethod
            def at(into, where, what):
                read.append(len(where))
                add(into, where, what)

    monkeypatch.setattr(ranked_search, "np", Counting())
    best = block.search(np.array([0, 1]), np.array([1, 1]), 2, (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)))
    assert best[0].tolist() == [1800, 1600] and best[1].tolist() == [0, 1] and sum(read) < n / 10


def test_length_factor_beyond_64_bits():
    n = np.array([1, 10**9, 3 * 10**12])
    assert ranked_search.length_factors(n, 10**11, 10**14).tolist() == [25 + 75 * int(x) * 10**11 // 10**14 for x in n]


def test_empty_tables(spark):
    one, none = [(1, "a b")], []
    assert found(spark, none, one) == found(spark, one, none) == found(spark, [(1, None)], one) == []
