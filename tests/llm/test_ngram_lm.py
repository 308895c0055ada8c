from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from codelens.llm import ngram_lm

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[a-z0-9\x80-\U0010ffff]+|[^ \t\n\v\f\ra-z0-9\x80-\U0010ffff]")


def plain_tokens(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_good_documents_are_nearer_to_the_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    learned = labels.filter("doc_id % 2 = 0")
    rows = ngram_lm.report(docs, learned).join(labels.filter("doc_id % 2 = 1").dropDuplicates(["doc_id"]), "doc_id").toPandas().dropna()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] < bad[None, :]).mean() > 0.85


def test_no_target_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in ngram_lm.report(docs, none).collect()}
    assert got[1].target_loss is None and got[1].score is None and got[1].background_loss > 0 and got[2].n_tokens == 0
    assert ngram_lm.report(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


ODD = [(None, "the end"), (1000, None), (1001, " \n"), (1002, "Éa-b\x00c É É"), (1003, "x"), (1003, "x"), (1004, "the of " * 60_000), (1005, "seldom seen words"), (1006, "seldom seen words")]


@pytest.mark.parametrize("block, part, fan", [(1 << 22, 1 << 24, 4096), (3000, 4000, 4096), (3000, 4000, 7), (1, 6000, 3)])
def test_report_keeps_every_token_and_bigram(spark, monkeypatch, block, part, fan):
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(40).collect()] + ODD
    good = {doc_id for doc_id, _ in docs[::3]} | {1005}
    left = spark.createDataFrame([(*row, 1, "x") for row in docs], "doc_id long, text string, block int, data string").repartition(3)
    right = spark.createDataFrame([(doc_id, int(doc_id in good), 9) for doc_id in {i for i, _ in docs}] + [(1005, 0, 1), (7, None, 1)], "doc_id long, quality int, text int")
    own_losses = ngram_lm.whole_losses
    monkeypatch.setattr(ngram_lm, "whole_losses", lambda rows, labels: own_losses(rows, labels, part, fan))
    rows = [tuple(r)[:4] for r in ngram_lm.report(left, right).collect()]
    expected = whole(docs, good - {None})
    key = lambda row: (repr(row[0]), row[1])
    assert len(rows) == len(docs)
    for got, own in zip(sorted(rows, key=key), sorted(expected, key=key)):
        assert got[:2] == own[:2]
        assert np.allclose([x or 0 for x in got[2:]], [x or 0 for x in own[2:]]) and (got[3] is None) == (own[1] == 0)


def whole(docs, good):
    """Losses by models of all tokens and bigrams, each text's own taken out."""
    texts = [plain_tokens(text) for _, text in docs]
    chosen = [[own for (doc_id, _), own in zip(docs, texts) if doc_id in good], texts]
    pairs_of = lambda own: list(zip(["<begin>", *own], own))
    words = [Counter(w for own in side for w in own) for side in chosen]
    pairs = [Counter(pair for own in side for pair in pairs_of(own)) for side in chosen]
    contexts = [Counter(pair[0] for own in side for pair in pairs_of(own)) for side in chosen]
    vocabulary = len(words[1])
    rows = []
    for (doc_id, _), own in zip(docs, texts):
        found = []
        for at in (0, 1):
            mine = int(at == 1 or doc_id in good)
            own_words, own_pairs, own_contexts = Counter(own), Counter(pairs_of(own)), Counter(pair[0] for pair in pairs_of(own))
            total, loss = sum(words[at].values()) - mine * len(own) + vocabulary, 0.0
            for pair in pairs_of(own):
                alone = (words[at][pair[1]] - mine * own_words[pair[1]] + 1) / total
                loss -= math.log((pairs[at][pair] - mine * own_pairs[pair] + 10 * alone) / (contexts[at][pair[0]] - mine * own_contexts[pair[0]] + 10))
            found.append(loss / len(own) if own else None)
        rows.append((doc_id, len(own), *found))
    return rows


def test_texts_that_begin_alike_make_no_large_part(spark):
    """However many texts have a bigram, a block asks for it once."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('all texts begin alike ', id, ' then ', id * 7 % 1000, ' differ') AS text")
    blocks = ngram_lm.blocked(docs)
    sizes = []
    for row in blocks.collect():
        own, n_texts = ngram_lm._texts_of(row.starts, row.data)
        assert own.sums(np.ones(n_texts))[: own.n_pairs].max() == n_texts > 100
        sizes.append(np.bincount(ngram_lm._part_of(own.keys, 16), minlength=16))
    assert np.sum(sizes, axis=0).max() < 2 * np.median(np.sum(sizes, axis=0))


def test_rows_grow_in_proportion(spark, monkeypatch):
    """With groups of blocks, rows between them and the parts are far fewer than blocks times parts."""
    monkeypatch.setattr(ngram_lm, "BLOCK", 400)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(120)
    blocks, labels = ngram_lm.blocked(docs), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    stored = {}
    keep = ngram_lm.store

    def kept(df, purpose):
        stored[purpose] = keep(df, purpose)
        return stored[purpose]

    monkeypatch.setattr(ngram_lm, "store", kept)
    ngram_lm.whole_losses(blocks, labels, 400, 12).count()
    n_blocks, parts = blocks.count(), blocks.selectExpr("sum(octet_length(data)) div 400 + 1").first()[0]
    assert parts > 12 and stored["requests"].count() <= 12 * n_blocks < n_blocks * parts / 10


@pytest.mark.parametrize("width", [6, 8])
def test_keys_are_packed_and_unpacked(width):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 8 * width, 5000, dtype=np.uint64, endpoint=False) if width < 8 else np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for own in (keys, keys[:1], keys[:0]):
        assert (ngram_lm._unpacked(ngram_lm._packed(own, width), width) == own).all()
    assert len(ngram_lm._packed(keys, width)) < (width - 0.8) * len(keys)
