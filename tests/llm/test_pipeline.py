from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from codelens.llm import crf_quality, simhash
from codelens.llm.common import store
from test_decontaminate import brute as contaminated
from test_exact_dedup import BLANKS
from test_packing import ids_of
from test_simhash import plain_classes, plain_print

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, by the operators' rules restated; the classifier's scores are its own."""
    docs, labels, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels", "benchmark"))
    score = {r.doc_id: r.score for r in crf_quality.report(docs, labels).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    steps = [[row for row in rows if score[row[0]] >= 0.3]]
    first = {}
    for doc_id, text in steps[-1]:
        first.setdefault(BLANKS.sub(" ", text or ""), doc_id)
    steps.append([row for row in steps[-1] if row[0] in set(first.values())])
    roots = plain_classes([plain_print(text) for _, text in steps[-1]])
    steps.append([row for at, row in enumerate(steps[-1]) if roots[at] == at])
    bad = {row[0] for row in contaminated(steps[-1], [(r.item_id, r.text) for r in items.collect()]) if row[5]}
    steps.append([row for row in steps[-1] if row[0] not in bad])
    return steps


def test_every_stage(spark, kept):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.dtypes
    for (_, stage), expected in zip(corpus_pipeline.STAGES, kept):
        docs = store(stage(spark, docs, FOLDER), "stage")
        assert docs.dtypes == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == expected
    sizes = [200, *map(len, kept)]
    assert all(before > after > 0 for before, after in zip(sizes, sizes[1:]))


def test_run_packs_what_is_left(spark, kept):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    left = {path.name.rpartition("-")[0] for path in set(shared.iterdir()) - before if path.is_dir()}
    assert left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES}
    sizes = {doc_id: len(ids_of(text)) for doc_id, text in kept[-1]}
    got = {}
    for piece in pieces:
        got[piece.doc_id] = got.get(piece.doc_id, 0) + piece.length
        assert piece.doc_tokens == sizes[piece.doc_id]
    assert got == sizes
    assert max(p.sequence_id for p in pieces) == (sum(sizes.values()) - 1) // 2048


def test_stages_take_odd_rows_and_empty_tables(spark):
    kind = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, " \n", None, "s", 2), (3, "word", None, "s", 4)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, FOLDER), "stage")
        assert (docs.count() > 0) == bool(rows)


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert sum(name.startswith("op") for name in __spark_entry__.queries()) == 13
    assert simhash.BUDGET == 4 and "corpus_pipeline" in sys.modules
