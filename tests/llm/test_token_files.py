from __future__ import annotations

import numpy as np
import pytest

from codelens.llm import token_files, tokens

TEXTS = [
    (1, "Hello world"), (2, None), (3, ""), (4, "a <|endoftext|> b"), (5, "naïve Ελλάδα 中文 \U0001f600"),
    (6, "word " * 400), (None, "null id"), (7, "twice"), (7, "twice"), (8, " \t\n  \r\n x   "),
]


def plain(text):
    return tokens._slow(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_both_libraries_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    for text in [row.text for row in rows] + [text or "" for _, text in TEXTS] + ["'s 'S it's  12345 　 x" * 9, "q" * 3000]:
        assert tokens.encode(text, tokens.vocabulary()).tolist() == plain(text)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_counts_equal_encoding(spark, block):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    got = token_files.token_counts(frame, block_tokens=block).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((i, len(plain(t))) for i, t in TEXTS), key=repr)
    for number in {r.file_no for r in got}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.file_no == number)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0, *(n + 1 for _, _, n in own[:-1])]).tolist()


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_files_of_others(spark, tmp_path, block):
    cases = {"a": [5, 6, 9, 9, 1, 2, 3], "b": [9], "c": [1, 2, 3, 4, 5, 6, 7], "d": [4] * 12 + [9, 1, 9]}
    for name, ids in cases.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    (tmp_path / "none").touch()
    files = spark.createDataFrame([(f"{tmp_path}/{name}",) for name in [*cases, "none"]], "file string")
    got = token_files.scan(files, end=9, block_tokens=block).collect()
    rows = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.terminated) for r in got)
    assert rows == [
        ("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 3, False), ("b", 0, 0, 0, True),
        ("c", 0, 0, 7, False), ("d", 0, 0, 12, True), ("d", 1, 13, 1, True),
    ]


def test_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_counts(frame).collect() == []
    frame = spark.createDataFrame([(1, "a", "f", 0)], "doc_id long, text string, file string, ordinal int")
    assert [r.n_tokens for r in token_files.token_counts(frame).collect()] == [1]


def test_ids_beyond_16_bits_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "more")], "doc_id long, text string")
    small, large = (sorted(map(tuple, token_files.token_counts(docs, end=end).select("doc_id", "n_tokens").collect())) for end in (token_files.END, 1 << 20))
    assert small == large and small[1] == (2, 0)


def test_rows_of_all_documents_are_not_broadcast(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    got = token_files.token_counts(docs)
    assert got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()  # the topmost join is the one with the documents' rows
    assert next(line for line in plan.splitlines() if "Join [" in line).strip(" +-").startswith("SortMergeJoin [file")
