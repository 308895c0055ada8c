from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from codelens.llm import decontaminate
from codelens.llm.common import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        own = words(text)
        size = min(len(own), 13)
        for at in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[at : at + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(window) for window in windows}:
            for at in range(len(own) - size + 1):
                if ids := windows.get(tuple(own[at : at + size])):
                    hit |= set(range(at, at + size))
                    found |= ids
        found = sorted(str(x) for x in found - {None})
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(6)
    pool = [f"w{n}" for n in range(60)] + ["the"] * 30 + ["É", "é", "ß", "naïve", "12"]
    text = lambda n: " ".join(rng.choice(pool, n))
    items = [(n, text(int(rng.integers(13, 40)))) for n in range(30)]
    items += [(100, "Short one here"), (101, "solo"), (102, None), (103, " .!? "), (None, text(20)), (104, items[0][1]), (0, items[0][1]), (105, "the " * 30)]
    items += [(106, " ".join(items[3][1].split()[:14])), (107, " ".join(f"e{n}" for n in range(12)))]
    docs = [(1, None), (2, ""), (3, "Solo."), (4, "nothing at all"), (5, "The THE the " * 40), (None, items[2][1]), (6, "SHORT, one: here")]
    for n in range(60):
        parts = [text(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            own = (items[int(rng.integers(0, len(items)))][1] or "").split()
            if own:
                begin = int(rng.integers(0, len(own)))
                parts += [", ".join(own[begin : begin + int(rng.integers(10, 40))]).upper() if rng.random() < 0.5 else " ".join(own), text(int(rng.integers(0, 200)))]
        docs.append((10 + n, " ".join(parts)))
    docs += [docs[-1], (99, text(30_000) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("max_bytes, n_keys", [(1 << 25, 1 << 22), (0, 1 << 22), (0, 60)])
def test_equals_all_windows(spark, max_bytes, n_keys):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(numbered(left), right, max_bytes, n_keys).drop("rid").collect()
    expected = brute(docs, items)
    assert sorted(map(tuple, got), key=repr) == expected
    assert 10 < sum(row[5] for row in expected) < len(expected) - 10


def test_fingerprints_meet_in_every_window(spark):
    rng = np.random.default_rng(9)
    for vocabulary in (2, 5, 1000):
        shared = [f"s{n}" for n in rng.integers(0, vocabulary, 13)]
        rows = [(n, [f"{n}x{k}" for k in range(n)] + shared + [f"{n}y{k}" for k in range(n)]) for n in (0, 1, 4, 9)]
        marks = decontaminate.winnowed(spark.createDataFrame(rows, "n int, words array<string>")).collect()
        grams = [{tuple(r.words[m & 0xFFFFFFFF :][:8]) for m in r.marks if r.n <= m & 0xFFFFFFFF <= r.n + 5} for r in marks]
        assert set.intersection(*grams)


def test_stage_and_empty_tables(spark):
    docs, items = cases()
    left = spark.createDataFrame([(*row, 1, "x") for row in docs], "doc_id long, text string, rid int, words string")
    right = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean_documents(left, right)
    assert kept.columns == left.columns
    bad = [row for row, judged in zip(docs, [brute([row], items)[0][5] for row in docs]) if judged]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, t in docs if (i, t) not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r)[2:] for r in decontaminate.report(left, none).collect()} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert decontaminate.report(spark.createDataFrame([], "doc_id long, text string"), right).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    frames = [spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "benchmark")]
    decontaminate.report(*frames).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
