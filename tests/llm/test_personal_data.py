from __future__ import annotations

import hashlib
import re
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelens.llm import personal_data as pii

# The contract's patterns, applied as they stand.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        total = 0
        for at, digit in enumerate(reversed(digits)):
            value = int(digit) * (1 + at % 2)
            total += value - 9 if value > 9 else value
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def expected_base(text):
    return [(kind, *m.span()) for kind, pattern in BASE.items() for m in pattern.finditer(text) if passes(kind, m[0])]


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "x@y", "@", ".", "-", " ", "+", "1", "23", "255", "256", "(", ")", "4111 1111-1111 1111", "+1 (555) 010-1234", "é", "%", "_", "1.2.3.4"]), max_size=24))
def test_plain_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert [tuple(span) for span in pii.detect(text)] == expected_base(text)


#: Disguised, and what is meant.
DISGUISED = [
    ("write to john.doe (at) example (dot) com today", "john.doe (at) example (dot) com", "email", "john.doe@example.com"),
    ("write to john at example dot com today", "john at example dot com", "email", "john@example.com"),
    ("jane dot doe [at] mail.example[.]co[.]uk!", "jane dot doe [at] mail.example[.]co[.]uk", "email", "jane.doe@mail.example.co.uk"),
    ("x ana arroba correo punto es y", "ana arroba correo punto es", "email", "ana@correo.es"),
    ("user @ example . com", "user @ example . com", "email", "user@example.com"),
    ("user&#64;example&#46;com", "user&#64;example&#46;com", "email", "user@example.com"),
    ("bob{at}example{dot}org,", "bob{at}example{dot}org", "email", "bob@example.org"),
    ("jоhn@еxample.com", "jоhn@еxample.com", "email", "john@example.com"),
    ("ｊｏｅ＠ｅｘ．ｃｏｍ", "ｊｏｅ＠ｅｘ．ｃｏｍ", "email", "joe@ex.com"),
    ("jo​e@ex​ample.com.", "jo​e@ex​ample.com", "email", "joe@example.com"),
    ("call plus one five five five oh one double two three four now", "plus one five five five oh one double two three four", "phone", "+1 5 5 5 0 1 22 3 4"),
    ("Tel. ＋٤٩ 30 1234567", "＋٤٩ 30 1234567", "phone", "+49 30 1234567"),
    ("+49 30 12‑3456", "+49 30 12‑3456", "phone", "+49 30 12-3456"),
    ("host 192 dot 168 dot one dot one is up", "192 dot 168 dot one dot one", "ip", "192.168.1.1"),
    ("host 10[.]0[.]0[.]7 is up", "10[.]0[.]0[.]7", "ip", "10.0.0.7"),
    ("host 10.0[.]0.7 is up", "10.0[.]0.7", "ip", "10.0.0.7"),
    ("card 4lll 1111 1111 llll", None, "card", None),
    ("card 4l11 1111 1l11 1O12 9", None, "card", None),
    ("card 4l11 1111 1l11 1111 ok", "4l11 1111 1l11 1111", "card", "4111 1111 1111 1111"),
    ("card four one one one one one one one one one one one one one one one", "four one one one one one one one one one one one one one one one", "card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
    ("\U0001d7d2111-1111-1111-1111", "\U0001d7d2111-1111-1111-1111", "card", "4111-1111-1111-1111"),
    ("available at example.com, dot", None, "email", None),
    ("one or two at a time. Then three", None, None, None),
    ("see (at) noon", None, "email", None),
]


@pytest.mark.parametrize("text,source,kind,plain", DISGUISED)
def test_disguises_are_found_in_their_place(text, source, kind, plain):
    added = [(text[span.start : span.end], span.kind, said) for span, said, disguised in pii.find(text) if disguised]
    assert added == ([(source, kind, plain)] if source else [])


def test_plain_spans_stay_beside_added_ones():
    text = "оan.doe@example.com and 1.2.3.4"
    assert [(text[s.start : s.end], hidden) for s, _, hidden in pii.find(text)] == [
        ("оan.doe@example.com", True), ("an.doe@example.com", False), ("1.2.3.4", False),
    ]
    assert pii.mask(text) == "<email> and <ip>"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.о​ 14+[](dot)at１é", max_size=40))
def test_every_place_lies_in_the_text(text):
    spans = pii.find(text)
    assert [span for span, _, hidden in spans if not hidden] == pii.detect(text)
    assert all(0 <= span.start < span.end <= len(text) for span, _, _ in spans)
    assert all((text[span.start : span.end] != plain) == hidden for span, plain, hidden in spans)


def test_hostile_texts_take_linear_time():
    n = 200_000
    for piece in ("a", "1", "1.", "1 ", "+1 ", "@", "a@", " ", "(", " at ", " dot ", "one ", "​a", "о", "a dot ", "[at", "plus ", "double ", "0l", "a . "):
        start = time.time()
        pii.find(piece * (n // len(piece)))
        assert time.time() - start < 8, piece


ROWS = [
    (1, "plain a.b@c.de 1.2.3.4 +1 (555) 010-1234"), (2, None), (3, ""), (None, "x@y.z"), (4, "joe at ex dot com"), (4, "joe at ex dot com"),
    (5, "word " * 300_000 + "4111 1111 1111 1111"),
]


def test_report(spark):
    frame = spark.createDataFrame([(i, t, 7, "s") for i, t in ROWS], "doc_id long, text string, spans int, start string").repartition(3)
    got = sorted(map(tuple, pii.report(frame).collect()), key=repr)
    expected = []
    for doc_id, text in ROWS:
        base = expected_base(text or "")
        spans = [("email", 0, 17)] if doc_id == 4 else base
        counts = [sum(kind == own for own, _, _ in spans) for kind in pii.KINDS]
        expected.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    assert got == sorted(expected, key=repr)
    texts = {r.text for r in pii.masked(frame).filter("doc_id < 5").collect()}
    assert texts == {"plain <email> <ip> <phone>", None, "", "<email>"}
    assert pii.masked(frame).columns == frame.columns


def test_query_equals_the_patterns_on_a_whole_table(spark):
    folder = Path("/root/testdata/sf0.01")
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        base = expected_base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined([span]) for span in base) <= set(row.spans.split(","))
    assert sum(row.n_email for row in rows) > 0 and sum(row.n_card for row in rows) > 0


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
