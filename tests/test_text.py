from __future__ import annotations

import random

from pyspark.sql import functions as F

from codelens.functions import text


def column(spark, values, kind, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"at int, x {kind}").select("at", expression.alias("y"))
    return [row["y"] for row in sorted(rows.collect())]


def test_blank_set_is_pythons():
    assert text.BLANKS == "".join(chr(p) for p in range(0x110000) if chr(p).isspace())


def test_strip_equals_python(spark):
    values = [f"{chr(p)}{chr(p)}a {chr(p)}b{chr(p)}" for p in (*text.BLANK_CODE_POINTS, 8203, 65279, 0x180E)]
    values += ["", " ", text.BLANKS, "x"]
    assert column(spark, values, "string", text.strip(F.col("x"))) == [v.strip() for v in values]


def test_is_blank_counts_null_as_blank(spark):
    assert column(spark, [None, "", " \u3000", "a"], "string", text.is_blank(F.col("x"))) == [True, True, True, False]


def test_one_decimal_equals_python_format(spark):
    pick = random.Random(3)
    values = [n / 4 for n in range(401)] + [n / 20 for n in range(2001)] + [n / 100 for n in range(0, 10001, 5)]
    values += [pick.uniform(0, 100) for _ in range(3000)] + [0.05, 0.15, 72.35, 99.95, 99.949999999999, 1e-9]
    assert column(spark, values, "double", text.one_decimal(F.col("x"))) == [float(f"{v:.1f}") for v in values]


def test_tokens_keep_the_layout(spark):
    values = ["a b", "  def f():\n\treturn 1 \n\n", "", " \n ", "\u00a0x\u2028y", "one"]
    got = column(spark, values, "string", text.tokens_with_lead(F.col("x")))
    assert [len(tokens) for tokens in got] == [len(v.split()) for v in values]
    assert ["".join(tokens) for tokens in got] == [v.rstrip() if v.strip() else "" for v in values]


def test_many_trailing_blanks_take_no_time(spark):
    values = ["x" + " " * 2_000_000]
    assert column(spark, values, "string", F.size(text.tokens_with_lead(F.col("x")))) == [1]


def test_cut_and_title(spark):
    assert column(spark, ["abcd", "abc", ""], "string", text.cut(F.col("x"), 3)) == ["abc...", "abc", ""]
    words = ["insufficient_data", "stable", "WEB dev", "web-api", "3d art", "it's", "", "\u4e2da", "\u00e9t\u00e9"]
    assert column(spark, words, "string", text.title(F.col("x"))) == [w.title() for w in words]
