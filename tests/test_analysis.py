from __future__ import annotations

import ast

import pyarrow as pa
import pytest

import restatement
import samples
from codelens.functions import python_ast, vocab
from codelens.operators import analysis


def analysed(spark, codes):
    return analysis.analyse(spark.createDataFrame(list(enumerate(codes)), "seq int, generated_code string"))


def by_seq(df):
    return [row.asDict() for row in sorted(df.collect(), key=lambda row: row["seq"])]


def test_features_equal_a_plain_walk(spark):
    codes = samples.codes()
    for code, row in zip(codes, by_seq(analysis.features(analysed(spark, codes)))):
        status, nodes = restatement.parse(code)
        names = [node.id for node in nodes if isinstance(node, ast.Name)]
        assert row["parse_status"] == status, code
        assert row["syntax_valid"] == (status == "ok")
        assert row["has_function"] == any(isinstance(n, ast.FunctionDef) for n in nodes)
        assert row["has_class"] == any(isinstance(n, ast.ClassDef) for n in nodes)
        assert row["has_import"] == any(isinstance(n, (ast.Import, ast.ImportFrom)) for n in nodes)
        assert row["n_names"] == len(names), code
        assert row["n_meaningful"] == sum(len(n) > 2 and not n.startswith("_") for n in names)


@pytest.mark.parametrize("policy", [
    analysis.Policy(),
    analysis.Policy(enable_networking=True),
    analysis.Policy(allow_imports=("os", "sys")),
])
def test_first_violation_equals_a_recursive_visit(spark, policy):
    codes = samples.codes()
    refused = set(vocab.BLOCKED_IMPORTS) - set(policy.allowed)
    for code, row in zip(codes, by_seq(analysis.scan(analysed(spark, codes), policy))):
        status, _ = restatement.parse(code)
        if status == "syntax_error":
            assert row["violation"].startswith("Syntax error: ")
            assert row["scan_error"].startswith("Security violation: Syntax error: ")
            assert not row["is_safe"]
        elif status == "ok":
            expected = restatement.first_refused(
                code, refused, set(vocab.BLOCKED_BUILTINS), set(vocab.BLOCKED_ATTRIBUTES)
            )
            assert row["violation"] == expected, code
            assert row["is_safe"] == (expected is None)


def test_outer_attribute_is_met_first(spark):
    row = by_seq(analysis.scan(analysed(spark, ["a.__class__.__mro__"])))[0]
    assert row["scan_error"] == "Security violation: Blocked attribute access: __mro__"


def test_a_parser_that_gives_up_is_not_safe(spark):
    deep = "x = " + "-" * 100_000 + "1"
    row = by_seq(analysis.scan(analysis.analyse(
        spark.createDataFrame([(0, deep)], "seq int, generated_code string")
    )))[0]
    status, _ = restatement.parse(deep)
    assert not row["is_safe"]
    if status == "other_error":
        assert row["violation"] is None and row["scan_error"].startswith("Sandbox error: ")


def test_long_attribute_chain_is_scanned_to_its_end():
    code = "a" + ".b" * 300 + ".__dict__" + ".c" * 300
    status, _, *_, findings = python_ast.inspect_code(code)
    assert status == "ok" and ("attribute", "__dict__") in findings


def test_native_rules_on_the_inventory(spark):
    codes = ["import os, math\nfrom http.client import x\neval(dir)\na.__dict__.b", "x.eval()", "import numpy"]
    listed = analysis.inventory(analysed(spark, codes))
    rows = by_seq(listed.select(
        "seq", "imports", "calls", "attributes",
        analysis.blocked_imports(listed["imports"]).alias("bad_imports"),
        analysis.blocked_imports(listed["imports"], analysis.Policy(enable_networking=True)).alias("less"),
        analysis.blocked_calls(listed["calls"]).alias("bad_calls"),
        analysis.blocked_attributes(listed["attributes"]).alias("bad_attributes"),
    ))
    assert rows[0]["imports"] == ["http", "math", "os"] and rows[0]["calls"] == ["eval"]
    assert rows[0]["bad_imports"] == ["http", "os"] and rows[0]["less"] == ["os"]
    assert rows[0]["bad_calls"] == ["eval"] and rows[0]["bad_attributes"] == ["__dict__"]
    assert rows[1]["attributes"] == ["eval"] and rows[1]["bad_calls"] == []
    assert rows[2]["bad_imports"] == []


def test_batch_parses_each_distinct_text_once(monkeypatch):
    seen = []
    original = python_ast.inspect_code
    monkeypatch.setattr(python_ast, "inspect_code", lambda code: seen.append(code) or original(code))
    result = python_ast.analyse_batch(pa.array(["a", "b", "a", "a"]))
    assert sorted(seen) == ["a", "b"] and len(result) == 4
    assert python_ast.analyse_batch(pa.array([], pa.string())).to_pylist() == []


def test_null_code_counts_as_empty(spark):
    assert by_seq(analysis.features(analysed(spark, [None])))[0]["parse_status"] == "ok"


def test_usage_and_violation_counts(spark):
    codes = ["import os\nimport os.path\nprint(1)"] * 30 + ["print(2)", "x ="]
    frame = analysed(spark, codes)
    usage = {(r["kind"], r["name"]): r["n_rows"] for r in analysis.usage_counts(frame).collect()}
    assert usage == {("import", "os"): 30, ("call", "print"): 31}
    counts = {r["violation"]: r["n_rows"] for r in analysis.violation_counts(analysis.scan(frame)).collect()}
    assert counts["Blocked import: os"] == 30 and sum(counts.values()) == 31


def test_parsing_distinct_texts_gives_the_same_rows(spark):
    codes = ["import os", "x = = 1", None, ""] + ["def shared(): pass"] * 40
    frame = spark.createDataFrame(list(enumerate(codes)), "seq long, generated_code string").repartition(4)
    once, each = analysis.analyse_distinct(frame), analysis.analyse(frame)
    assert once.columns == each.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect()))
