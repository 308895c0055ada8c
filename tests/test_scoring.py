from __future__ import annotations

import re

import restatement
import samples
from codelens.functions import vocab
from codelens.functions.rules import add, in_one_line, literal
from codelens.operators import lines, scoring


def scored(spark, pairs):
    frame = spark.createDataFrame(
        [(at, instruction, code) for at, (instruction, code) in enumerate(pairs)],
        "seq int, instruction string, generated_code string",
    ).repartition(4)
    return sorted(scoring.add_scores(frame).collect(), key=lambda row: row["seq"])


def test_all_scores_equal_the_restatement(spark):
    codes = samples.codes()
    pairs = [(samples.INSTRUCTIONS[at % len(samples.INSTRUCTIONS)], code) for at, code in enumerate(codes)]
    pairs += [(instruction, code) for instruction in samples.INSTRUCTIONS for code in codes[-20:]]
    for (instruction, code), row in zip(pairs, scored(spark, pairs)):
        parts = restatement.scales(instruction, code)
        assert tuple(row[name] for name in scoring.SCALES) == parts, (instruction, code)
        assert row["total_score"] == restatement.total(parts)
        assert row["grade"] == restatement.grade(restatement.total(parts))
        assert row["complexity_estimate"] == restatement.complexity(code)
        assert row["code_length"] == len(code)


def test_feedback_is_in_rule_order(spark):
    code = (
        'import json\nclass A:\n    """Doc."""\n    def find(self, values) -> int:\n'
        "        # note\n        return [item for item in enumerate(values)]\n"
    )
    row = scored(spark, [("Create a class with a function to sort and return a list", code)])[0]
    assert row["positive_features"] == [
        "Contains function definitions", "Contains class definitions", "Uses imports appropriately",
        "Implements function", "Implements class", "Implements return",
        "Consistent indentation", "Meaningful variable names", "Includes comments",
        "Follows line length guidelines", "Uses list comprehension", "Uses enumerate",
        "Includes docstrings", "Includes inline comments", "Uses type hints",
    ]
    assert row["suggestions"] == ["Consider implementing list", "Consider implementing sort"]
    assert row["syntax_errors"] == [] and row["style_issues"] == []


def test_blank_and_broken_code(spark):
    blank, broken, none = scored(spark, [("sort", "\u00a0\n"), ("print a list", "x = = 1"), ("x", None)])
    for row in (blank, none):
        assert [row[name] for name in scoring.SCALES] == [0.0] * 5 and row["grade"] == "F"
        assert row["syntax_errors"] == ["Empty code"]
        assert row["style_issues"] == row["positive_features"] == row["suggestions"] == []
    assert broken["syntax_score"] == 20.0
    assert broken["syntax_errors"] == ["Syntax error: invalid syntax (<unknown>, line 1)"]
    assert broken["suggestions"] == ["Consider implementing list", "Consider implementing print"]


def test_style_issues(spark):
    mixed = "if x:\n a = 1\nif y:\n  b = 1\nif z:\n   c = 1"
    long = "value = '" + "a" * 90 + "'"
    first, second = scored(spark, [("", mixed), ("", long)])
    assert first["style_issues"] == ["Inconsistent indentation", "Consider more descriptive variable names"]
    assert second["style_issues"] == ["Some lines are too long (>79 characters)"]


def test_line_patterns_equal_the_plain_ones(spark):
    patterns = {
        ("[", "for", "in", "]"): r"\[.*for.*in.*\]", ("(", "for", "in", ")"): r"\(.*for.*in.*\)",
        ("for", "+", "str"): r"for.*\+.*str", ("for", "for"): r"for.*for.*",
        ("enumerate(",): r"enumerate\(", ("set(",): r"set\(",
    }
    assert set(patterns) <= set(vocab.EFFICIENT.values()) | set(vocab.INEFFICIENT.values())
    texts = samples.codes() + samples.noise(2000, seed=11)
    frame = spark.createDataFrame(list(enumerate(texts)), "at int, code string")
    named = {f"p{at}": pieces for at, pieces in enumerate(patterns)}
    rows = add(frame, **{name: in_one_line("code", pieces) for name, pieces in named.items()}).collect()
    for row in rows:
        for name, pieces in named.items():
            assert row[name] == bool(re.search(patterns[pieces], row["code"])), (pieces, row["code"])


def test_patterns_stay_linear_on_hostile_lines(spark):
    hostile = ["[" * 20_000 + " for in " * 20_000, "for" + "+" * 60_000, "(for in" * 30_000]
    frame = spark.createDataFrame([(text,) for text in hostile], "code string")
    pieces = {**vocab.EFFICIENT, **vocab.INEFFICIENT}.values()
    rows = add(frame, **{f"p{at}": in_one_line("code", p) for at, p in enumerate(pieces)}).collect()
    assert len(rows) == 3


def test_line_facts(spark):
    frame = spark.createDataFrame([("a\n\n  b\n\t#c\n" + "x" * 80,), (None,)], "code string")
    first, second = lines.add_line_facts(frame, "code").collect()
    assert (first["_n_lines"], first["_n_nonblank"], first["_n_indents"], first["_n_long"]) == (5, 4, 2, 1)
    assert first["_commented"] and not first["_blank"]
    assert second["_blank"] and second["_n_lines"] == 1 and second["_n_nonblank"] == 0


def test_literal_takes_text_as_it_is(spark):
    for words in ["a\\n", "it's", 'say "x"', "\n", "\u00a0"]:
        assert add(spark.range(1), x=literal(words)).first()["x"] == words


def test_score_rows_keeps_or_sets_the_time(spark):
    given = spark.createDataFrame(
        [(1, "x", "y = 1", "web", "2024-05-06T07:08:09.123456"), (2, "x", "y = 1", "web", None)],
        "seq long, instruction string, generated_code string, category string, timestamp string",
    )
    first, second = sorted(scoring.score_rows(given).collect())
    assert first["timestamp"] == "2024-05-06T07:08:09.123456" and first["scored_at"].microsecond == 123456
    assert len(second["timestamp"]) == 26 and second["scored_at"] is not None
