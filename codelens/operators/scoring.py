"""Scores code rows on five scales and grades the weighted total.

Every scale is a sum of conditions over the same few facts, so the facts are
computed once per row as columns and the scales, the total and the feedback
lists are plain expressions over them. A caller that selects only some of the
scales gets a plan without the others' facts, down to leaving out the parser.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions import python_ast, vocab
from codelens.functions.rules import (
    add,
    contains_any,
    in_one_line,
    ladder,
    literal,
    points,
    texts_that_hold,
)
from codelens.operators.analysis import ANALYSIS, analyse
from codelens.operators.lines import add_line_facts

SCALES = tuple(vocab.WEIGHTS)
FEEDBACK = ("syntax_errors", "style_issues", "positive_features", "suggestions")

_PARSED = f"({ANALYSIS}.status = '{python_ast.OK}')"
_REFUSED = f"({ANALYSIS}.status = '{python_ast.SYNTAX}')"
_ASKED = {word: f"_asked_{word}" for word in vocab.CONCEPTS}
_MET = {word: f"_met_{word}" for word in vocab.CONCEPTS}
_PATTERNS = {
    words: "_uses_" + re.sub(r"\W+", "_", words.lower())
    for words in (*vocab.EFFICIENT, *vocab.INEFFICIENT)
}
_EFFICIENT = [(_PATTERNS[words], words) for words in vocab.EFFICIENT]
_INEFFICIENT = [(_PATTERNS[words], words) for words in vocab.INEFFICIENT]


def _scale(gained: str) -> str:
    """A sum of points, kept between 0 and 100, and 0 for blank code."""
    return f"CASE WHEN _blank THEN 0D ELSE CAST(greatest(least({gained}, 100), 0) AS DOUBLE) END"


def _for_code(pairs: list[tuple[str, str]]) -> str:
    return texts_that_hold((f"NOT _blank AND {flag}", words) for flag, words in pairs)


def _add_facts(df: DataFrame, code: str, instruction: str) -> DataFrame:
    df = add_line_facts(df, code)
    df = add(df, _wish=f"lower(coalesce({instruction}, ''))", _lower="lower(_code)")
    df = add(
        df,
        **{_ASKED[word]: contains_any("_wish", [word]) for word in vocab.CONCEPTS},
        **{
            _PATTERNS[words]: in_one_line("_code", pieces)
            for words, pieces in {**vocab.EFFICIENT, **vocab.INEFFICIENT}.items()
        },
    )
    df = add(df, **{
        _MET[word]: f"{_ASKED[word]} AND {contains_any('_lower', shown)}"
        for word, shown in vocab.CONCEPTS.items()
    })
    return add(
        df,
        _n_asked=points((flag, 1) for flag in _ASKED.values()),
        _n_met=points((flag, 1) for flag in _MET.values()),
        _good_names=(
            f"{_PARSED} AND {ANALYSIS}.n_meaningful > {ANALYSIS}.n_names * {vocab.MEANINGFUL_SHARE}D"
        ),
        _one_style=f"_n_indents BETWEEN 1 AND {vocab.INDENT_WIDTHS}",
        _docstring=contains_any("_code", ('"""', "'''")),
        _hinted="contains(_code, ':') AND contains(_code, '->')",
    )


def add_scores(
    df: DataFrame, code: str = "generated_code", instruction: str = "instruction"
) -> DataFrame:
    """Adds the five scales, total, grade, complexity, length and feedback lists."""
    original = [name for name in df.columns if name != ANALYSIS]
    if ANALYSIS not in df.columns:
        df = analyse(df, code)
    df = _add_facts(df, code, instruction)
    all_met = "(_n_asked > 0 AND _n_asked = _n_met)"

    syntax = points([
        (f"{ANALYSIS}.has_function", 10), (f"{ANALYSIS}.has_class", 10), (f"{ANALYSIS}.has_import", 5),
    ])
    functionality = points([(all_met, 20)])
    style = points([("_one_style", 10), ("_good_names", 10), ("_commented", 10), ("_n_long = 0", 5)])
    efficiency = points(
        [(flag, 5) for flag, _ in _EFFICIENT] + [(flag, -10) for flag, _ in _INEFFICIENT]
    )
    documentation = points([("_docstring", 30), ("_commented", 20), ("_hinted", 10)])

    df = add(
        df,
        syntax_score=_scale(f"CASE WHEN {_PARSED} THEN 80 + {syntax} WHEN {_REFUSED} THEN 20 ELSE 10 END"),
        functionality_score=_scale(f"50 + 10 * _n_met + {functionality}"),
        style_score=_scale(f"60 + {style}"),
        efficiency_score=_scale(f"70 + {efficiency}"),
        documentation_score=_scale(f"40 + {documentation}"),
        code_length="length(_code)",
        complexity_estimate=(
            f"CASE WHEN _n_nonblank < {vocab.COMPLEXITY_MEDIUM} THEN 'low'"
            f" WHEN _n_nonblank < {vocab.COMPLEXITY_HIGH} THEN 'medium' ELSE 'high' END"
        ),
        syntax_errors=(
            f"CASE WHEN _blank THEN array({literal(vocab.EMPTY_CODE)})"
            f" WHEN {_PARSED} THEN CAST(array() AS ARRAY<STRING>)"
            f" WHEN {_REFUSED} THEN array({literal(vocab.SYNTAX_ERROR)} || {ANALYSIS}.error)"
            f" ELSE array({literal(vocab.PARSE_ERROR)} || {ANALYSIS}.error) END"
        ),
        style_issues=_for_code([
            (f"_n_indents > {vocab.INDENT_WIDTHS}", vocab.INDENT_ISSUE),
            (f"{_PARSED} AND NOT _good_names", vocab.NAMES_ISSUE),
            (f"_n_long > _n_lines * {vocab.LONG_LINE_SHARE}D", vocab.WIDTH_ISSUE),
        ]),
        positive_features=_for_code([
            (f"{ANALYSIS}.has_function", vocab.HAS_FUNCTIONS),
            (f"{ANALYSIS}.has_class", vocab.HAS_CLASSES),
            (f"{ANALYSIS}.has_import", vocab.HAS_IMPORTS),
            *[(flag, vocab.IMPLEMENTS + word) for word, flag in _MET.items()],
            (all_met, vocab.ALL_MET),
            ("_one_style", vocab.INDENT_OK),
            ("_good_names", vocab.NAMES_OK),
            ("_commented", vocab.COMMENTS_OK),
            ("_n_long = 0", vocab.WIDTH_OK),
            *_EFFICIENT,
            ("_docstring", vocab.DOCSTRINGS_OK),
            ("_commented", vocab.INLINE_COMMENTS_OK),
            ("_hinted", vocab.TYPE_HINTS_OK),
        ]),
        suggestions=_for_code([
            *[(f"{_ASKED[word]} AND NOT {_MET[word]}", vocab.CONSIDER_CONCEPT + word) for word in _MET],
            *_INEFFICIENT,
        ]),
    )
    df = add(df, total_score=" + ".join(f"{scale} * {weight}D" for scale, weight in vocab.WEIGHTS.items()))
    df = add(df, grade=ladder("total_score", vocab.GRADES, vocab.LOWEST_GRADE))
    return df.select(
        *original, *SCALES, "total_score", "grade", *FEEDBACK, "code_length", "complexity_estimate"
    )


def score_rows(submissions: DataFrame) -> DataFrame:
    """Submissions as history rows.

    ``seq`` gives the arrival order and comes from the caller. The time of rows
    that carry none is the time of this job.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = F.col("timestamp") if "timestamp" in submissions.columns else F.lit(None).cast("string")
    stamped = submissions.withColumn("timestamp", F.coalesce(given, now))
    scored = add_scores(stamped).withColumn("scored_at", F.try_to_timestamp("timestamp"))
    return scored.select(
        "seq", "instruction", "generated_code", "timestamp", *SCALES, "total_score", "grade",
        *FEEDBACK, "code_length", "complexity_estimate", "category", "scored_at",
    )
