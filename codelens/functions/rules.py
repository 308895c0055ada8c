"""Building blocks of point rules, as Spark SQL expressions.

The rules are tables of words and points, so they are written out as SQL text:
one call hands a whole rule to Spark, where the column functions would need
thousands of small calls to build the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(df: DataFrame, **expressions: str) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


def literal(words: str) -> str:
    """A raw SQL string: nothing in it is an escape."""
    quote = '"' if "'" in words else "'"
    if quote in words:
        raise ValueError("text with both kinds of quotes")
    return f"r{quote}{words}{quote}"


def contains_any(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(word)})" for word in words) + ")"


def in_one_line(column: str, pieces: tuple[str, ...]) -> str:
    """Whether some line contains all pieces, one after the other.

    Taking the earliest place for each piece finds a match whenever there is
    one, so nothing needs to be tried twice: the pattern starts only at line
    starts and its atomic groups never give back. A long line costs one pass,
    where ``a.*b.*c`` tried from every ``a`` costs a power of its length. Texts
    that lack a piece altogether are settled by plain substring tests.
    """
    present = " AND ".join(contains_any(column, [piece]) for piece in dict.fromkeys(pieces))
    if len(pieces) == 1:
        return present
    steps = "".join(f"(?>[^\\n]*?{re.escape(piece)})" for piece in pieces)
    return f"({present} AND rlike({column}, {literal(f'(?dm)^{steps}')}))"


def points(pairs: Iterable[tuple[str, int]]) -> str:
    """The sum of the values whose condition is true."""
    return "(" + " + ".join(f"CASE WHEN {flag} THEN {value} ELSE 0 END" for flag, value in pairs) + ")"


def ladder(value: str, steps: dict[str, int], lowest: str) -> str:
    """The first name whose least value is reached, best first."""
    arms = " ".join(f"WHEN {value} >= {least} THEN {literal(name)}" for name, least in steps.items())
    return f"CASE {arms} ELSE {literal(lowest)} END"


def texts_that_hold(pairs: Iterable[tuple[str, str]]) -> str:
    """The texts whose condition is true, in order."""
    items = ", ".join(f"CASE WHEN {flag} THEN {literal(words)} END" for flag, words in pairs)
    return f"array_compact(array({items}))"
