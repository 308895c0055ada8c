"""Facts about the lines of a code text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codelens.functions import vocab
from codelens.functions.rules import add, literal
from codelens.functions.text import BLANKS

_BLANKS = literal(BLANKS)


def add_line_facts(df: DataFrame, code: str) -> DataFrame:
    """Adds ``_code`` (never null), ``_blank`` and the line facts.

    Every line is left-stripped once; all facts come from the lines and their
    stripped forms. Unused facts, and what only they need, leave the plan.
    """
    df = add(df, _code=f"coalesce({code}, '')")
    df = add(df, _blank=f"btrim(_code, {_BLANKS}) = ''", _lines=r"split(_code, r'\n')")
    df = add(df, _bare=f"transform(_lines, line -> trim(LEADING {_BLANKS} FROM line))")
    return add(
        df,
        _n_lines="size(_lines)",
        _n_nonblank="size(filter(_bare, line -> line != ''))",
        _n_indents=(
            "size(array_distinct(filter("
            "zip_with(_lines, _bare, (line, bare) -> if(bare = '', 0, length(line) - length(bare))),"
            " width -> width > 0)))"
        ),
        _n_long=f"size(filter(_lines, line -> length(line) > {vocab.LINE_WIDTH}))",
        _commented="exists(_bare, line -> startswith(line, '#'))",
    )
