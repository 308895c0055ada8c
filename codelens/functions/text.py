"""Text measures as Spark columns.

Generated code is judged by rules stated in terms of Python strings, so these
columns give the results of ``str.strip`` and ``format(x, '.1f')``. Plain ``trim`` removes spaces only and Java's ``\\s`` is
ASCII only; neither is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() removes.
BLANK_CODE_POINTS = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
BLANKS = "".join(chr(point) for point in BLANK_CODE_POINTS)

# The same set as the inside of a regular-expression class (Java and RE2).
BLANK_CLASS = "".join(f"\\x{{{point:x}}}" for point in BLANK_CODE_POINTS)

# One token together with the blanks in front of it.
_TOKEN_WITH_LEAD = f"[{BLANK_CLASS}]*+[^{BLANK_CLASS}]++"


def or_empty(text: Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return strip(or_empty(text)) == F.lit("")


def tokens_with_lead(text: Column) -> Column:
    """Whitespace tokens, each with the whitespace before it.

    Joining a prefix of this array gives the text up to that token with its
    layout intact, which matters for code. Blanks at the end are cut off first:
    no token follows them, so the pattern would start anew at each one.
    """
    ended = F.rtrim(text, F.lit(BLANKS))
    return F.regexp_extract_all(ended, F.lit(_TOKEN_WITH_LEAD), F.lit(0))


def cut(text: Column, width: int) -> Column:
    """At most ``width`` characters, with '...' if something was cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def title(text: Column) -> Column:
    """Every run of cased letters with a capital first, as ``str.title`` does.

    ``initcap`` starts words after spaces only, not after '_', '-' or digits.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2))))), ""
    )


def one_decimal(value: Column) -> Column:
    """A non-negative double as ``format(value, '.1f')`` shows it.

    ``bround`` rounds the shortest decimal form, so 72.35 (a little below its
    decimal form in binary) would become 72.4 instead of 72.3. Here the value is
    compared with the midpoint between the two candidates. Both subtractions are
    exact: 16*value and 4*value are exact scalings, and in each subtraction the
    operands are within a factor of two of each other.
    """
    tenths = F.floor(value * F.lit(10.0))
    midpoint = (tenths * 2 + 1).cast("double")
    side = (value * F.lit(16.0) - midpoint) + value * F.lit(4.0)
    up = (side > 0) | ((side == 0) & (tenths % 2 == 1))
    return (tenths + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10.0)
