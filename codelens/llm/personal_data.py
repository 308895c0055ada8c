"""Personal data, also where it is disguised, with its place in the source text.

Four kinds are looked for: mail addresses, IPv4 addresses, payment card numbers and
phone numbers. ``detect`` finds them in a text as it is. Disguises are undone by
transducers, each a rewriting of some stretches of a text that remembers where each
stretch came from (``Rewritten``); run one after the other they compose, so any
place in the last text has its place in the first:

1. characters: look-alikes from other scripts and compatibility forms (full-width
   letters, digits of any script, styled letters, odd dashes and dots) become ASCII,
   invisible characters go;
2. at and dot: ``(at)``, ``[dot]``, ``&#64;`` and the like; the bare words, and signs
   with spaces around them, only where an address with a disguised dot follows;
3. digits: runs of spelled digits (``plus four nine double one``), of digits and
   letters that look like them (``4l5O``), and of octets joined by the word "dot".

What is then detected, and holds something rewritten, is mapped back and added; spans
of the plain text always stay. A kind's spans are reported by start, then end. Offsets
count code points, ends are exclusive.

One narrow stage, no shuffle; patterns are linear in the length of a text, so a
hostile line or a very long text costs one pass of each. Null and empty texts have no
spans. Repeated rows, and rows with a null id, are reported each. Only the named
columns are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import few_rows

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: long, end: long, found: string, disguised: boolean>>"

# Possessive repeats never give back, so no pattern looks at a character more than a few times.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9](?:[ ().-]*+[0-9])++")
NOT_DIGITS = re.compile(r"[^0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _mails(text: str) -> Iterator[Span]:
    """From each sign back over the longest local part, on over the longest domain."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            done = domain.end()
            yield Span("email", start, done)
        sign = text.find("@", max(sign + 1, done))


def luhn(digits: str) -> bool:
    """Every second digit from the right counts double, in its cross sum."""
    numbers = [int(digit) for digit in reversed(digits)]
    return sum(numbers[::2] + [number * 2 - 9 * (number > 4) for number in numbers[1::2]]) % 10 == 0


def _octet(digits: str) -> bool:
    significant = digits.lstrip("0")
    return len(significant) <= 3 and int(significant or "0") <= 255


def detect(text: str) -> list[Span]:
    """All spans of the text as it is, kind by kind."""
    spans = list(_mails(text))
    spans += [Span("ip", *m.span()) for m in ADDRESS.finditer(text) if all(map(_octet, m[0].split(".")))]
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16 and 16 <= len(digits := NOT_DIGITS.sub("", match[0])) <= 19 and luhn(digits):
            spans.append(Span("card", *match.span()))
    for match in PHONE.finditer(text) if "+" in text else ():
        # A digit, something, a digit; the number of digits holds with or without signs between.
        if match.end() - match.start() >= 4 and 8 <= len(NOT_DIGITS.sub("", match[0])) <= 15:
            spans.append(Span("phone", *match.span()))
    return spans


class Rewritten:
    """A text in which stretches were replaced, and where each came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement) in the text before, in order, apart."""
        pieces, self.starts, self.edits, at, length = [], [], edits, 0, 0
        for start, end, new in edits:
            pieces += [text[at:start], new]
            length += start - at
            self.starts.append(length)
            length += len(new)
            at = end
        self.text = "".join([*pieces, text[at:]])

    def before(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the text before that ``start`` to ``end`` came from; whole stretches where it cuts a replacement."""
        return self._source(start)[0], self._source(end - 1)[1]

    def _source(self, at: int) -> tuple[int, int]:
        """Where one character came from."""
        number = bisect_right(self.starts, at) - 1
        if number < 0:
            return at, at + 1
        start, end, new = self.edits[number]
        inside = at - self.starts[number]
        return (start, end) if inside < len(new) else (end + inside - len(new), end + inside - len(new) + 1)


# Letters of other scripts that look like ASCII letters, by the ASCII letter.
LOOK_ALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    ".": "。·․۔", "-": "‐‑‒–—−", "@": "ⓐ",
}
# Code points that are not seen.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# The digits from 0 in English, German, French and Spanish.
DIGIT_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
# Other words in spelled numbers.
ZERO_WORDS, PLUS_WORDS, TIMES = ("oh",), ("plus", "más"), {"double": 2, "triple": 3}
# The words for the signs in addresses.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "point", "punto")


@lru_cache(maxsize=1)
def characters() -> dict[int, str]:
    """Each character that stands for an ASCII one.

    Decimal digits of any script and single-character compatibility forms follow
    from Unicode's own tables, which have them in the first two planes; Latin
    letters with accents stay as they are.
    """
    table = {}
    for point in range(0x80, 0x20000):
        digit = unicodedata.decimal(chr(point), None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", chr(point))
        if len(plain) == 1 and " " <= plain <= "~":
            table[point] = plain
    return table | {ord(char): plain for plain, alike in LOOK_ALIKES.items() for char in alike}


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Such characters, as ranges of code points."""
    ranges: list[list[int]] = []
    for point in sorted(characters()):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return re.compile("[" + "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges) + "]")


UNSEEN = re.compile(f"[{INVISIBLE}]+")


def plain_characters(text: str) -> Rewritten:
    """One for one, so that places stay, and without what is not seen."""
    if text.isascii():
        return Rewritten(text, [])
    plain = text.translate(characters()) if _odd().search(text) else text
    return Rewritten(plain, [(*run.span(), "") for run in UNSEEN.finditer(plain)])


_BLANK = r"[ \t]{0,3}"
_WORD = r"[A-Za-z0-9-]"


def _signs(words: tuple[str, ...], sign: str, codes: str) -> tuple[str, str]:
    """Patterns of a sign in brackets or as a character reference, and of it bare or apart."""
    names = "|".join([*words, re.escape(sign)])
    strong = rf"{_BLANK}(?:\((?:{_BLANK}(?:{names}){_BLANK})\)|\[(?:{_BLANK}(?:{names}){_BLANK})\]|\{{(?:{_BLANK}(?:{names}){_BLANK})\}}|<(?:{_BLANK}(?:{names}){_BLANK})>|{codes}){_BLANK}"
    return strong, rf"[ \t]{{1,3}}(?:{names})[ \t]{{1,3}}"


STRONG_AT, BARE_AT = _signs(AT_WORDS, "@", r"&#0{0,4}64;|&#x0{0,4}40;|&commat;")
STRONG_DOT, BARE_DOT = _signs(DOT_WORDS, ".", r"&#0{0,4}46;|&#x0{0,4}2e;|&period;")
SIGN = re.compile(rf"{STRONG_AT}|{BARE_AT}|@", re.IGNORECASE)
IS_STRONG = re.compile(STRONG_AT, re.IGNORECASE)
LABELS = re.compile(rf"{_WORD}++(?:\.{_WORD}++)*+")
NEXT_DOT = re.compile(rf"{STRONG_DOT}|{BARE_DOT}", re.IGNORECASE)
# A disguised address has a bracket, a character reference, or its dot is a word or stands apart.
HINTS = ("(", "[", "{", "<", "&", " . ", "\t.", *DOT_WORDS)


def signs(text: str) -> Rewritten:
    """Disguised signs of addresses; bare words only where a disguised dot follows."""
    edits: list[tuple[int, int, str]] = []
    lowered = text.casefold()
    if not any(hint in lowered for hint in HINTS):
        return Rewritten(text, edits)
    for match in SIGN.finditer(text):
        least = edits[-1][1] if edits else 0
        if match.start() <= least or text[match.start() - 1] not in LOCAL:
            continue
        dots, labels = [], LABELS.match(text, match.end())
        while labels and (dot := NEXT_DOT.match(text, labels.end())) and (after := LABELS.match(text, dot.end())):
            dots.append((*dot.span(), "."))
            labels = after
        if labels and (dots or IS_STRONG.fullmatch(match[0])):
            edits += [*_dots_before(text, match.start(), least), *([] if match[0] == "@" else [(*match.span(), "@")]), *dots]
    return Rewritten(text, edits)


def _dots_before(text: str, end: int, least: int) -> list[tuple[int, int, str]]:
    """Dots spelled in the local part: ``jane dot doe at ...``."""
    found: list[tuple[int, int, str]] = []
    while True:
        start = end
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        window = max(least, start - 24)
        dot = next((m for m in NEXT_DOT.finditer(text, window, start) if m.end() == start), None) if start < end else None
        if not dot or dot.start() <= least or text[dot.start() - 1] not in LOCAL:
            return found[::-1]
        found.append((*dot.span(), "."))
        end = dot.start()


_DIGIT = {word: str(digit) for words in DIGIT_WORDS for digit, word in enumerate(words)} | {word: "0" for word in ZERO_WORDS}
_UNIT = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{'|'.join(sorted(_DIGIT, key=len, reverse=True))})(?!\w)|[0-9]+"
_BETWEEN = rf"{STRONG_DOT}|{BARE_DOT}|[ ,-]{{1,2}}|\."
SPELLED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS_WORDS)})[ -]|\+ ?)?(?:{_UNIT})(?:(?:{_BETWEEN})(?:{_UNIT}))++", re.IGNORECASE)
PART = re.compile(rf"(?P<plus>(?:{'|'.join(PLUS_WORDS)})[ -]|\+ )|(?P<times>{'|'.join(TIMES)})[ -]|(?P<word>{'|'.join(sorted(_DIGIT, key=len, reverse=True))})|(?P<dot>{STRONG_DOT}|{BARE_DOT})|(?P<comma>, ?)|(?P<point>\.)|[0-9]+|[ -]", re.IGNORECASE)
SIGNS_IN_NUMBERS = {"plus": "+", "dot": ".", "comma": " "}
ALIKE = re.compile(r"(?<=[0-9])[OoIl|]+(?=[0-9])")


def digits(text: str) -> Rewritten:
    """Spelled digits in runs of two at least, or after a plus; disguised dots between four numbers;
    letters between digits that look like digits."""
    edits = [(*match.span(), "".join("0" if char in "Oo" else "1" for char in match[0])) for match in ALIKE.finditer(text)]
    for run in SPELLED.finditer(text):
        parts = list(PART.finditer(text, *run.span()))
        kinds = [part.lastgroup for part in parts]
        words, dots = kinds.count("word"), kinds.count("dot")
        if words < 2 and not (words and "plus" in kinds) and not (dots and dots + kinds.count("point") >= 3):
            continue
        times, start = 1, 0
        for part, kind in zip(parts, kinds):
            if kind == "times":
                times, start = TIMES.get(part["times"].casefold(), 1), part.start()
            elif kind == "word" and (digit := _DIGIT.get(part[0].casefold())):
                edits.append((start if times > 1 else part.start(), part.end(), digit * times))
                times = 1
            elif kind in SIGNS_IN_NUMBERS:
                edits.append((*part.span(), SIGNS_IN_NUMBERS[kind]))
    return Rewritten(text, sorted(edits))


STEPS = (plain_characters, signs, digits)


def find(text: str) -> list[tuple[Span, str, bool]]:
    """Every span with its plain form, and if it was disguised; kind by kind, by start."""
    found = {span: (text[span.start : span.end], False) for span in detect(text)}
    done, current = [], text
    for step in STEPS:
        rewritten = step(current)
        done += [rewritten] if rewritten.edits else []
        current = rewritten.text
    for span in detect(current) if current != text else ():
        start, end = span.start, span.end
        for step in reversed(done):
            start, end = step.before(start, end)
        if text[start:end] != current[span.start : span.end]:
            found.setdefault(Span(span.kind, start, end), (current[span.start : span.end], True))
    return [(span, *found[span]) for span in sorted(found, key=lambda span: (KINDS.index(span.kind), *span[1:]))]


def mask(text: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first."""
    pieces, at = [], 0
    for start, end, kind in sorted((span.start, span.end, span.kind) for span, _, _ in find(text)):
        if start >= at:
            pieces += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: each text's spans, with what they say in plain characters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL(f"spans {SPANS}").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string()), ("disguised", pa.bool_())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            spans = [[(*span, plain, disguised) for span, plain, disguised in find(text.as_py() or "")] for text in batch.column(1)]
            listed = pa.array([[dict(zip(("kind", "start", "end", "found", "disguised"), row)) for row in own] for own in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=schema.names)

    return rows.mapInArrow(look, schema)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind; null stays null."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if text is None else mask(text) for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """Spans of each kind counted, added ones included; the plain text's spans as a digest, all spans as a list."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("spans", lambda x: ~x["disguised"]), said), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return personal_data(docs).select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )
