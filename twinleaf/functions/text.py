"""Column functions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnonymizationSettings

#: Fixed value: the characters that count as white space at a line's ends.
WHITE = " \t\n\r\0\x0b"
# Placeholders are private-use characters, which no later pattern matches.
PASSES = (
    ("identifiers", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://[^ ]+", ""),
    ("literals", r"[0-9]+", ""),
    ("names", r"\p{Lu}\p{L}*", ""),
    ("variables", r"\p{Ll}\p{L}*", ""),
)


def lines(text: Column) -> Column:
    """A text's lines by \\n; a trailing line end gives a last empty line, an empty text no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def is_blank(line: Column) -> Column:
    return trimmed(line) == ""


def word_count(text: Column) -> Column:
    """Words between spaces, empty ones not counted."""
    return F.size(F.filter(F.split(text, " ", -1), lambda w: w != ""))


def anonymized(text: Column, settings: AnonymizationSettings, fold_case: bool = False) -> Column:
    """Text-mode analogues of the tree flags: addresses, digit runs, capitalised words, other words."""
    for flag, pattern, mark in PASSES:
        if getattr(settings, flag):
            text = F.regexp_replace(text, pattern, mark)
    return F.lower(text) if fold_case else text


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest prefix that both strings have."""
    return F.aggregate(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when(F.left(a, i) == F.left(b, i), i).otherwise(n))


def expand_tabs(line: Column) -> Column:
    return F.replace(line, F.lit("\t"), F.lit("    "))
