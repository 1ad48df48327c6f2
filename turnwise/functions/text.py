"""Text expressions shared by the metrics: tokens, normal form, keywords, terms, lines, rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Unicode words with inner apostrophes and hyphens, without look-around.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Words that are no keywords.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "how", "i", "in", "is", "it", "its", "me", "my", "of",
    "on", "or", "our", "please", "that", "the", "this", "to", "we", "with", "you", "your",
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def normal_tokens(text: Column) -> Column:
    return F.transform(tokens(text), F.lower)


def keywords(text: Column) -> Column:
    """Distinct lower-case tokens of more than three characters that are no stopwords."""
    return F.array_distinct(F.filter(normal_tokens(text), lambda t: (F.length(t) > 3) & ~t.isin(*[w for w in STOPWORDS if len(w) > 3])))


def _padded(normal: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(normal, " "), F.lit(" "))


def term_hits(normal: Column, terms: list[str]) -> Column:
    """How many of the terms occur; ``normal`` is an array of lower-case tokens.

    Terms are matched as whole token runs: the tokens joined with blanks, padded, must contain the padded term.
    """
    padded = F.array(_padded(normal))
    hits = lambda p: F.size(F.filter(F.array(*[F.lit(f" {t} ") for t in terms]), lambda t: F.contains(p, t)))
    return F.get(F.transform(padded, hits), F.lit(0))


def has_term(normal: Column, terms: list[str]) -> Column:
    return _padded(normal).rlike(" (?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in terms) + ") ")


def filled_lines(text: Column) -> Column:
    """The stripped lines that hold something."""
    stripped = F.transform(F.split(text, LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def half_even(value: Column, digits: int) -> Column:
    """Rounds a double by the exact binary value, ties to even, as a double."""
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")


def ratio(part: Column, whole: Column, digits: int, empty: float | None = None) -> Column:
    out = half_even(part / whole, digits)
    return F.when(whole > 0, out) if empty is None else F.when(whole > 0, out).otherwise(F.lit(empty))
