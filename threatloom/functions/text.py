"""String features of file contents, on the bytes read as latin-1."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.fixed_values import MIN_TOKEN_LENGTH

# Whitespace and digits of latin-1 as Python's str.split and str.isdigit see them.
WHITESPACE = r"[ \t-\r\x1c-\x1f\x85\xa0]+"
DIGITS = r"[0-9\xb2\xb3\xb9]+"
# Latin-1 characters that Python's str.isprintable rejects.
UNPRINTABLE = r"[^\x20-\x7e\xa1-\xac\xae-\xff]"

# A word of two to four or more dot-separated parts of which the first four are digits.
_END = rf"(?={WHITESPACE[:-1]}|\z)"
DOTTED_NUMBER = (
    rf"(?:(?<={WHITESPACE[:-1]})|\A)"
    rf"(?:{DIGITS}(?:\.{DIGITS}){{1,2}}{_END}|{DIGITS}(?:\.{DIGITS}){{3}}(?:\.[^{WHITESPACE[1:-2]}]*)?{_END})"
)


def latin1_text(content: Column, prefix_bytes: int | None = None) -> Column:
    """Contents as text, one character per byte; ``prefix_bytes`` limits the read as a scanner does."""
    if prefix_bytes is not None:
        content = F.substring(content, 1, prefix_bytes)
    return F.decode(content, "ISO-8859-1")


def count_token(text: Column, token: str) -> Column:
    """Non-overlapping, case-sensitive occurrences."""
    if not token:
        raise ValueError("a token needs at least one character")
    removed = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (removed / F.lit(len(token))).cast("bigint")


def token_counts(text: Column, tokens: Iterable[str], min_length: int = MIN_TOKEN_LENGTH) -> Column:
    """Map token to count, over tokens long enough to mean something."""
    pairs = []
    for token in tokens:
        if len(token) >= min_length:
            pairs += [F.lit(token), count_token(text, token)]
    if not pairs:
        return F.expr("cast(map() as map<string,bigint>)")
    return F.create_map(*pairs)


def url_count(text: Column) -> Column:
    return count_token(text, "http://") + count_token(text, "https://")


def ip_count(text: Column) -> Column:
    """Words whose first four dot-separated parts (two at least) are all digits."""
    return F.regexp_count(text, F.lit(DOTTED_NUMBER)).cast("bigint")


def printable_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(UNPRINTABLE))).cast("bigint")
