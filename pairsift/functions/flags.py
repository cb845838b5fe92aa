"""Boolean tests and ratios over one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.profile import EMOJI_RANGES, LangProfile


def no_letters(x: Column) -> Column:
    return ~x.rlike(r"\p{L}")


def len_le_1(x: Column) -> Column:
    """No two characters that are not white space; the search ends at the second one."""
    return ~x.rlike(rf"(?Us)[^{tx.SPACE[1:]}.*?[^{tx.SPACE[1:]}")


def token_le_1(x: Column) -> Column:
    """No white space between two other characters; the search ends at the second token."""
    return ~x.rlike(rf"(?U)[^{tx.SPACE[1:]}{tx.SPACE}++[^{tx.SPACE[1:]}")


def non_letter_ratio(x: Column) -> Column:
    """Share of non-letters among the non-blank characters; 1.0 for blank text."""
    rest = F.regexp_replace(x, r"\p{L}+", "")
    other = F.length(tx.remove_whitespace(rest))
    return F.coalesce(F.try_divide(other, F.length(x) - F.length(rest) + other), F.lit(1.0))


def letter_ratio(x: Column) -> Column:
    """Share of letters in the trimmed text; 0.0 for blank text."""
    body = tx.strip(x)
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    return F.coalesce(F.try_divide(letters, F.length(body)), F.lit(0.0))


def disallowed_char(x: Column, profile: LangProfile) -> Column:
    """A character outside the allowed ranges, or one that does not print.

    Plain ASCII text, the common case, takes one short test.
    """
    ascii_bad = x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    # the run of allowed characters from the start: a search for a character outside tries the union of ranges far more slowly
    outside = ~x.rlike(rf"\A[{tx.java_class(profile.allowed_ranges)}]*+\z")
    unprintable = x.rlike(r"[\p{C}\p{Z}&&[^ \t\n\r]]")
    return F.when(tx.has_non_ascii(x), outside | unprintable).otherwise(ascii_bad)


def contains_emoji(x: Column) -> Column:
    return tx.has_non_ascii(x) & ~x.rlike(rf"\A[^{tx.java_class(EMOJI_RANGES)}]*+\z")


def is_degenerate(x: Column) -> Column:
    """Too short, emoji-like, or mostly not letters."""
    body = tx.strip(x)
    return (F.length(body) < 2) | contains_emoji(body) | (letter_ratio(x) < 0.5)
