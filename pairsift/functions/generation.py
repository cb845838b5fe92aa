"""Rules over raw model output: prompt removal and rejection reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.profile import (
    REASON_EMPTY_OR_LEAK,
    REASON_NUMBER,
    REASON_TIME,
    REASON_WEEKDAY,
    LangProfile,
)


def build_prompt(src: Column, template: str) -> Column:
    head, tail = template.split("{src}")
    return F.concat(F.lit(head), src, F.lit(tail))


def remove_first(x: Column, needle: Column) -> Column:
    """Delete only the first occurrence of ``needle``."""
    at = F.instr(x, needle)
    kept = F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + F.length(needle), F.length(x)))
    return F.when(at > 0, kept).otherwise(x)


def strip_prompt(raw: Column, prompt: Column, first_line: bool = True) -> Column:
    """Drop the prompt, keep the first line if asked, trim, then trim trailing punctuation."""
    x = remove_first(raw, prompt)
    if first_line:
        x = F.split_part(x, F.lit("\n"), F.lit(1))
    return F.rtrim(tx.strip(x), F.lit(" .,;:"))


def reject_empty_or_leak(src: Column, hyp: Column) -> Column:
    leak = (hyp == "") | F.contains(F.lower(hyp), F.lower(src))
    return F.when(leak, REASON_EMPTY_OR_LEAK)


def check_day_names(src: Column, hyp: Column, profile: LangProfile) -> Column:
    lowered = F.lower(hyp)
    misses = [tx.contains_word(src, a) & ~lowered.contains(b.lower()) for a, b in profile.weekdays]
    return F.when(reduce(lambda p, q: p | q, misses), REASON_WEEKDAY)


def check_term_conflict(src: Column, hyp: Column, profile: LangProfile) -> Column:
    out = None
    for src_pattern, hyp_pattern, reason in profile.term_conflicts:
        hit = src.rlike(f"(?iU){src_pattern}") & hyp.rlike(f"(?iU){hyp_pattern}")
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def _differ(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) != F.array_sort(b))


# 10:30, 10h30, 1030 hours
CLOCK = r"(?U)\b(?:\d{1,2}[:hH]\d{2}|(?:1[0-2]|0?[1-9])[0-5]\d\s*hours?)\b"


def time_numbers(x: Column) -> Column:
    """Distinct clock times written as 10:30, 10h30 or 1030 hours, as ``10:30``."""
    found = F.transform(F.regexp_extract_all(x, F.lit(CLOCK), 0), lambda t: F.regexp_replace(t, r"(?U)\D", ""))
    return F.array_distinct(F.transform(found, lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 2), F.lit(":"), F.right(d, F.lit(2)))))


def without_times(x: Column) -> Column:
    """``x`` with a blank for each clock time: the numbers inside these spans are gone."""
    return F.regexp_replace(x, CLOCK, " ")


def check_time_numbers(src: Column, hyp: Column) -> Column:
    return F.when(_differ(time_numbers(src), time_numbers(hyp)), REASON_TIME)


def check_numbers(src: Column, hyp: Column, strip_trailing_dot: bool = False) -> Column:
    a = tx.extract_numbers(src, strip_trailing_dot)
    b = tx.extract_numbers(hyp, strip_trailing_dot)
    return F.when(_differ(a, b), REASON_NUMBER)


def number_set_diff(a: Column, b: Column) -> tuple[Column, Column]:
    """Numbers only in a, and numbers only in b."""
    na, nb = tx.extract_numbers(a), tx.extract_numbers(b)
    return F.array_except(na, nb), F.array_except(nb, na)


def critical_error(src: Column, hyp: Column, profile: LangProfile, check_times: bool = False) -> Column:
    """First reason that applies, or null. With ``check_times``, numbers inside clock times are compared as times only."""
    checks = [check_day_names(src, hyp, profile), check_term_conflict(src, hyp, profile)]
    if check_times:
        checks.append(check_time_numbers(src, hyp))
        src, hyp = without_times(src), without_times(hyp)
    checks.append(check_numbers(src, hyp))
    return F.coalesce(*checks)


def rejection_reason(src: Column, hyp: Column, profile: LangProfile, check_times: bool = False) -> Column:
    return F.coalesce(reject_empty_or_leak(src, hyp), critical_error(src, hyp, profile, check_times))
