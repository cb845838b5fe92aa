"""Row routing and the filters that keep a usable pair. All narrow: nothing here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.functions import flags as fl
from pairsift.functions import text as tx
from pairsift.operators.fence import where_computed
from pairsift.profile import ENGLISH_OCCITAN, LangProfile

# fixed values: the limits of a usable pair
CHAR_RATIO = (0.1, 10)
CHAR_BOUNDS = (2, 500)  # inclusive
TOKEN_BOUNDS = (1, 100)  # exclusive
TOKEN_RATIO = (0.33, 3)


def with_flags(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, cols=("src", "tgt")) -> DataFrame:
    """Add the five quality flags of each side."""
    added = {}
    for c in cols:
        x = F.col(c)
        added[f"{c}_no_letters"] = fl.no_letters(x)
        added[f"{c}_len_1"] = fl.len_le_1(x)
        added[f"{c}_token_1"] = fl.token_le_1(x)
        added[f"{c}_non_letter_ratio"] = fl.non_letter_ratio(x)
        added[f"{c}_bad_char"] = fl.disallowed_char(x, profile)
    return df.withColumns(added)


def with_route(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, max_non_letter: float = 0.8) -> DataFrame:
    """Add ``is_single`` and ``is_discarded``; a row may be both, the main set is neither."""
    sides = ("src", "tgt")
    drop_tests = [
        [F.col(f"{c}_no_letters"), F.col(f"{c}_len_1"), F.col(f"{c}_non_letter_ratio") > max_non_letter, F.col(f"{c}_bad_char")]
        for c in sides
    ]
    return with_flags(df, profile).withColumns(
        {
            "is_single": F.col("src_token_1") | F.col("tgt_token_1"),
            "is_discarded": reduce(lambda a, b: a | b, [t for tests in drop_tests for t in tests]),
        }
    )


def route_three_way(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN):
    """(discarded, single-token, main). Three filters over one flagged frame; persist the
    input first if more than one of them is written."""
    flagged = with_route(df, profile)
    keep = df.columns
    discarded, single = F.col("is_discarded"), F.col("is_single")
    main = where_computed(flagged, ~discarded & ~single).select(*keep)
    return where_computed(flagged, discarded), where_computed(flagged, single), main


def with_routes(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    """One row per pair and route, in a single pass: discarded, single (may be both) or main."""
    discarded, single = F.col("is_discarded"), F.col("is_single")
    names = [F.when(discarded, "discarded"), F.when(single, "single"), F.when(~discarded & ~single, "main")]
    routes = F.filter(F.array(*names), lambda r: r.isNotNull())
    return with_route(df, profile).select(*df.columns, F.explode(routes).alias("route"))


# -- pair predicates: True means keep -----------------------------------------

def not_anagram(a: Column, b: Column) -> Column:
    """The sort runs only on pairs of equal length, and the length is taken only of pairs with as many of two common letters."""
    la, lb = F.lower(a), F.lower(b)
    na, nb = F.lower(tx.remove_whitespace(a)), F.lower(tx.remove_whitespace(b))
    same = F.when(F.length(na) == F.length(nb), tx.sorted_chars(a) == tx.sorted_chars(b)).otherwise(False)
    for c in "ae":
        same = F.when(tx.count_of(la, c) == tx.count_of(lb, c), same).otherwise(False)
    return ~same


def not_contained(a: Column, b: Column, ignore_case: bool = False) -> Column:
    na, nb = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    if ignore_case:
        na, nb = F.lower(na), F.lower(nb)
    return ~(F.contains(na, nb) | F.contains(nb, na))


def ratio_between(a: Column, b: Column, low: float, high: float) -> Column:
    ratio = F.try_divide(a, b)
    return F.coalesce((ratio >= low) & (ratio <= high), F.lit(False))


def filter_anagram(df: DataFrame) -> DataFrame:
    return df.where(not_anagram(F.col("src"), F.col("tgt")))


def filter_containment(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    return df.where(not_contained(F.col("src"), F.col("tgt"), ignore_case))


def filter_empty(df: DataFrame) -> DataFrame:
    return df.where((F.col("src") != "") & (F.col("tgt") != ""))


def with_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns({"len_src": F.length("src"), "len_tgt": F.length("tgt")})


def with_token_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({"tok_src": tx.token_count(F.col("src")), "tok_tgt": tx.token_count(F.col("tgt"))})


def filter_char_ratio(df: DataFrame) -> DataFrame:
    return with_lengths(df).where(ratio_between(F.col("len_src"), F.col("len_tgt"), *CHAR_RATIO))


def filter_char_bounds(df: DataFrame) -> DataFrame:
    return with_lengths(df).where(F.col("len_src").between(*CHAR_BOUNDS) & F.col("len_tgt").between(*CHAR_BOUNDS))


def inside(x: Column, low: int, high: int) -> Column:
    return (x > low) & (x < high)


def filter_token_bounds(df: DataFrame) -> DataFrame:
    return where_computed(
        with_token_counts(df), inside(F.col("tok_src"), *TOKEN_BOUNDS) & inside(F.col("tok_tgt"), *TOKEN_BOUNDS)
    )


def filter_token_ratio(df: DataFrame) -> DataFrame:
    return where_computed(with_token_counts(df), ratio_between(F.col("tok_src"), F.col("tok_tgt"), *TOKEN_RATIO))


def normalise_for_stage_c(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    cut = df.withColumns({c: tx.cut_at_garbage(F.col(c), profile) for c in ("src", "tgt")})
    return cut.withColumns(
        {"src": tx.collapse_whitespace(F.col("src")), "tgt": tx.expand_contractions(F.col("tgt"), profile)}
    )


def stage_c(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    """Normalise, then the filters from cheap to dear; adds the four length columns.

    The text rules, the lengths and the token counts are each computed once per row.
    """
    len_src, len_tgt = F.col("len_src"), F.col("len_tgt")
    tok_src, tok_tgt = F.col("tok_src"), F.col("tok_tgt")
    sized = where_computed(
        with_lengths(normalise_for_stage_c(df, profile)),
        len_src.between(*CHAR_BOUNDS) & len_tgt.between(*CHAR_BOUNDS) & ratio_between(len_src, len_tgt, *CHAR_RATIO),
    )
    counted = where_computed(
        with_token_counts(sized),
        inside(tok_src, *TOKEN_BOUNDS) & inside(tok_tgt, *TOKEN_BOUNDS) & ratio_between(tok_src, tok_tgt, *TOKEN_RATIO),
    )
    return where_computed(
        counted, not_contained(F.col("src"), F.col("tgt")) & not_anagram(F.col("src"), F.col("tgt"))
    )


def filter_indicator_count(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, fewer_than: int = 2) -> DataFrame:
    counted = df.withColumn("indicators", tx.indicator_count(F.col("tgt"), profile))
    return where_computed(counted, F.col("indicators") < fewer_than)
