"""The ordered cleaning chain with its per-row list of applied steps.

Each step needs the text twice (new text, and whether it changed). Nesting 21 such
expressions would square the plan, so the chain is a stack of projections, each of which
names its result. Change flags that nobody reads are pruned by Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.functions import unicode as uc
from pairsift.profile import ENGLISH_OCCITAN, LangProfile

Rule = Callable[[Column], Column]
Step = tuple[str, list[Rule]]  # several rules run one after another under one name

# these two names are logged for every row that is not null, changed or not
ALWAYS_LOGGED = ("unicode_norm", "line_endings_norm")


NORMALIZE_UNICODE: list[Rule] = [tx.null_to_empty, tx.repair_mojibake, uc.nfc, tx.remove_bom]


def normalize_unicode(x: Column) -> Column:
    return reduce(lambda y, rule: rule(y), NORMALIZE_UNICODE, x)


def cleaning_steps(profile: LangProfile, is_target: bool, split_run_on: bool = False) -> list[Step]:
    """The chain for one side of the pair, in order."""
    steps: list[Step] = [
        ("unicode_norm", NORMALIZE_UNICODE),
        ("line_endings_norm", [tx.normalize_line_endings]),
        ("control_chars_removed", [tx.remove_control_chars]),
        ("html_unescaped", [uc.html_unescape]),
        ("html_tags_removed", [tx.remove_html_tags]),
        ("urls_emails_paths_removed", [tx.remove_urls_emails_paths]),
        ("markup_tokens_removed", [tx.strip_markup_tokens]),
        ("typography_normalized", [lambda x: tx.replace_typography(x, profile)]),
        ("punct_collapsed", [tx.collapse_punct, tx.collapse_repeat_char]),
        ("whitespace_collapsed", [tx.collapse_whitespace]),
        ("very_long_line", []),
    ]
    if split_run_on and is_target:
        steps.append(("run_on_text_fixed", [tx.fix_run_on_text]))
    steps += [
        ("apostrophe_fixed", [tx.apostrophe_fix]),
        ("slash_fixed", [tx.slash_fix]),
        ("universal_punct_fixed", [tx.fix_punct_spacing]),
        ("html_entities_removed", [tx.remove_spaced_entities]),
        ("opus_metadata_removed", [lambda x: tx.remove_corpus_metadata(x, profile)]),
    ]
    if is_target and profile.guillemets:
        steps.append(("occitan_punct_fixed", [tx.fix_guillemets]))
    steps += [
        ("number_separators_normalised", [tx.normalise_number_separators]),
        ("time_units_normalised", [tx.normalise_time_units]),
        ("placeholder_spacing_fixed", [tx.fix_placeholder_spacing]),
    ]
    return steps


def clean_columns(df: DataFrame, plan: dict[str, list[Step]]) -> DataFrame:
    """Clean several text columns in one stack of projections.

    Adds ``<col>_clean`` and ``<col>_steps`` for each column of ``plan``.
    """
    layers = {c: [layer for i, step in enumerate(steps) for layer in _layers(c, i, step)] for c, steps in plan.items()}
    work = df.withColumns({f"_{c}": F.col(c) for c in plan})
    for i in range(max(len(ls) for ls in layers.values())):
        work = work.withColumns({k: v for ls in layers.values() if i < len(ls) for k, v in ls[i].items()})
    out = []
    for c, steps in plan.items():
        names = [F.when(F.col(f"_{c}_did_{i}"), name) for i, (name, _) in enumerate(steps)]
        applied = F.filter(F.array(*names), lambda s: s.isNotNull())
        out += [
            F.col(f"_{c}").alias(f"{c}_clean"),
            F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(applied).alias(f"{c}_steps"),
        ]
    return work.select(*df.columns, *out)


def _layers(c: str, i: int, step: Step) -> list[dict[str, Column]]:
    """The projections of one step: its rules, then the flag that goes into the log."""
    name, rules = step
    text, before, did = F.col(f"_{c}"), f"_{c}_before", f"_{c}_did_{i}"
    layers = [{f"_{c}": rule(text)} for rule in rules]
    if name in ALWAYS_LOGGED:
        return [*layers, {did: F.lit(True)}]
    if not rules:
        return [{did: tx.flag_very_long(text)}]
    layers[0][before] = text
    return [*layers, {did: text != F.col(before)}]


def clean_text(
    df: DataFrame,
    column: str = "text",
    is_target: bool = False,
    profile: LangProfile = ENGLISH_OCCITAN,
    split_run_on: bool = False,
) -> DataFrame:
    return clean_columns(df, {column: cleaning_steps(profile, is_target, split_run_on)})


def with_change_log(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    """The pair table with cleaned sides, their steps and ``any_changes``."""
    both = {"src": cleaning_steps(profile, False), "tgt": cleaning_steps(profile, True)}
    changed = ~(F.col("src").eqNullSafe(F.col("src_clean")) & F.col("tgt").eqNullSafe(F.col("tgt_clean")))
    return clean_columns(df, both).withColumn("any_changes", changed)


def clean_pairs(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> tuple[DataFrame, DataFrame]:
    """(cleaned pairs, change log), two selections over one logged frame."""
    log = with_change_log(df, profile)
    rest = [c for c in df.columns if c not in ("src", "tgt")]
    cleaned = log.select(*rest, F.col("src_clean").alias("src"), F.col("tgt_clean").alias("tgt"))
    return cleaned, log


def change_log_summary(log: DataFrame) -> DataFrame:
    """How many rows each step changed, per side."""
    sides = [
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_steps").alias("steps")) for side in ("src", "tgt")
    ]
    return (
        log.select(F.explode(F.array(*sides)).alias("s"))
        .select("s.side", F.explode("s.steps").alias("step"))
        .groupBy("side", "step")
        .agg(F.count(F.lit(1)).alias("rows_changed"))
    )
