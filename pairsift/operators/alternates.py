"""Optional scorers that are switched off by default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.functions import scores as sc
from pairsift.functions import text as tx
from pairsift.operators.ordering import numbered_rows, pct_ranks, quantiles
from pairsift.operators.stats import as_struct
from pairsift.profile import COUNTER_HINTS, ENGLISH_OCCITAN, TARGET_HINTS, LangProfile
from pairsift.session import materialise


def alt_length_score(tok_src: Column, tok_tgt: Column, k: float = 1.5) -> Column:
    return sc.clip(F.exp(-k * F.abs(F.ln((tok_tgt + 1) / (tok_src + 1)))), 0.0, 1.0)


def alt_digit_match(src: Column, tgt: Column) -> Column:
    def runs(x):
        return F.array_sort(F.regexp_extract_all(x, F.lit(r"(?U)(\d+)"), 1))

    return runs(src) == runs(tgt)


def alt_robust_scale(df: DataFrame, value: str, out: str) -> DataFrame:
    """Sigmoid of the IQR-scaled distance from the median."""
    q = as_struct(quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    iqr = F.col("_q.q75") - F.col("_q.q25")
    z = (F.col(value) - F.col("_q.q50")) / (F.when(iqr > 1e-8, iqr).otherwise(1.0) / 1.349)
    return df.withColumn("_q", q).withColumn(out, sc.sigmoid(z / 1.5)).drop("_q")


def alt_target_hint(text: Column) -> Column:
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    plus = reduce(lambda a, b: a + b, [t.contains(h).cast("int") for h in TARGET_HINTS])
    minus = reduce(lambda a, b: a + b, [t.contains(h).cast("int") for h in COUNTER_HINTS])
    return (plus - minus) / F.greatest(F.length(t), F.lit(1))


def alt_langid_calibration(prob: Column, n_tokens: Column) -> Column:
    return sc.lang_prob_score(prob, n_tokens)


def alt_curation_score(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """0.45 rank of scaled similarities + 0.25 length + 0.15 language + 0.15 hint rank; veto."""
    out = alt_robust_scale(alt_robust_scale(df, "sim_a", "a_norm"), "sim_b", "b_norm")
    out = out.withColumns(
        {
            "agree_sim": F.least("a_norm", "b_norm"),
            "max_sim": F.greatest("a_norm", "b_norm"),
            "alt_length": alt_length_score(F.col("tok_src"), F.col("tok_tgt")),
            "hint": alt_target_hint(F.col("tgt")),
            "lang_cal": alt_langid_calibration(F.col("tgt_score"), F.col("tok_tgt")),
        }
    )
    narrow = numbered_rows(out.select(key, "agree_sim", "max_sim", "hint"), "hints")
    ranks = pct_ranks(narrow, {c: f"{c}_rank" for c in ("agree_sim", "max_sim", "hint")})
    ranks = ranks.select(key, "agree_sim_rank", "max_sim_rank", "hint_rank")
    lr = (F.col("tok_tgt") + 1) / (F.col("tok_src") + 1)
    score = (
        0.45 * sc.sim_rank(F.col("agree_sim_rank"), F.col("max_sim_rank"))
        + 0.25 * F.col("alt_length")
        + 0.15 * F.col("lang_cal")
        + 0.15 * F.col("hint_rank")
    )
    return out.join(ranks, key).withColumns(
        {"curation_score": score, "hard_veto": ((lr < 0.45) | (lr > 2.2)) & (F.col("agree_sim") < 0.75)}
    )


def alt_length_agreement(len_src: Column, len_tgt: Column, tok_src: Column, tok_tgt: Column) -> Column:
    def ratio(a, b):
        return F.least(a, b) / F.greatest(a, b)

    words = (ratio(tok_src, tok_tgt) - 0.4) / (1.0 - 0.4)
    chars = (ratio(len_src, len_tgt) - 0.1) / (1.0 - 0.1)
    return sc.clip(words * 0.6 + chars * 0.4, 0.0, 1.0)


def alt_logit_temperature(p: Column, tau: float = 0.8) -> Column:
    return sc.sigmoid(sc.logit(p) / tau)


def alt_zscore_sigmoid(x: Column, mean: Column, std: Column) -> Column:
    return sc.zscore_sigmoid(x, mean, std)


def alt_similarity_quantile_filter(df: DataFrame, sim: str = "sim_a", p: float = 0.10) -> DataFrame:
    cut = as_struct(quantiles(df, sim, {"q": p}))
    return df.withColumn("_q", cut).where(F.col(sim) >= F.col("_q.q")).drop("_q")


def alt_language_distribution(df: DataFrame, label: str = "label", leave_out=()) -> DataFrame:
    kept = df.where(~F.col(label).isin(list(leave_out))) if leave_out else df
    return kept.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _alternatives(words) -> str:
    return "|".join(w for w, _ in words)


def _dictionary(words) -> Column:
    return F.create_map(*[F.lit(v) for pair in words for v in pair])


def alt_number_words_src(text: Column, profile: LangProfile = ENGLISH_OCCITAN) -> Column:
    """Sums of number-word sequences (two or more words), then every single number word."""
    words = profile.source_number_words
    alt, table = _alternatives(words), _dictionary(words)
    runs = F.regexp_extract_all(text, F.lit(rf"(?iU)(\b(?:{alt})(?:[\s-]+(?:{alt}))+\b)"), 1)

    def total(run: Column) -> Column:
        parts = F.when(run.contains("-"), F.split(run, "-")).otherwise(tx.tokens(run))
        return F.aggregate(parts, F.lit(0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0)))

    sums = F.filter(F.transform(runs, total), lambda v: v > 0)
    singles = F.filter(
        F.array(*[F.when(tx.contains_word(text, w), v) for w, v in words]), lambda v: v.isNotNull()
    )
    return F.concat(sums, singles)


def alt_number_words_tgt(text: Column, profile: LangProfile = ENGLISH_OCCITAN) -> Column:
    """Sums of target-language number sequences (hundreds multiply), then the plain digits.

    Java's matcher calls itself for each turn of a loop that it may have to take back, so a sequence of some hundred words would
    overflow its stack. What joins two words can be read in one way only: the loops here are possessive and take nothing back. A
    sequence is a chain of glued words that end at a word border, so it is the longest one that ends there.
    """
    words = profile.target_number_words
    alt, table = _alternatives(words), _dictionary(words)
    glue = r"\s*+-?e?\s*+-?"
    glued = rf"(?:{alt})(?:\B{glue}(?:{alt}))*+\b"
    seq = rf"(?U)(\b{glued}(?:{glue}{glued})*+)"
    runs = F.regexp_extract_all(F.lower(text), F.lit(seq), 1)
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("last"))

    def step(acc: Column, word: Column) -> Column:
        v = F.try_element_at(table, word).cast("bigint")
        big = F.when(acc["last"] > 0, acc["last"] * v).otherwise(v)
        return (
            F.when(v.isNull(), acc)
            .when(v >= 100, F.struct((acc["sum"] + big).alias("sum"), F.lit(0).cast("bigint").alias("last")))
            .otherwise(F.struct((acc["sum"] + v).alias("sum"), v.alias("last")))
        )

    def total(run: Column) -> Column:
        return F.aggregate(F.split(run, r"(?U)[\s-]e?[\s-]?"), start, step, lambda acc: acc["sum"])

    sums = F.filter(F.transform(runs, total), lambda v: v > 0)
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b(\d+)\b"), 1), lambda d: d.try_cast("bigint"))
    return F.concat(sums, F.filter(digits, lambda d: d.isNotNull()))
