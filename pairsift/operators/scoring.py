"""The ensemble score of a pair and the components it is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.functions import scores as sc
from pairsift.operators.ordering import numbered_rows, pct_ranks
from pairsift.operators.stats import as_struct, score_stats


def agree_max(df: DataFrame, a: str = "sim_a", b: str = "sim_b") -> DataFrame:
    return df.withColumns({"agree_raw": F.least(a, b), "max_raw": F.greatest(a, b)})


def combined_rank(df: DataFrame, a: str = "sim_a", b: str = "sim_b") -> DataFrame:
    """Percentile rank of both columns and their mean."""
    ranked = pct_ranks(df, {a: f"{a}_rank", b: f"{b}_rank"})
    return ranked.withColumn("combined_rank", (F.col(f"{a}_rank") + F.col(f"{b}_rank")) / 2)


def sim_rank(df: DataFrame) -> DataFrame:
    """0.7 rank of the lower similarity + 0.3 rank of the higher one."""
    ranked = pct_ranks(agree_max(df), {"agree_raw": "_rank_min", "max_raw": "_rank_max"})
    return ranked.withColumn("sim_rank", sc.sim_rank(F.col("_rank_min"), F.col("_rank_max"))).drop(
        "_rank_min", "_rank_max"
    )


def min_embedding_score(df: DataFrame) -> DataFrame:
    with_stats = df.withColumn("_s", as_struct(score_stats(df)))
    return with_stats.withColumn(
        "min_embedding_score", sc.min_embedding_score(F.col("sim_a"), F.col("sim_b"), F.col("_s"))
    ).drop("_s")


def length_scores(df: DataFrame) -> DataFrame:
    ratio = sc.length_ratio(F.col("len_src"), F.col("len_tgt"), F.col("tok_src"), F.col("tok_tgt"))
    return df.withColumn("length_ratio", ratio).withColumn("length_score", sc.length_score(F.col("length_ratio")))


def score_pairs(df: DataFrame, key: str = "pair_id", with_veto: bool = True, weights=None) -> DataFrame:
    """Input: sim_a, sim_b, tgt_score, len_src, len_tgt, tok_src, tok_tgt and a unique key.

    The statistics and ranks are those of this table. They are computed on the key and the
    similarities only, written once, so that the cleaning before this step does not run
    again for every rank; the texts take part in one join.
    """
    narrow = agree_max(numbered_rows(df.select(key, "sim_a", "sim_b"), "similarities"))
    ranks = pct_ranks(
        narrow,
        {"sim_a": "sim_a_rank", "sim_b": "sim_b_rank", "agree_raw": "_rank_min", "max_raw": "_rank_max"},
    ).select(
        key,
        "agree_raw",
        "max_raw",
        "sim_a_rank",
        "sim_b_rank",
        ((F.col("sim_a_rank") + F.col("sim_b_rank")) / 2).alias("combined_rank"),
        sc.sim_rank(F.col("_rank_min"), F.col("_rank_max")).alias("sim_rank"),
    )
    out = (
        df.join(ranks, key)
        .transform(length_scores)
        .withColumn("lang_prob_score", sc.lang_prob_score(F.col("tgt_score"), F.col("tok_tgt")))
        .withColumn("_s", as_struct(score_stats(narrow)))
        .withColumn("min_embedding_score", sc.min_embedding_score(F.col("sim_a"), F.col("sim_b"), F.col("_s")))
        .drop("_s")
        .withColumn(
            "score",
            sc.ensemble_score(
                F.col("lang_prob_score"), F.col("length_score"), F.col("sim_rank"), F.col("min_embedding_score"), weights
            ),
        )
    )
    if with_veto:
        out = out.withColumn("veto", sc.veto_flag(F.col("length_ratio"), F.col("min_embedding_score")))
    return out
