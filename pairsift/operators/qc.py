"""Post-processing and acceptance of generated translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.functions import generation as gen
from pairsift.functions import text as tx
from pairsift.operators.fence import where_computed
from pairsift.profile import ENGLISH_OCCITAN, LangProfile


def postprocess_causal(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, first_line: bool = True) -> DataFrame:
    prompt = gen.build_prompt(F.col("src"), profile.causal_prompt)
    return df.withColumn("hyp", gen.strip_prompt(F.col("raw"), prompt, first_line))


def postprocess_seq2seq(df: DataFrame) -> DataFrame:
    return df.withColumn("hyp", tx.strip(F.col("raw")))


def with_reason(df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, check_times: bool = False) -> DataFrame:
    """Add ``reason``; null means accepted."""
    return df.withColumn("reason", gen.rejection_reason(F.col("src"), F.col("hyp"), profile, check_times))


def qc_generations(
    df: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, check_times: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) from raw generations; rejected rows keep their reason."""
    judged = with_reason(postprocess_causal(df, profile, first_line=False), profile, check_times)
    reason = F.col("reason")
    return where_computed(judged, reason.isNull()).drop("reason"), where_computed(judged, reason.isNotNull())


def rejection_summary(judged: DataFrame) -> DataFrame:
    reason = F.coalesce("reason", F.lit("accepted")).alias("reason")
    return judged.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
