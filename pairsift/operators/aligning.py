"""Joins that replace positional alignment, and catalogue lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.operators.ordering import add_row_index



def zip_parallel(src: DataFrame, tgt: DataFrame, sent_id: str = "sent_id", order_by: list[str] | None = None) -> DataFrame:
    """Two monolingual tables (``text``) into pairs, by sentence id or by row position."""
    if order_by:
        src, tgt = add_row_index(src, order_by, sent_id), add_row_index(tgt, order_by, sent_id)
    left = src.select(sent_id, F.col("text").alias("src"))
    return left.join(tgt.select(sent_id, F.col("text").alias("tgt")), sent_id)


def zip_hyp_ref(src: DataFrame, gold: DataFrame, hyp: DataFrame, key: str = "pair_id") -> DataFrame:
    """Source, gold and generation with the same key side by side."""
    return src.join(gold, key).join(hyp, key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks; must be empty before metrics are computed."""
    return left.select(key).join(right.select(key), key, "left_anti")


def attach_weights(examples: DataFrame, weights: DataFrame, key: str = "idx") -> DataFrame:
    return examples.join(weights, key)


def lookup_language_name(df: DataFrame, names: DataFrame, code: str = "code", out: str = "name") -> DataFrame:
    """Display name of a code; unknown codes stay as they are.

    The name table has one row per language. Catalyst broadcasts it when its size statistics
    allow that, so there is no forced hint here.
    """
    table = names.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    return (
        df.join(table, F.col(code) == F.col("_code"), "left")
        .withColumn(out, F.coalesce("_name", code))
        .drop("_code", "_name")
    )
