"""Keep one row per target text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_first(
    df: DataFrame, by: str = "tgt", order_by: str = "pair_id", prefer_repeated: bool = False, pair=("src", "tgt")
) -> DataFrame:
    """The row with the smallest ``order_by`` for each value of ``by``.

    An aggregate instead of a window: each map task first reduces its own copies, so a text
    that fills a third of the table reaches the reducer as one row per map task.

    ``prefer_repeated`` keeps the first row that repeats an earlier (src, tgt) pair exactly,
    where there is one.
    """
    whole = F.struct(*df.columns)
    if not prefer_repeated:
        return df.groupBy(by).agg(F.min_by(whole, F.struct(F.col(order_by).isNull(), order_by)).alias("_r")).select("_r.*")
    first_of_pair = df.groupBy(*pair).agg(F.min(order_by).alias(order_by)).select(order_by)
    repeats = df.join(first_of_pair, order_by, "left_anti").select(*df.columns)
    tagged = df.withColumn("_prio", F.lit(1)).unionByName(repeats.withColumn("_prio", F.lit(0)))
    return (
        tagged.groupBy(by)
        .agg(F.min_by(whole, F.struct("_prio", F.col(order_by).isNull(), order_by)).alias("_r"))
        .select("_r.*")
    )


def drop_by_index(df: DataFrame, doomed: DataFrame, key: str = "pair_id") -> DataFrame:
    """Remove the rows whose key is listed in ``doomed``."""
    return df.join(doomed.select(key), key, "left_anti")
