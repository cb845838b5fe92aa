"""Selections: heads, top-k, slices, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsift.operators.ordering import cut_at

TRAIN_ROWS = 3000
EARLY_STOP_ROWS = 250
PREVIEW_ROWS = 10
SLICE_FROM, SLICE_TO = 503, 1003


def select_train_head(df: DataFrame, order_by: str = "pair_id", n: int = TRAIN_ROWS) -> DataFrame:
    """The first n pairs in corpus order (per-partition top-n, then a merge)."""
    return df.orderBy(order_by).limit(n)


def select_topk_by_score(df: DataFrame, score: str = "score", key: str = "pair_id", n: int = EARLY_STOP_ROWS) -> DataFrame:
    """The n best pairs; equal scores are taken in key order."""
    return df.orderBy(F.desc(score), key).limit(n)


def preview(df: DataFrame, order_by: str, n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def slice_rows(df: DataFrame, order_by: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """Rows first..last-1 of the given order, at any depth and on any size of table."""
    if last is None:
        return cut_at(df, order_by, [first])[1] if first > 0 else df
    return cut_at(df, order_by, [first, last])[1]


def first_n_per_group(df: DataFrame, group: str, order_by: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First n rows of each group. Spark limits every group inside the map tasks before the
    shuffle (window group limit), so a hot group costs n rows per map task."""
    w = Window.partitionBy(group).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


head_sample = first_n_per_group


def union_splits(**splits: DataFrame) -> DataFrame:
    """Union with a ``split`` column, so that (split, pair_id) is the key."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def build_distill_eval_sets(dev: DataFrame, devtest: DataFrame, order_by: str) -> tuple[DataFrame, DataFrame]:
    """(dev + first part of devtest, next part of devtest); the two never share a row."""
    head, middle, _ = cut_at(devtest, [order_by], [SLICE_FROM, SLICE_TO])
    return union_splits(dev=dev, devtest=head), middle
