"""Checks and shapes of vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """True for vectors that are not null or empty and hold finite components only (and one that isn't zero)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    if nonzero:
        good &= F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def of_one_length(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has the commonest length (of equally common ones, the greatest): others can't be compared with them."""
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows if common is None else rows.where(F.size(vector) == common["size"])
