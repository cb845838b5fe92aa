"""Filtering on columns that are expensive to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, evaluated after the columns it reads have been computed.

    Predicate push-down rewrites a filter in terms of the scanned columns. Over a stack of
    text rules that would repeat every rule for each mention of its result, and the
    expression would grow with the power of the stack. A projection with a
    non-deterministic column is not pushed through, so the results are computed once per
    row and then tested. Cheap tests on scanned columns should stay plain ``where``.
    """
    fenced = df.withColumn("_fence", F.spark_partition_id())
    return fenced.where((F.col("_fence") >= 0) & condition).drop("_fence")
