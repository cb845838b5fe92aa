"""Summaries of a scored corpus. Statistics stay in the plan as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.functions.scores import STD_FLOOR
from pairsift.operators.ordering import quantiles

TIER_PROBS = {"q75": 0.75, "q50": 0.50, "q10": 0.10}


def score_stats(df: DataFrame, sim_a: str = "sim_a", sim_b: str = "sim_b") -> DataFrame:
    """Mean and sample deviation (floored) of both similarities, one row."""

    def std(c: str) -> Column:
        return F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(STD_FLOOR))

    return df.agg(
        F.avg(sim_a).alias("mean_a"),
        std(sim_a).alias("std_a"),
        F.avg(sim_b).alias("mean_b"),
        std(sim_b).alias("std_b"),
    )


def as_struct(row: DataFrame) -> Column:
    """A one-row frame as a scalar struct column."""
    return row.select(F.struct(*row.columns).alias("s")).scalar()


def score_quantiles(df: DataFrame, score: str = "score", probs: dict[str, float] | None = None) -> DataFrame:
    return quantiles(df, score, probs or TIER_PROBS)


def quality_tier(df: DataFrame, score: str = "score") -> DataFrame:
    """Add ``tier`` from the quartile cut-offs of this very table."""
    x, q = F.col(score), F.col("_q")
    tier = (
        F.when(x > q["q75"], "high").when(x > q["q50"], "medium").when(x >= q["q10"], "low").otherwise("very low")
    )
    return df.withColumn("_q", as_struct(score_quantiles(df, score))).withColumn("tier", tier).drop("_q")


def tier_counts(df: DataFrame, score: str = "score") -> DataFrame:
    return quality_tier(df, score).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def histogram50(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; empty bins are left out."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    e = F.col("_e")
    place = F.floor((F.col(value) - e["lo"]) / (e["hi"] - e["lo"]) * bins)
    return (
        df.where(F.col(value).isNotNull())
        .withColumn("_e", as_struct(edges))
        .select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_scores(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max as one row of doubles."""
    base = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = as_struct(quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    return base.withColumn("_q", q).select(
        "count", "mean", "std", "min", F.col("_q.q25").alias("q25"), F.col("_q.q50").alias("q50"),
        F.col("_q.q75").alias("q75"), "max",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def count_containing(df: DataFrame, column: str, literal: str) -> DataFrame:
    return df.where(F.col(column).contains(literal)).agg(F.count(F.lit(1)).alias("n"))
