"""Catalogue of corpora: sizes, language names, scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.operators.aligning import lookup_language_name
from pairsift.operators.select import head_sample
from pairsift.profile import DEFAULT_SCRIPT, SCRIPT_RANGES

FEWER_THAN = 100_000
SAMPLES = 10


def corpus_catalog(df: DataFrame, names: DataFrame, fewer_than: int, source: str = "en") -> DataFrame:
    """One row per corpus ``<src>-<tgt>`` that starts with the source language and is small
    enough, biggest first, with display names."""
    sizes = (
        df.where(F.col("config").startswith(source))
        .groupBy("config")
        .agg(F.count(F.lit(1)).alias("num_examples"))
        .where(F.col("num_examples") < fewer_than)
        .withColumn("src_code", F.split_part("config", F.lit("-"), F.lit(1)))
        .withColumn("tgt_code", F.split_part("config", F.lit("-"), F.lit(2)))
    )
    named = lookup_language_name(sizes, names, "src_code", "source")
    named = lookup_language_name(named, names, "tgt_code", "target")
    return order_catalog(named.select("config", "num_examples", "source", "target"))


def order_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("num_examples"), "config")


def with_script(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("script", tx.detect_script(F.col(column), SCRIPT_RANGES, DEFAULT_SCRIPT))


def majority_script(df: DataFrame, corpus: str = "corpus", column: str = "text") -> DataFrame:
    """The most frequent script of each corpus; ties go to the alphabetically first name."""
    counts = with_script(df, column).groupBy(corpus, "script").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(corpus).agg(F.min_by("script", F.struct(-F.col("n"), F.col("script"))).alias("script"))


def candidate_corpora(
    df: DataFrame, names: DataFrame, order_by: list[str], fewer_than: int = FEWER_THAN, source: str = "en", samples: int = SAMPLES, script: str = DEFAULT_SCRIPT
) -> DataFrame:
    """The catalogue with the majority script of the first ``samples`` texts of each corpus, those in ``script`` only, biggest first.

    Rows: config, text and ``order_by``. A corpus is cut to its samples before its rows are shuffled; the catalogue has one
    row for each corpus.
    """
    heads = head_sample(df.where(F.col("config").startswith(source)), "config", order_by, samples)
    scripts = majority_script(heads, "config")
    return order_catalog(filter_script(corpus_catalog(df, names, fewer_than, source).join(scripts, "config"), script))


def filter_script(catalog: DataFrame, script: str = DEFAULT_SCRIPT) -> DataFrame:
    return catalog.where(F.col("script") == script)
