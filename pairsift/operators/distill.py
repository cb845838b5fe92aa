"""Sentence weights and losses from per-token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.functions import examples as ex
from pairsift.functions import scores as sc

CONFIDENCE_FLOOR = 0.2
TEMPERATURE = 2.0


def shift_gold(df: DataFrame) -> DataFrame:
    """Logits at a position predict the label one position later (input: idx, pos, logits, label).

    A self-join on (sentence, position) keeps every sentence splittable, however long.
    """
    nxt = df.select("sent_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("gold"))
    return df.drop("label").join(nxt, ["sent_id", "pos"])


def token_log_prob(df: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Add ``log_prob`` of the gold token; null where the position is masked."""
    return df.withColumn("log_prob", ex.log_prob_of_gold(F.col("logits"), F.col("gold"), temperature))


def teacher_confidence(df: DataFrame, sentence: str = "sent_id", floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Sentence weight: sigmoid of the mean gold log-probability, clipped."""
    mean = F.coalesce(F.sum("log_prob"), F.lit(0.0)) / F.greatest(F.count("log_prob"), F.lit(1))
    return df.groupBy(sentence).agg(sc.clip(sc.sigmoid(mean), floor, 1.0).alias("sent_weight"))


def token_cross_entropy(df: DataFrame) -> DataFrame:
    """Unfloored cross entropy of the gold token at temperature 1."""
    lp = ex.log_prob_of_gold(F.col("logits"), F.col("gold"), temperature=1.0, floor=None)
    return df.withColumn("ce", -lp)


def weighted_ce_loss(df: DataFrame, weights: DataFrame, sentence: str = "sent_id") -> DataFrame:
    """Mean over sentences of (mean token cross entropy x sentence weight), one row."""
    mean = F.coalesce(F.sum("ce"), F.lit(0.0)) / F.greatest(F.count("ce"), F.lit(1))
    per_sentence = df.groupBy(sentence).agg(mean.alias("loss"))
    return per_sentence.join(weights, sentence).agg(F.avg(F.col("loss") * F.col("sent_weight")).alias("loss"))


def combine_weights(df: DataFrame, confidence: str = "sent_weight", ensemble: str = "ensemble_weight") -> DataFrame:
    return df.withColumn("combined_weight", sc.clip(F.col(confidence) * F.col(ensemble), 0.05, 1.0))
