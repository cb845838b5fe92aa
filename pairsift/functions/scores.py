"""Score arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
STD_FLOOR = 1e-6
WEIGHTS = {"lang_prob": 0.35, "length": 0.30, "sim_rank": 0.25, "min_embedding": 0.10}


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two equally long float arrays; 0.0 when a norm is zero or a side is missing."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), zero, lambda s, p: s + p)

    def square_sum(u):
        return F.aggregate(u, zero, lambda s, p: s + p * p)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(square_sum(a) * square_sum(b))), zero)


def lang_prob_score(prob: Column, n_tokens: Column) -> Column:
    """Language probability, tempered and pulled to 0.5 on short text."""
    s = sigmoid(logit(clip(prob, EPS, 1 - EPS)) / 0.8)
    trust = 1.0 - F.exp(-n_tokens / 12.0)
    return (1.0 - trust) * 0.5 + trust * s


def length_ratio(len_src: Column, len_tgt: Column, tok_src: Column, tok_tgt: Column) -> Column:
    words = (tok_tgt + 1) / (tok_src + 1)
    chars = (len_tgt + 1) / (len_src + 1)
    return words * 0.6 + chars * 0.4


def length_score(ratio: Column) -> Column:
    return F.exp(-1.5 * F.abs(F.ln(ratio)))


def zscore_sigmoid(x: Column, mean: Column, std: Column) -> Column:
    return sigmoid((x - mean) / std)


def min_embedding_score(sim_a: Column, sim_b: Column, stats: Column) -> Column:
    """``stats`` is a struct with mean_a, std_a, mean_b and std_b (see ``score_stats``)."""
    a = zscore_sigmoid(sim_a, stats["mean_a"], stats["std_a"])
    b = zscore_sigmoid(sim_b, stats["mean_b"], stats["std_b"])
    return F.least(a, b)


def sim_rank(rank_min: Column, rank_max: Column) -> Column:
    return 0.7 * rank_min + 0.3 * rank_max


def ensemble_score(lang_prob: Column, length: Column, sim: Column, min_emb: Column, weights=None) -> Column:
    w = weights or WEIGHTS
    return (
        w["lang_prob"] * lang_prob
        + w["length"] * length
        + w["sim_rank"] * sim
        + w["min_embedding"] * min_emb
    )


def veto_flag(ratio: Column, min_emb: Column) -> Column:
    return ((ratio < 0.40) | (ratio > 2.00)) & (min_emb < 0.75)
