"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document's repetition count is a Poisson number with mean = target share of its source / available share, drawn by
inverting the distribution at a uniform number that the MD5 hash of (seed, doc_id) gives. A rerun, a retry or another
partitioning draws the same counts. Copies are exploded and sorted by another hash: a global shuffle.

Means over ``STEP`` are drawn as sums of equal Poisson numbers, which keeps ``exp(-mean)`` away from zero and the
table of a source at ``DEPTH`` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import free_name

STEP = 32.0
DEPTH = 160  # P(Poisson(32) > 160) is under 1e-50


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the hash of ``parts``; 52 bits."""
    digest = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. DEPTH of a Poisson number with this mean."""
    start = F.struct(F.exp(-mean).alias("term"), F.array().cast("array<double>").alias("upto"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, acc["term"]).otherwise(acc["term"] * mean / k)
        total = acc["sum"] + term
        return F.struct(term.alias("term"), F.concat(acc["upto"], F.array(total)).alias("upto"), total.alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), start, step, lambda acc: acc["upto"])


def source_rates(docs: DataFrame, weights: dict[str, float], by: str = "source", text: str = "text") -> DataFrame:
    """(bucket, mean, parts, upto): one row per named source and one (null) for all others; at most ``len(weights) + 1``.

    Shares are in UTF-8 bytes. What ``weights`` leave of 1 is the share of all other sources together, the null
    source included. A bucket without bytes keeps its documents once on average.
    """
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be at least 0 and sum to at most 1")
    share = F.lit(max(0.0, 1 - sum(weights.values())))
    for name, w in sorted(weights.items(), reverse=True):
        share = F.when(F.col("bucket") == name, w).otherwise(share)
    sizes = docs.groupBy(bucket_of(weights, by).alias("bucket")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).scalar()
    mean = F.when(F.col("bytes") > 0, share * F.col("total") / F.col("bytes")).otherwise(1.0)
    rates = sizes.withColumn("total", total).withColumn("mean", mean)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / STEP)).cast("int")
    return rates.withColumn("parts", parts).select("bucket", "mean", "parts", poisson_table(F.col("mean") / F.col("parts")).alias("upto"))


def bucket_of(weights: dict[str, float], by: str) -> Column:
    return F.when(F.col(by).isin(*weights), F.col(by))


def with_repetitions(docs: DataFrame, weights: dict[str, float], seed: int, by: str = "source", key: str = "doc_id", out: str = "_n") -> DataFrame:
    """``docs`` with ``out`` (not a name of its columns), how often each row is taken; rows with equal (also null) keys are taken equally often."""
    own, bucket, parts, upto = (free_name(c, docs) for c in ("_own", "_bucket", "_parts", "_upto"))
    rates = F.broadcast(source_rates(docs, weights, by).select(F.col("bucket").alias(bucket), F.col("parts").alias(parts), F.col("upto").alias(upto)))
    drawn = docs.withColumn(own, bucket_of(weights, by))
    joined = drawn.join(rates, F.col(own).eqNullSafe(F.col(bucket)))

    # an array of its own: inside the filter, the hash would be made anew for each entry of the table
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda part: uniform(f"{seed}", F.col(key), part))
    count = F.aggregate(draws, F.lit(0).cast("long"), lambda acc, u: acc + F.size(F.filter(upto, lambda p: p <= u)).cast("long"))
    return joined.withColumn(out, count).select(*docs.columns, out)


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = 1, by: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixture: every row of ``docs`` as often as drawn, with ``copy`` (1, 2, ...) and ``mix_key``, in its order.

    Needs columns ``key``, ``by`` and text; all columns pass unchanged (columns named ``copy`` or ``mix_key`` are replaced).
    An empty table gives an empty mixture. Weights of sources that don't occur are lost, not given to others.
    """
    n = free_name("_n", docs)
    taken = with_repetitions(docs, weights, seed, by, key, n).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long")))))
    taken = taken.where(F.col(n) > 0).drop(n)
    mix_key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col(key).cast("string"), F.lit("")), "copy"))
    return taken.withColumn("mix_key", mix_key).orderBy("mix_key", "copy")
