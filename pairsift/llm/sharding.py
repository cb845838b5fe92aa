"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by the hash of their text, then the hash of their id. A size-weighted sample of keys gives quantile
boundaries; rows are dealt into these ranges, and a range that is overfull is subdivided by the key. Only range totals are
summed up in order, so every row learns its exact place in the global order of bytes and rows while
no task sorts more than a small range. The shard is the place in bytes, cut into equal shares.

Rows with equal texts are neighbours and go to one shard together, unless they weigh more than 1 / ``GROUP`` of a shard:
such groups (at most ``GROUP`` per shard) are divided row by row. The result doesn't depend on the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsift.session import checkpoint

GROUP = 50
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 32
ROW_BYTES = 8


def hash60(value: Column) -> Column:
    """60 bits of the MD5 hash of a string as a long."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def splitters(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of (k1, k2) from a sample in which a row's chance follows its size.

    Sampling is a race: the rows with the least ``-ln(u) / size`` win, u from the key's hash; so a retry draws the
    same. A boundary inside a group that stays together moves to the start of the group.
    """
    u = (F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    sample = rows.select("k1", F.when(F.col("big"), F.col("k2")).otherwise(-1).alias("k2"), (-F.log(u) / F.col("size")).alias("race"))
    keys = sorted((r["k1"], r["k2"]) for r in sample.orderBy("race", "k1", "k2").limit(ranges * SAMPLES_PER_RANGE).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many boundaries are not above (k1, k2)."""
    if not cuts:
        return F.lit(0)
    made = F.array(*[F.struct(F.lit(a).cast("long").alias("k1"), F.lit(b).cast("long").alias("k2")) for a, b in cuts])
    return F.size(F.filter(made, lambda c: c <= F.struct("k1", "k2")))


def byte_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 8. slot counts from 0 in each shard, without gaps. A shard's bytes
    differ from the mean by at most 1 / ``GROUP`` of it and the largest row. Null ids and repeated rows are rows as all
    others. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        hash60(text).alias("k1"),
        hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k2"),
    )
    rows = checkpoint(rows)  # all but the texts
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    heavy = rows.groupBy("k1").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * GROUP > share).select("k1", F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(heavy), "k1", "left").withColumn("big", F.coalesce("heavy", F.lit(False))).drop("heavy")  # at most GROUP * shards groups

    ranges = shards * RANGES_PER_SHARD
    ranged = rows.withColumn("range", _range_of(splitters(rows, ranges)))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)])
    pieces = F.ceil(F.col("bytes") * ranges / F.lit(max(1, total))).cast("int")
    sizes = sizes.withColumn("pieces", F.when(pieces > 2, pieces).otherwise(1))  # one row per range
    one = F.col("min_k1") == F.col("max_k1")
    along = [(F.col(k) - F.col(f"min_{k}")) / (F.col(f"max_{k}") - F.col(f"min_{k}") + 1.0) * F.col("pieces") for k in ("k1", "k2")]
    part = F.when(one & F.col("big"), F.floor(along[1])).otherwise(F.floor(along[0])).cast("int")
    cut = ranged.join(F.broadcast(sizes.drop("bytes")), "range").withColumn("part", part).select(*ranged.columns, "part")

    bins = cut.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # over bin totals only
    offsets = bins.select("range", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("bytes", "byte0"), ("n", "row0"))])
    inside = Window.partitionBy("range", "part").orderBy("k1", "k2", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "part", "k1")
    placed = cut.join(offsets, ["range", "part"]).withColumn("upto", F.sum("size").over(inside)).withColumn("row", F.row_number().over(inside) - 1 + F.col("row0"))
    start = F.when(F.col("big"), F.col("upto") - F.col("size")).otherwise(F.min(F.col("upto") - F.col("size")).over(group))
    weight = F.when(F.col("big"), F.col("size")).otherwise(F.sum("size").over(group))
    middle = (F.col("byte0") + start) * 2 + weight  # twice the middle, as a whole number
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(1, total)))).cast("int")
    placed = checkpoint(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("row0"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("row0")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
