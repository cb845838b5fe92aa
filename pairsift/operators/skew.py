"""Joining a long table to per-key facts when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SLOTS = 256


def spread_lookup(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    weight: str,
    total: str,
    spread_by: str,
    slots: int = HOT_SLOTS,
) -> DataFrame:
    """Left join ``rows`` to ``facts`` (a few rows per key) without a hot reducer.

    ``facts[weight]`` is the number of rows with that key and ``facts[total]`` the number of
    all rows. A key is hot when it holds more than ``total / slots`` rows; there can be no
    more than ``slots`` such keys, whatever the data, so broadcasting them is safe. Rows
    with a cold key are shuffled, at most ``total / slots`` per key. Rows already answered
    (and rows with a null key) are spread by the hash of ``spread_by`` instead of meeting
    in one reducer.
    """
    values = [c for c in facts.columns if c not in (key, weight, total)]
    is_hot = F.col(weight) * slots > F.col(total)
    hot = facts.where(is_hot).select(
        F.col(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    # always 0, but not a literal: Catalyst would fold a literal into a filter and shuffle the
    # answered rows by their hot key again
    never = F.col(weight) < 0
    cold = facts.where(~is_hot).select(
        F.col(key).alias("_key"), never.cast("int").alias("_salt"), *[F.col(c).alias(f"_cold_{c}") for c in values]
    )
    free = F.col("_hot").isNotNull() | F.col(key).isNull()
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(free, F.pmod(F.xxhash64(spread_by), F.lit(slots)).cast("int") + 1).otherwise(0)
    )
    joined = tagged.join(
        cold, (tagged[key] == cold["_key"]) & (tagged["_salt"] == cold["_salt"]), "left"
    )
    return joined.select(
        *[tagged[c] for c in rows.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in values],
    )
