"""Global order without a one-partition window.

Ranks, quantiles and contiguous row numbers need to know how many rows come before a
given one. A window with no partition key would send the whole table to one task, so the
key space is cut into ordered buckets first:

1. ``cut_points`` picks the bucket borders from a fixed-size sample. The sample is the
   row with the smallest hash in each of ``16 * buckets`` hash slots, so it depends on the
   data only. A lost task that is run again finds the same borders.
2. Every bucket is numbered by its own window.
3. The bucket sizes (at most ``buckets + 1`` rows) are summed up and added as an offset.

Every row is kept; the sample only places the borders.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairsift.session import bucket_count, materialise

SAMPLES_PER_BUCKET = 16
SKETCH = 10_000
FEW = 10_000


def cut_points(df: DataFrame, key: str, buckets: int) -> Column:
    """Sorted bucket borders of ``key``, at most ``buckets``, as a scalar array.

    The fields of a struct are aggregated one by one: numbers then fit the buffers of a hash aggregate, while a struct would make
    Spark sort all rows by their slot.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(buckets * SAMPLES_PER_BUCKET))
    least = F.xxhash64(F.lit(7), key)
    of = df.schema[key].dataType
    names = [f.name for f in of.fields] if isinstance(of, StructType) else []
    fields = [F.min_by(F.col(key)[name], least).alias(f"_{i}") for i, name in enumerate(names)] or [F.min_by(key, least).alias("_0")]
    k = F.struct(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)]) if names else F.col("_0")
    sample = df.groupBy(slot.alias("slot")).agg(*fields).agg(F.array_sort(F.collect_list(k)).alias("ks"))
    return sample.select(F.filter("ks", lambda _, i: i % SAMPLES_PER_BUCKET == SAMPLES_PER_BUCKET // 2).alias("cuts")).scalar()


def place(df: DataFrame, key: Column, cuts: Column, buckets: int) -> DataFrame:
    """Add ``bucket``, the number of borders not above ``key``.

    A binary search, one projection for each step, so that no border is compared by an interpreted lambda.
    """
    placed = df.withColumns({"_cuts": cuts, "bucket": F.lit(0)})
    for step in reversed([1 << i for i in range(buckets.bit_length())]):
        above = F.get("_cuts", F.col("bucket") + (step - 1)) <= key
        placed = placed.withColumn("bucket", F.col("bucket") + F.when(above, step).otherwise(0))
    return placed.drop("_cuts")


def numbered_rows(df: DataFrame, name: str = "ranked") -> DataFrame:
    """``df`` written once, with ``_row``, a number of each row's own."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()), name)


def pct_ranks(df: DataFrame, outs: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Add percentile ranks, ``outs`` = {value column: rank column}.

    Ties share their average rank, divided by the number of rows that have a value; null and NaN stay null.

    All columns share one pass. The rows are written once with a number of their own (or come from ``numbered_rows``). Every (column,
    value, hash of the number) is dealt once to ordered buckets by Spark's range partitioner and written with its bucket, so later
    reads agree on the borders. Each bucket is ranked by one sort, and the sizes of the buckets before it are added. The hash spreads a
    value that fills a third of a column over many buckets; how often the least and the greatest value of a bucket occur in all buckets is
    counted apart, at most two rows for each bucket. One pivot and one join bring the ranks back.
    """
    buckets = buckets or bucket_count(df.sparkSession)
    rows = df if "_row" in df.columns else numbered_rows(df)
    cells = [F.struct(F.lit(c).alias("which"), F.col(c).cast("double").alias("v")) for c in outs]
    cells = rows.select("_row", F.inline(F.array(*cells))).where(F.col("v").isNotNull() & ~F.isnan("v"))
    dealt = cells.repartitionByRange(buckets, "which", "v", F.xxhash64("_row")).withColumn("bucket", F.spark_partition_id())
    placed = materialise(dealt, "dealt")

    sizes = placed.groupBy("which", "bucket").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = materialise(sizes, "bucket-sizes")  # at most one row for each bucket and one more for each column
    column = Window.partitionBy("which")
    before = column.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "which", "bucket", "size", "lo", "hi", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(column).alias("n")
    )
    ends = placed.select("which", "bucket", "v").join(F.broadcast(offsets), ["which", "bucket"]).where("v = lo OR v = hi")
    ends = ends.groupBy("which", "bucket", "v", "lo", "size", "offset").agg(F.count(F.lit(1)).alias("held"))
    # in the first bucket that holds it, a border value is the least or the greatest
    lower = F.col("offset") + F.when(F.col("v") == F.col("lo"), 0).otherwise(F.col("size") - F.col("held"))
    borders = ends.groupBy("which", "v").agg(F.sum("held").alias("ties"), F.min_by(lower, "bucket").alias("below"))
    facts = F.broadcast(offsets.select("which", "bucket", "offset", "n"))
    spread = F.broadcast(borders.select("which", "v", "ties", "below"))

    inside = Window.partitionBy("which", "bucket").orderBy("v")
    upto = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    ranked = placed.select("_row", "which", "v", "bucket").withColumns({"least": F.rank().over(inside), "most": upto})
    ranked = ranked.join(facts, ["which", "bucket"]).join(spread, ["which", "v"], "left")
    own = F.col("offset") + (F.col("least") + F.col("most")) / 2
    rank = F.coalesce(F.col("below") + (F.col("ties") + 1) / 2, own) / F.col("n")
    back = ranked.select("_row", "which", rank.alias("rank")).groupBy("_row").agg(
        *[F.max(F.when(F.col("which") == c, F.col("rank"))).alias(out) for c, out in outs.items()]
    )
    return rows.join(back, "_row", "left").drop("_row")


def pct_rank_avg(df: DataFrame, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """The percentile rank of one column."""
    return pct_ranks(df, {value: out}, buckets)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], accuracy: int = SKETCH) -> DataFrame:
    """Exact quantiles with linear interpolation, one row, one column per name.

    The column is written once and scanned twice. A mergeable sketch brackets the rank of each quantile; a counting pass then
    counts how many values lie below and between the brackets and keeps the distinct values inside them, about ``8 / accuracy`` of
    all rows for each quantile, whose order gives the exact values. A rank that the sketch misses is looked for again in a
    wider bracket, so the result doesn't depend on the sketch. Nulls and NaN take no part; without values all is null.
    """
    spark = df.sparkSession
    cells = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = materialise(cells, "values")
    margin = 4 / accuracy
    found: dict[int, float] = {}
    wanted: set[int] = set()
    while True:
        edges = sorted({min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-margin, margin)})
        sketch = values.agg(F.count("v").alias("n"), F.percentile_approx("v", edges, accuracy).alias("at")).first()
        if not sketch["n"]:
            break
        spots = {name: (sketch["n"] - 1) * p for name, p in probs.items()}
        wanted = {int(k) for spot in spots.values() for k in (math.floor(spot), math.ceil(spot))}
        at = {edge: x for edge, x in zip(edges, sketch["at"], strict=True)} | {0.0: -math.inf, 1.0: math.inf}
        spans = [(at[max(0.0, p - margin)], at[min(1.0, p + margin)]) for p in probs.values()]
        found = _values_at(values, spans, wanted)
        if wanted <= found.keys():
            break
        margin *= 16
    picks = []
    for name in probs:
        if not found:
            picks.append(F.lit(None).cast("double").alias(name))
            continue
        low, high = found[math.floor(spots[name])], found[math.ceil(spots[name])]
        part = spots[name] - math.floor(spots[name])
        picks.append(F.lit(low + (high - low) * part if part else low).cast("double").alias(name))
    return spark.range(1).select(*picks)


def _values_at(values: DataFrame, spans: list[tuple[float, float]], ranks: set[int]) -> dict[int, float]:
    """The values at those of ``ranks`` (from 0) that lie inside one of ``spans``."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    region = F.lit(2 * len(merged))  # odd regions are spans, even ones lie between them
    for i, (low, high) in reversed(list(enumerate(merged))):
        region = F.when(F.col("v") < low, 2 * i).when(F.col("v") <= high, 2 * i + 1).otherwise(region)
    placed = values.select(region.alias("region"), "v")
    counts = placed.groupBy("region", F.when(F.col("region") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("ties"))
    counts = materialise(counts, "spans")
    sizes = dict(counts.groupBy("region").agg(F.sum("ties")).collect())  # at most two rows for each quantile and one more
    first = {i: sum(n for j, n in sizes.items() if j < i) for i in sizes}
    asked = [(i, k - first[i], k) for i in sizes if i % 2 for k in ranks if first[i] <= k < first[i] + sizes[i]]
    if not asked:
        return {}
    inside = Window.partitionBy("region").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.where(F.col("region").isin(*{i for i, _, _ in asked})).withColumn("upto", F.sum("ties").over(inside))
    local = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).cast("long").alias("local"), F.lit(rank).cast("long").alias("rank")) for i, k, rank in asked])
    here = F.filter(local, lambda a: (a["i"] == F.col("region")) & (a["local"] < F.col("upto")) & (a["local"] >= F.col("upto") - F.col("ties")))
    return {r["rank"]: r["v"] for r in upto.select("v", F.explode(here).alias("a")).select("v", "a.rank").collect()}


def number_rows(
    df: DataFrame,
    order_by: list[str],
    out: str = "idx",
    within: list[str] | None = None,
    start: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """Contiguous numbers in the order of ``order_by``, over the table or within groups.

    A group is cut into buckets too, so a group with a third of all rows is numbered by
    many tasks.
    """
    within = within or []
    buckets = buckets or bucket_count(df.sparkSession)
    key = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    keys = df.select(key.alias("_k"))
    placed = place(df, key, cut_points(keys, "_k", buckets), buckets).withColumnRenamed("bucket", "_bucket")
    groups = [*within, "_bucket"]
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # at most buckets + 1 rows in each group
        placed.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*groups, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    facts = offsets.select("_offset", *[F.col(g).alias(f"_of_{g}") for g in groups])
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])  # a null group is a group
    inside = Window.partitionBy(*groups).orderBy(*order_by)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(facts, same, "left")
        .withColumn(out, F.col("_offset") + F.col("_rn") - 1 + start)
        .drop("_bucket", "_rn", "_offset", *facts.columns)
    )


def keys_at(df: DataFrame, order_by: list[str], positions: list[int], buckets: int | None = None) -> dict[int, tuple[Row, int, int]]:
    """{position: (key there, rows below that key, rows with it)} in the order of ``order_by``; positions from the end on are left out.

    An order-statistic search: the key columns alone are written once and counted in ordered buckets (partial sums, at most one row for each bucket); the
    bucket that holds a position is cut again until it has few rows or few different keys. Nothing is sorted or numbered. Nulls come first.
    """
    buckets = buckets or bucket_count(df.sparkSession)
    keys = materialise(df.select(F.struct(*order_by).alias("k")), "keys")
    whole = _bucket_sizes(keys, buckets)
    found = {}
    for position in positions:
        region, sizes, below = keys, whole, 0
        while True:
            for low, high, size in sizes:
                if position < below + size:
                    break
                below += size
            else:
                break  # no such row
            if low == high:
                found[position] = (low, below, size)
                break
            region = region.where((F.col("k") >= _literal(keys, low)) & (F.col("k") <= _literal(keys, high)))
            sizes = _bucket_sizes(region, buckets, each=size <= FEW)
    return found


def _bucket_sizes(keys: DataFrame, buckets: int, each: bool = False) -> list[tuple[Row, Row, int]]:
    """(least key, greatest key, rows) of ordered buckets of ``k``; with ``each``, of every key."""
    if not each:
        cuts = cut_points(keys, "k", buckets)
        rows = place(keys, F.col("k"), cuts, buckets).groupBy("bucket").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
        sizes = sorted(rows.collect())
        if len(sizes) != 1:
            return [(r["low"], r["high"], r["n"]) for r in sizes]
    # a sample too small to hold a border: only a few different keys are left
    return [(r["k"], r["k"], r["n"]) for r in keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]


def _literal(keys: DataFrame, key: Row) -> Column:
    """``key`` as a literal of the type of ``k``."""
    fields = keys.schema["k"].dataType.fields
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, fields, strict=True)])


def cut_at(df: DataFrame, order_by: list[str], edges: list[int]) -> list[DataFrame]:
    """The rows before edges[0], from there to edges[1], and so on, and those behind the last edge, in the order of ``order_by``.

    Each part is a range of keys: a filter on the table, which reaches the scan when there is one order column. Rows that tie at an
    edge are told apart by the hash of the whole row; only these are numbered.
    """
    edges = [max(e, 0) for e in edges]
    found = keys_at(df, order_by, sorted(set(edges)))
    sides: list[tuple[Column, Column]] = []  # (rows before the edge, rows from it on), for each edge
    for e in edges:
        if e not in found:
            sides.append((F.lit(True), F.lit(False)))
        else:
            sides.append(_sides(df, order_by, found[e][0]))
    parts = []
    for i in range(len(edges) + 1):
        first, last = edges[i - 1] if i else 0, edges[i] if i < len(edges) else None
        if last is not None and last <= first:
            parts.append(df.where("false"))
            continue
        from_first = sides[i - 1][1] if i else F.lit(True)
        to_last = sides[i][0] if last is not None else F.lit(True)
        part = df.where(from_first & to_last)
        # ties: the key at an edge belongs to the part behind it, but for the rows of it that come before the edge
        borders = {tuple(found[e][0]): found[e] for e in (first if i else None, last) if e in found and e != found[e][1]}
        for key, below, ties in borders.values():
            tied = number_rows(df.where(_equal(df, order_by, key)).withColumn("_tie", F.xxhash64(*df.columns)), ["_tie"], "_at", start=below).drop("_tie")
            part = part.where(~_equal(df, order_by, key)).unionByName(tied.where((F.col("_at") >= first) & (F.col("_at") < (last if last is not None else below + ties))).drop("_at"))
        parts.append(part)
    return parts


def _sides(df: DataFrame, order_by: list[str], key: Row) -> tuple[Column, Column]:
    if len(order_by) > 1:
        at = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, key, strict=True)])
        return F.struct(*order_by) < at, F.struct(*order_by) >= at
    (name,), (value,) = order_by, key
    if value is None:
        return F.lit(False), F.lit(True)
    return F.col(name).isNull() | (F.col(name) < F.lit(value)), F.col(name) >= F.lit(value)


def _equal(df: DataFrame, order_by: list[str], key: Row) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.lit(v).cast(df.schema[c].dataType)) for c, v in zip(order_by, key, strict=True)])


def add_row_index(df: DataFrame, order_by: list[str], out: str = "idx") -> DataFrame:
    """Add ``out`` = 0..n-1 unless the column is there already."""
    return df if out in df.columns else number_rows(df, order_by, out)
