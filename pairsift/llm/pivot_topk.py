"""Exact top-k by integer inner product with a pivot-distance index.

Components become ``floor(256 * x)``. An extra coordinate ``sqrt(M - |x|^2)``, M the largest squared norm, gives all
candidates one norm, so the largest inner product with a query is the smallest Euclidean distance to (query, 0), and
the triangle inequality holds.

Index: each vector belongs to its nearest pivot and is keyed by the distance to it; the keys of a pivot are cut into
annuli of about ``RING`` vectors, and annuli with more (equal vectors) are split by hash. A query first searches the
cell nearest to it, which gives it a k-th score. Then it visits the cells that the triangle inequality can't rule out:
``max(0, d(q, p) - outer, inner - d(q, p))`` must not exceed the k-th distance. In a cell, vectors are ordered by
their key and expanded outwards from d(q, p) until the bound ends the search. Scores are exact integers.

Pivots are chosen from a bounded sample; every vector is indexed. The table of cells grows with the data by one row per
``RING`` vectors; it is joined, not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsift.llm.vectors import of_one_length, usable
from pairsift.session import checkpoint

PIVOTS = 32
PIVOT_SAMPLE = 4_096
RING = 2_048
SLACK = 1e-6  # relative; covers the rounding of distances
EXACT = 2.0**53  # below it, float64 holds squares, products and their sums exactly
WIDEST = 2.0**62


def slack(top: float) -> float:
    """Absolute rounding of distances: beyond ``EXACT``, differences of squares are off by about 1e-16 of them."""
    return SLACK if top < EXACT else SLACK * (1 + top**0.5)


def squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): components as integers; rows that take no part are gone."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    return of_one_length(vectors.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * 256)).alias("v")), "v")


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Pivots far from one another, picked greedily from the ``sample`` vectors with the least hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # bounded by ``sample``
    points = np.array(sorted({tuple(r["v"]) for r in rows if len(r["v"]) == len(rows[0]["v"])}), float) if rows else np.zeros((0, 1))
    chosen = points[:1]
    gap = ((points - chosen[0]) ** 2).sum(axis=1) if len(points) else points
    while len(chosen) < min(pivots, len(points)):
        chosen = np.concatenate([chosen, points[[int(gap.argmax())]]])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    return chosen


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _keyed_rows(pivots: np.ndarray, top: float):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v")).astype(float)
            far = _distances(v, top, pivots)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(v)), near])], ["vec_id", "v", "pivot", "far"])

    return rows


def _distances(v: np.ndarray, top: float | None, pivots: np.ndarray) -> np.ndarray:
    """Distances of candidates (extra coordinate from ``top``) or of queries (extra coordinate 0: top None) to pivots."""
    extra = 0.0 if top is None else np.maximum(0, top - (v**2).sum(axis=1))[:, None]
    square = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(0, square) + extra)


def _query_rows(pivots: np.ndarray):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_matrix(batch.column("q")).astype(float), None, pivots)
                n, p = far.shape
                at = np.repeat(np.arange(n), p)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(at)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(far.ravel())], ["query_id", "pivot", "far"]
                )

    return rows


def _search_cell(key: tuple, cell: pa.Table, asks: pa.Table, k: int, top: float) -> pa.Table:
    """Best k of each query that visits a cell: annuli around d(q, p), outwards, until the bound ends it."""
    out = ([], [], [])
    if cell.num_rows and asks.num_rows:
        order = np.lexsort((cell.column("vec_id").to_numpy(), cell.column("far").to_numpy()))
        kind = float if top < EXACT else np.int64  # of the products
        v = _matrix(cell.column("v").combine_chunks()).astype(kind)[order]
        far, ids = cell.column("far").to_numpy()[order], cell.column("vec_id").to_numpy()[order]
        q = _matrix(asks.column("q").combine_chunks()).astype(kind)
        least = asks.column("kth").to_numpy(zero_copy_only=False)  # NaN: no k-th score yet
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            norm = (part.astype(float) ** 2).sum(axis=1)
            for i, (own, d, at) in enumerate(zip(asks.column("query_id").to_numpy()[a : a + 512], asks.column("far").to_numpy()[a : a + 512], least[a : a + 512], strict=True)):
                score = np.zeros(0, kind)
                found = np.zeros(0, np.int64)
                lo = hi = int(np.searchsorted(far, d))
                step = max(64, 4 * k)
                while lo > 0 or hi < len(far):
                    reach = np.sqrt(max(0.0, norm[i] + top - 2 * at)) * (1 + SLACK) + slack(top) if at == at else np.inf
                    left, right = max(0, lo - step), min(len(far), hi + step)
                    left = max(left, int(np.searchsorted(far, d - reach))) if lo > 0 else lo
                    right = min(right, int(np.searchsorted(far, d + reach, side="right"))) if hi < len(far) else hi
                    fresh = np.concatenate([np.arange(min(left, lo), lo), np.arange(hi, max(right, hi))])
                    if not len(fresh):
                        break
                    lo, hi, step = min(left, lo), max(right, hi), step * 2
                    fresh = fresh[ids[fresh] != own]
                    score = np.concatenate([score, v[fresh] @ part[i]])
                    found = np.concatenate([found, ids[fresh]])
                    best = np.lexsort((found, -score))[:k]
                    score, found = score[best], found[best]
                    if len(score) == k:
                        at = max(at, float(score[-1])) if at == at else float(score[-1])
                out[0].append(np.full(len(found), own))
                out[1].append(found)
                out[2].append(score)
    kinds = (np.int64, np.int64, np.int64)
    return pa.table([np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])


def _search(cells: DataFrame, visits: DataFrame, k: int, top: float) -> DataFrame:
    def one(key, cell: pa.Table, asks: pa.Table) -> pa.Table:
        return _search_cell(key, cell, asks, k, top)

    return cells.groupBy("cell").cogroup(visits.groupBy("cell")).applyInArrow(one, "query_id long, vec_id long, score long")


def best_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(rows: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS, ring: int = RING) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its ``k`` best other rows (all, if fewer).

    ``rows``: vec_id, embedding. Vectors that are null, empty, hold null or non-finite components or have another length
    than the commonest take no part, nor do null ids. Scores are exact; a squared length of 2**62 or more is an error, as scores may not fit a long. Rows of the query's own id are no candidates; a repeated id is
    a candidate once for each row. Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    vectors = whole_vectors(rows)
    chosen = choose_pivots(vectors, pivots, PIVOT_SAMPLE)
    shape = "query_id long, rank int, vec_id long, score long"
    if not len(chosen):
        return rows.sparkSession.createDataFrame([], shape)
    top = float(vectors.agg(F.max(squared("v"))).first()[0])
    if top >= WIDEST:
        raise ValueError("a vector's squared length is 2**62 or more in steps of 1/256: scores may not fit a long")
    keyed = vectors.mapInArrow(_keyed_rows(chosen, top), "vec_id long, v array<long>, pivot int, far double")

    spread = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000).alias("cuts"))
    used = F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.col("n") / ring)))
    edges = F.filter("cuts", lambda c, i: (i + 1) % F.ceil(64 / F.col("used")) == 0)
    spread = spread.withColumn("used", used).select("pivot", F.array_distinct(edges).alias("edges"))  # one row per pivot
    ringed = keyed.join(F.broadcast(spread), "pivot").withColumn("ring", F.size(F.filter("edges", lambda c: c < F.col("far"))))
    sizes = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer"))
    sizes = checkpoint(sizes.withColumn("splits", F.ceil(F.col("n") / (2 * ring)).cast("int")))  # at most 64 rows per pivot
    placed = ringed.join(F.broadcast(sizes.select("pivot", "ring", "splits")), ["pivot", "ring"])
    split = F.pmod(F.xxhash64("vec_id", "v"), F.col("splits"))
    cells = checkpoint(placed.select(F.struct("pivot", "ring", split.cast("int").alias("split")).alias("cell"), "vec_id", "v", "far"))

    asks = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id", "q"])
    routes = asks.mapInArrow(_query_rows(chosen), "query_id long, pivot int, far double").join(F.broadcast(sizes), "pivot")
    bound = F.greatest(F.lit(0.0), F.col("far") - F.col("outer"), F.col("inner") - F.col("far"))
    routes = checkpoint(routes.select("query_id", "pivot", "ring", "far", "splits", bound.alias("bound")))

    def visits(chosen_routes: DataFrame) -> DataFrame:
        dealt = chosen_routes.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        return dealt.join(asks, "query_id").select(F.struct("pivot", "ring", "split").alias("cell"), "query_id", "q", "far", "kth")

    nearest = routes.groupBy("query_id").agg(F.min(F.struct("bound", "far", "pivot", "ring")).alias("r")).select("query_id", "r.pivot", "r.ring")
    first = routes.join(nearest, ["query_id", "pivot", "ring"], "left_semi").withColumn("kth", F.lit(None).cast("double"))
    start = checkpoint(best_k(_search(cells, visits(first), k, top), k))
    kth = start.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    norms = asks.select("query_id", squared("q").alias("norm"))
    open_ = routes.join(nearest, ["query_id", "pivot", "ring"], "left_anti").join(kth, "query_id", "left").join(norms, "query_id")
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + top - 2 * F.col("kth"))) * (1 + SLACK) + slack(top)
    rest = open_.where(F.col("kth").isNull() | (F.col("bound") <= reach))
    later = _search(cells, visits(rest), k, top)
    return best_k(start.select("query_id", "vec_id", "score").unionByName(later), k)
