"""Nearest neighbours by cosine with a block matrix join: int8 tiles, error bounds, exact recomputation.

Vectors are scaled to length one and quantised to int8 with a scale of their own. Rows are dealt into blocks of about
``BLOCK`` by hash, queries into blocks of ``QUERY_BLOCK``. A tile is one query block times one vector block: the integer
product gives every cosine up to an error that the quantisation errors bound (``e_q + e_x + e_q * e_x`` by Cauchy and
Schwarz). A pair survives if its upper bound reaches the k-th largest lower bound of its query. Survivors are
recomputed in double precision from the original vectors, each tile keeps k of a query, and heaps merge the tiles.
No neighbour within the bounds is lost: recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.pivot_topk import _matrix
from pairsift.llm.vectors import of_one_length, usable
from pairsift.session import checkpoint

BLOCK = 4_096
QUERY_BLOCK = 1_024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error of unit vectors: ``|u - scale * code| <= error`` for each row."""
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    unit = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * code) ** 2).sum(axis=1))
    return code, scale, error * (1 + 1e-9) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; equal rows give equal numbers wherever they lie."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _tile(key: tuple, block: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    out = ([], [], [])
    if block.num_rows and asks.num_rows:
        x, q = (_matrix(t.column("v").combine_chunks()).astype(float) for t in (block, asks))
        ids, own = block.column("vec_id").to_numpy(), asks.column("query_id").to_numpy()
        (cx, sx, ex), (cq, sq, eq) = quantise(x), quantise(q)
        # products of int8 codes are whole numbers below 2**24 for up to 1000 components: float64 holds them exactly
        near = (cq.astype(np.float64) @ cx.T.astype(np.float64)) * sq[:, None] * sx[None, :]
        error = eq[:, None] + ex[None, :] + eq[:, None] * ex[None, :] + 1e-9
        low = np.where(own[:, None] == ids[None, :], -np.inf, near - error)
        last = max(0, len(ids) - k)
        least = np.partition(low, last, axis=1)[:, last]
        qi, xi = np.nonzero((near + error >= least[:, None]) & (own[:, None] != ids[None, :]))
        score = cosines(q[qi], x[xi])
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        start = np.searchsorted(qi, qi)
        best = np.arange(len(qi)) - start < k
        out = ([own[qi[best]]], [ids[xi[best]]], [score[best]])
    kinds = (np.int64, np.int64, np.float64)
    return pa.table([np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])


def _merged_rows(k: int):
    """From rows in order of query_id: each query's k best, by a heap of its tiles' lists."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []
        out = ([], [], [], [])

        def close() -> None:
            for r, (score, vec) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])), 1):
                for column, value in zip(out, (query, r, -vec, score), strict=True):
                    column.append(value)

        for batch in batches:
            for own, vec, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if own != query:
                    close()
                    query, heap = own, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        close()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return rows


def nearest_by_cosine(rows: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its ``k`` nearest other rows (all, if fewer).

    ``rows``: vec_id, embedding. Vectors that are null, empty, zero, hold null or non-finite components or have
    another length than the commonest take no part, nor do null ids. Ties go to the smaller vec_id; a repeated id is a candidate once
    for each row. An empty table gives an empty result. Blocks are dealt by hash, so equal vectors spread.
    """
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    vectors = of_one_length(vectors.where(F.col("vec_id").isNotNull() & usable(F.col("v"), nonzero=True)), "v")
    counts = vectors.agg(F.count(F.lit(1)), F.sum((F.col("vec_id") % every == 0).cast("long"))).first()
    blocks, query_blocks = (max(1, -(-(n or 0) // size)) for n, size in zip(counts, (block, query_block), strict=True))
    placed = checkpoint(vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    asks = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    asks = asks.withColumn("a", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(query_blocks)).cast("int"))
    # the stated query set against all rows, in blocks: queries go to every vector block, vectors to every query block
    left = placed.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def one(key, x: pa.Table, q: pa.Table) -> pa.Table:
        return _tile(key, x, q, k)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(one, "query_id long, vec_id long, score double")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged_rows(k), "query_id long, rank int, vec_id long, score double")
