"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SEEN_LIMIT = 200_000


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch's texts into runs of about ``limit`` bytes: (index of the first, texts); null is empty.

    A run is made when it is asked for: of a batch's texts, only one run is held as Python objects.
    """
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    upto, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(upto):
        before = int(upto[first - 1]) if first else 0
        end = min(int(np.searchsorted(upto, before + limit)) + 1, len(upto))
        yield first, [t or b"" for t in column.slice(first, end - first).cast(pa.large_binary()).to_pylist()]
        first = end


def few_rows(batches: Iterable[pa.RecordBatch], limit: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` rows, for steps that hold their rows as Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, limit):
            yield batch.slice(first, limit)


def keyed_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``: tables that hold whole runs of equal keys only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = run_starts(batch, keys)
        last = int(change[-1])
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def run_starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins; keys are non-null integers."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = rows.column(k).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: together they name a text."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(7), text).alias("c2")]


def least_hashed(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those of least ``key`` (a 64-bit hash), one for each hash.

    The border is found from the hashes alone, 8 bytes a row; of the rows, only those below it are moved.
    """
    hashes = rows.select(key.alias("_h")).distinct().orderBy("_h").limit(n)
    border = hashes.agg(F.max("_h").alias("_h")).first()["_h"]
    if border is None:
        return rows.where("false")
    return rows.withColumn("_h", key).where(F.col("_h") <= F.lit(border)).dropDuplicates(["_h"]).drop("_h")


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores behind it until no column of ``tables`` is called so (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Seen:
    """Remembers keys of one task, within a bound; forgetting one costs a repeated row, nothing else."""

    def __init__(self, limit: int = SEEN_LIMIT):
        self.limit, self.keys = limit, set()

    def __call__(self, key) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= self.limit:
            self.keys.clear()
        self.keys.add(key)
        return False


def packed_texts(once: list[str] | None = None):
    """For rows with ``text`` and ``size`` (its bytes): ``text`` packed, null as empty. ``once``: keys that each task gives one row for."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = pa.Codec("zstd", compression_level=1), Seen()
        for batch in batches:
            for first, texts in text_slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                if once:
                    keep = [not seen(k) for k in zip(*(part.column(k).to_pylist() for k in once), strict=True)]
                    part, texts = part.filter(pa.array(keep)), [t for t, k in zip(texts, keep, strict=True) if k]
                packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([packed if k == "text" else part.column(k) for k in part.schema.names], part.schema.names)

    return rows


def with_texts(rows: Callable):
    """``rows`` on batches whose ``text`` is packed: it gets them with the bytes of the texts, a few rows at a time."""

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in few_rows(batches):
            both = zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True)
            texts = pa.array([codec.decompress(x, n, asbytes=True) if n else b"" for x, n in both], pa.large_binary())
            yield pa.RecordBatch.from_arrays([texts if k == "text" else batch.column(k) for k in batch.schema.names], batch.schema.names)

    return lambda batches: rows(unpacked(batches))
