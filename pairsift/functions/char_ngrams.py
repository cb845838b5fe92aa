"""Character and word n-gram overlap of two texts in one row.

Both texts are already in the row, so no shuffle is needed. Exploding every character six
times over and grouping would make a hash table of all n-grams of a partition; here a
batch is counted by sorting integers, and memory is bounded by ``CHUNK`` characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

CHUNK = 1_000_000


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer("".join((text or "").split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _compact(codes: np.ndarray) -> np.ndarray:
    """The codes of a chunk by their rank among those that occur in it."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    return (np.cumsum(seen) - 1)[codes]


def _overlap(pairs: list[tuple[np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """Per row: hyp, ref and clipped matches for n = 1..order, shape (rows, order, 3).

    An n-gram is one integer: its row above its codes, and the side in the lowest bit. One sort of these values puts equal n-grams of
    a row beside each other and the rows in their order; no index is sorted. N-grams too long for 62 bits are numbered first.
    """
    sizes = np.array([len(t) for pair in pairs for t in pair], dtype=np.int64)
    codes = np.concatenate([t for pair in pairs for t in pair])
    side = np.tile(np.array([0, 1], np.int64), len(pairs)).repeat(sizes)
    gram = (np.arange(len(sizes)) // 2).repeat(sizes)  # n-grams of different rows never meet
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the end
    bits, used = int(codes.max(initial=0)).bit_length(), len(pairs).bit_length()
    out = np.zeros((len(pairs), order, 3), np.int64)
    start = np.arange(len(codes))
    for n in range(1, order + 1):
        keep = left[start] >= n
        start, gram = start[keep], gram[keep]
        if not len(start):
            break
        if used + bits > 62:
            numbers, gram = np.unique(gram, return_inverse=True)  # in the order of the rows, as before
            used = len(numbers).bit_length()
        gram, used = (gram << bits) | codes[start + n - 1], used + bits
        found = np.sort((gram << 1) | side[start])
        held = np.maximum(sizes - n + 1, 0).reshape(-1, 2)
        first = np.flatnonzero(np.concatenate(([True], (found[1:] >> 1) != (found[:-1] >> 1))))
        total, ref = np.diff(first, append=len(found)), np.add.reduceat(found & 1, first)
        row = np.repeat(np.arange(len(pairs)), held.sum(axis=1))[first]
        out[:, n - 1, :2] = held
        out[:, n - 1, 2] = np.bincount(row, np.minimum(total - ref, ref), len(pairs))
    return out


def _char_overlap(pairs: list, order: int) -> np.ndarray:
    ends = np.cumsum([len(t) for pair in pairs for t in pair])
    sides = np.split(_compact(np.concatenate([t for pair in pairs for t in pair])), ends[:-1])
    return _overlap(list(zip(sides[::2], sides[1::2], strict=True)), order)


def _word_overlap(pairs: list, order: int) -> np.ndarray:
    """As ``_overlap`` for arrays of tokens, numbered within the row."""
    coded = []
    for pair in pairs:
        numbers: dict[str, int] = {}
        coded.append(tuple(np.array([numbers.setdefault(t, len(numbers)) for t in side], np.int64) for side in pair))
    return _overlap(coded, order)


def _in_chunks(rows, order: int, count) -> pd.Series:
    done, chunk, size = [], [], 0
    for pair in rows:
        chunk.append(pair)
        size += len(pair[0]) + len(pair[1])
        if size >= CHUNK:
            done.append(count(chunk, order))
            chunk, size = [], 0
    if chunk:
        done.append(count(chunk, order))
    return pd.Series([row for part in done for row in part.reshape(-1, order * 3)])


def char_overlap(hyp: Column, ref: Column, order: int) -> Column:
    """array<bigint> of (hyp, ref, match) for n = 1..order; a null text is empty."""

    @F.pandas_udf(ArrayType(LongType()))
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        return _in_chunks(((_codes(a), _codes(b)) for a, b in zip(h, r)), order, _char_overlap)

    return counts(hyp, ref)


def word_overlap(hyp: Column, ref: Column, order: int) -> Column:
    """array<bigint> of (hyp, ref, match) for n = 1..order of two arrays of tokens; a null array is empty."""

    @F.pandas_udf(ArrayType(LongType()))
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        none = ()
        return _in_chunks(((none if a is None else a, none if b is None else b) for a, b in zip(h, r)), order, _word_overlap)

    return counts(hyp, ref)
