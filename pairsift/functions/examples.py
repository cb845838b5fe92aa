"""Array columns for prompt-masked training examples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

IGNORE = -100
MAX_IDS = 256

Tokenizer = Callable[[Column], Column]


def _id_lists(texts: pa.Array, encode: Callable[[str], bytes], unit: str) -> pa.Array:
    """The units of each encoded text as a list of ids; a null text gives null."""
    coded = [b"" if t is None else encode(t) for t in texts.to_pylist()]
    ids = np.frombuffer(b"".join(coded), dtype=unit).astype(np.int32)
    ends = np.cumsum([0, *map(len, coded)]) // np.dtype(unit).itemsize
    missing = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=missing)


@F.arrow_udf(ArrayType(IntegerType()))
def _code_points(texts: pa.Array) -> pa.Array:
    return _id_lists(texts, lambda t: (t or "\0").encode("utf-32-le"), "<u4")  # an empty text is one id, 0


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_ids(texts: pa.Array) -> pa.Array:
    return _id_lists(texts, lambda t: t.encode("utf-8"), "u1")


def code_points(x: Column) -> Column:
    """Default tokenizer: one id per code point."""
    return _code_points(x)


def byte_ids(x: Column) -> Column:
    """A second built-in tokenizer: one id per UTF-8 byte."""
    return _byte_ids(x)


def truncate_ids(ids: Column, limit: int = MAX_IDS) -> Column:
    return F.slice(ids, 1, limit)


def mask_labels(ids: Column, n_prompt: Column, limit: int = MAX_IDS) -> Column:
    """Labels = ids with the prompt part replaced by the ignore marker."""
    n = F.size(ids)
    hidden = F.when(n_prompt > limit, n).otherwise(F.least(n_prompt, n))
    return F.concat(F.array_repeat(F.lit(IGNORE), hidden), F.slice(ids, hidden + 1, F.greatest(n, F.lit(1))))


def pad_array(ids: Column, to: Column, filler: int, side: str) -> Column:
    gap = F.array_repeat(F.lit(filler), to - F.size(ids))
    return F.concat(gap, ids) if side == "left" else F.concat(ids, gap)


def log_prob_of_gold(logits: Column, gold: Column, temperature: float = 2.0, floor: float | None = 1e-8) -> Column:
    """log softmax(logits / T)[gold], floored at ln(floor) if given; null where gold is the ignore marker."""
    z = F.transform(logits.cast("array<double>"), lambda v: v / temperature)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    picked = F.get(z, gold)
    log_prob = picked - top - F.ln(total)
    return F.when(gold != IGNORE, log_prob if floor is None else F.greatest(log_prob, F.ln(F.lit(floor))))
