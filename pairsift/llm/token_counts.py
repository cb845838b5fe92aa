"""Exact token counts of a byte-level BPE, by a map-side lookup in two tiers.

A text is cut before each blank that follows a character which is not white space. The tokenizer's own splitting always
starts a new pre-token there, so the pieces can be counted on their own. Tier one is a broadcast table of the
lengths of frequent pieces (at most ``TABLE`` of them, each at most ``LONGEST`` characters); tier two is a cache in
each worker, filled by encoding what the table lacks. No piece is ever shuffled. The table comes from a bounded sample
of documents; it decides the speed only, the counts are the same with an empty one.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import least_hashed, text_slices

TABLE = 16_384
LONGEST = 32
SAMPLE = 1_024
CACHE_LIMIT = 800_000
_BEFORE_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-@\[-`{-~\n]|$)")


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pre_tokens(text: str) -> list[str]:
    """The pieces of a text, without the blank that each but the first one starts with."""
    return _CUT.split(text) if _BEFORE_BLANK.search(text) else text.split(" ")


class Lengths(dict):
    """Piece -> number of tokens; starts as a copy of the broadcast table and learns misses within a bound.

    A missed piece that is a run of Latin letters and something else is counted as these two parts, since the
    tokenizer splits there too; so words are learnt once, not once for each mark behind them.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.path, self.frequent, self.rests = path, frequent, {}

    def learn(self, pieces: set[str]) -> None:
        """Add the lengths of ``pieces``, none of them known."""
        if len(self.rests) > CACHE_LIMIT:
            self.rests.clear()
        split = {p: m.end() for p in pieces if (m := _LETTERS.match(p)) and m.end() < len(p)}
        words = list({p[: split[p]] if p in split else p for p in pieces} - self.keys())
        rests = list({p[k:] for p, k in split.items()} - self.rests.keys())
        self.update(zip(words, lengths_of(self.path, [" " + w for w in words]), strict=True))
        self.rests.update(zip(rests, lengths_of(self.path, rests), strict=True))
        for p, k in split.items():
            self[p] = self[p[:k]] + self.rests[p[k:]]

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts."""
        cut = [pre_tokens(t) for t in texts]
        firsts = lengths_of(self.path, [pieces[0] for pieces in cut])
        every = set().union(*[pieces[1:] for pieces in cut])
        unknown = every - self.keys()
        if len(self) + len(unknown) > CACHE_LIMIT:
            self.clear()
            self.update(self.frequent)
            unknown = every - self.keys()
        self.learn(unknown)
        return [n + sum(map(self.__getitem__, pieces[1:])) for n, pieces in zip(firsts, cut, strict=True)]


def lengths_of(path: str, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _frequent_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(p for p in pre_tokens(text or "")[1:] if len(p) <= LONGEST)
    top = seen.most_common(TABLE)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, size: int = TABLE) -> dict[str, int]:
    """Token counts of the pieces most frequent in ``sample`` documents, those with the least hash of their text."""
    chosen = least_hashed(docs.select("text").where(F.octet_length("text") < 1 << 16), F.xxhash64("text"), sample)
    top = chosen.select("text").mapInArrow(_frequent_rows, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r["piece"] for r in top.orderBy(F.desc("n"), "piece").limit(size).collect()]  # bounded by ``size``
    return dict(zip(pieces, lengths_of(path, [" " + p for p in pieces]), strict=True))


@cache
def _lengths(path: str, table: Broadcast) -> Lengths:
    return Lengths(path, table.value)


def _count_rows(path: str, table: Broadcast, limit: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, table)
        for batch in batches:
            for first, raw in text_slices(batch.column("text")):
                n = lengths.counts([t.decode() for t in raw])
                columns = [batch.column("doc_id").slice(first, len(raw)), pa.array([len(t) for t in raw], pa.int64())]
                columns += [pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = 512, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Counts are the library's, without added special tokens; special strings in a text count as the library's default
    has them. A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path, sample))
    return rows.mapInArrow(_count_rows(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
