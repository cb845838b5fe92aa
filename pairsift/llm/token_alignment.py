"""Alignment of two tokenizers: byte-level BPE (A) and SentencePiece (B) over the same bytes.

Both tokenizers see a blank and then the text. A byte offset where a token of A and a token of B end cuts both id lists into groups;
inside a group every pair of tokens whose byte ranges overlap is a link.

A text is cut before each blank that follows a character which is not white space. A's own splitting starts a new pre-token there, and no
piece of B holds a blank behind another character (checked when the model is loaded; if one does, texts stay whole), so these
units are aligned on their own and their borders are group borders. Each worker remembers the aligned units within a bound; a giant text is a
list of units like any other. Only a unit without such a blank is encoded whole, however long. Runs of units are aligned together with
numpy: each byte offset where a token of either side ends closes exactly one link.

How many documents hold an id pair linked is a corpus-wide count. Each document's distinct pairs are written once, compressed; the most
widespread pairs (at most ``TABLE``, found from a histogram of the counts) are broadcast and answered in place, only the others are shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import SLICE_BYTES, text_slices
from pairsift.session import materialise, scratch_path

TABLE = 1 << 19
CACHE_UNITS = 300_000
CACHED_LENGTH = 64  # longer units are aligned each time
_CUT = re.compile(r"(?<=\S) ")
_BEFORE_BLANK = re.compile(r"\s ")
_LEARN = 4096
_JOINED = 64  # units encoded as one text
_RUN = 1 << 16  # units of a document that are put together at once
_PAIRS = 1 << 20
_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def common_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) of each group, from cumulative byte ends of both token lists."""
    index_a = {end: k for k, end in enumerate(ends_a)}
    index_b = {end: k for k, end in enumerate(ends_b)}
    out, a, b = [], 0, 0
    for end in sorted(index_a.keys() & index_b.keys()):
        to_a, to_b = index_a[end] + 1, index_b[end] + 1
        out.append((a, to_a, b, to_b))
        a, b = to_a, to_b
    return out


def links_of(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """The id pairs of overlapping tokens within one group; both sides cover the same bytes there."""
    a, to_a, b, to_b = group
    if to_a - a == 1:
        return [(ids_a[a], y) for y in ids_b[b:to_b]]
    if to_b - b == 1:
        return [(x, ids_b[b]) for x in ids_a[a:to_a]]
    out = [(ids_a[a], ids_b[b])]
    while a + 1 < to_a or b + 1 < to_b:
        if ends_a[a] < ends_b[b]:
            a += 1
        else:
            b += 1
        out.append((ids_a[a], ids_b[b]))
    return out


# what one stretch of text adds to its document: its groups as text, n_a, n_b, n_groups, and its links with ids of A and B in one 64-bit number each
Unit = tuple[str, int, int, int, bytes]


def _sizes(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens, default=-1) + 1, np.int64)
    for i, token in tokens.items():
        out[i] = len(token)
    return out


def _per_unit(stops: np.ndarray) -> list[int]:
    return np.diff(stops, prepend=0).tolist()


class Aligner:
    """Both tokenizers and the units aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        symbol = byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {i: bytes(symbol[c] for c in s) if all(c in symbol for c in s) else s.encode() for s, i in vocabulary.items()}
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = _sizes(self.bytes_a), _sizes(dict(enumerate(self.bytes_b)))
        # how an id is written: within its side of a group, and at the end of that side
        self.words = [f"{i}{end}" for size, last in ((self.size_a, "|"), (self.size_b, ";")) for i in range(len(size)) for end in (",", last)]
        self.widths = np.array([len(w) for w in self.words], np.int64)
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.known: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def units(self, text: str) -> list[str]:
        """The units of a blank and ``text``, each without the blank it starts with."""
        whole = " " + text
        if not self.cuts:
            return [text]
        if not _BEFORE_BLANK.search(whole):
            return whole.split(" ")[1:]
        parts = _CUT.split(whole)
        parts[0] = parts[0][1:]
        return parts

    def align(self, units: list[str], joined: int = 1) -> list[Unit | None]:
        """Alignments of units; None where a side's bytes are not the unit's.

        Runs of ``joined`` units are encoded as one text, so all but a run's last must end where a text is cut. Units are told apart by their
        bytes; where those of any differ, each half is encoded on its own.
        """
        texts = [" ".join(units[k : k + joined]) for k in range(0, len(units), joined)]
        encoded_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        list_a = list(chain.from_iterable([e.ids for e in encoded_a]))
        # a blank alone at the end of a text: the library adds none to an empty text
        list_b = list(chain.from_iterable([ids if t else [self.b.piece_to_id("▁")] for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]))
        borders = np.cumsum([len(u.encode()) + 1 for u in units])
        flat_a, flat_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        stops_a, stops_b = np.searchsorted(ends_a, borders) + 1, np.searchsorted(ends_b, borders) + 1
        whole = "".join([" " + t for t in texts]).encode()
        same = b"".join(map(self.bytes_a.__getitem__, list_a)) == whole == b"".join(map(self.bytes_b.__getitem__, list_b))
        if not same or not np.array_equal(ends_a[stops_a - 1], borders) or not np.array_equal(ends_b[stops_b - 1], borders):
            half = len(units) // 2
            return [*self.align(units[:half], joined), *self.align(units[half:], joined)] if half else [None]
        is_end_a, is_end_b = np.zeros(len(whole) + 1, bool), np.zeros(len(whole) + 1, bool)
        is_end_a[ends_a] = is_end_b[ends_b] = True
        ends = np.flatnonzero(is_end_a | is_end_b)
        from_a, from_b = is_end_a[ends], is_end_b[ends]
        # the tokens before an end: as many as ended earlier
        pairs = (flat_a[np.cumsum(from_a) - from_a] << 32 | flat_b[np.cumsum(from_b) - from_b]).astype("<i8").tobytes()
        last_a, last_b = is_end_b[ends_a], is_end_a[ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        words = np.empty(len(flat_a) + len(flat_b), np.int64)  # of each group A's tokens, then B's
        words[np.arange(len(flat_a)) + (np.cumsum(many_b) - many_b)[group_a]] = 2 * flat_a + last_a
        words[np.arange(len(flat_b)) + np.cumsum(many_a)[group_b]] = 2 * (len(self.size_a) + flat_b) + last_b
        text = "".join(map(self.words.__getitem__, words.tolist()))
        links = np.searchsorted(ends, borders) + 1
        stops, to = np.cumsum(self.widths[words])[stops_a + stops_b - 1].tolist(), (8 * links).tolist()
        groups = [text[i : j - 1] for i, j in zip([0, *stops], stops)]
        packed = [pairs[i:j] for i, j in zip([0, *to], to)]
        return list(zip(groups, _per_unit(stops_a), _per_unit(stops_b), _per_unit(np.cumsum(from_a & from_b)[links - 1]), packed, strict=True))

    def learn(self, units: set[str]) -> dict[str, Unit | None]:
        """Alignments of all ``units``; short ones are remembered, those not met for long are forgotten first."""
        known, older = self.known, self.older
        found: dict[str, Unit | None] = {}
        inner, final = [], []  # units that end as those before a cut do, and others
        for u in units:
            if u in known:
                found[u] = known[u]
            elif u in older:
                found[u] = known[u] = older[u]
            else:
                (inner if self.cuts and u and not u[-1].isspace() else final).append(u)
        for missing, joined in ((inner, _JOINED), (final, 1)):
            for k in range(0, len(missing), _LEARN):
                part = missing[k : k + _LEARN]
                found.update(zip(part, self.align(part, joined), strict=True))
            known.update([(u, found[u]) for u in missing if len(u) <= CACHED_LENGTH])
        if len(known) > CACHE_UNITS // 2:
            self.known, self.older = {}, known
        return found

    def document(self, units: list[str], known: dict[str, Unit | None]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, how often each) of a document."""
        none = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        totals, digest, found = [0, 0, 0, 0], hashlib.sha256(), []
        for k in range(0, len(units), _RUN):
            parts = [known[u] for u in units[k : k + _RUN]]
            if None in parts:
                return none
            groups, *counts, pairs = zip(*parts, strict=True)
            digest.update(((";" if k else "") + ";".join(groups)).encode())
            links = np.frombuffer(b"".join(pairs), "<i8")
            totals = [n + m for n, m in zip(totals, (*map(sum, counts), len(links)), strict=True)]
            found.append(np.unique(links, return_counts=True))
        if not found:
            return none
        distinct, often = found[0]
        if len(found) > 1:
            often = np.concatenate([n for _, n in found])
            distinct, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, at, often)
            often = sums
        return *totals, digest.hexdigest(), distinct, often


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _align_rows(path_a: str, path_b: str):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for first, raw in text_slices(batch.column("text"), 2 * SLICE_BYTES):
                units = [both.units(t.decode()) if t else [] for t in raw]
                known = both.learn(set().union(*units))
                made = [both.document(u, known) for u in units]
                ids = batch.column("doc_id").slice(first, len(raw))
                counts = [pa.array([m[k] for m in made], pa.int64()) for k in range(4)]
                packed = [pa.array([m[k].astype("<i8").tobytes() for m in made], pa.binary()) for k in (5, 6)]
                yield pa.RecordBatch.from_arrays([ids, *counts, pa.array([m[4] for m in made], pa.string()), *packed], [*_COLUMNS[:5], "groups_sha256", "pairs", "times"])

    return rows


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One written row per document: ``row`` (a number of its own), the report's columns and its distinct pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_align_rows(path_a, path_b), f"{_REPORT}, pairs binary, times binary")
    path = scratch_path(docs.sparkSession, "aligned")
    numbered = made.withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def _pair_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs): distinct pairs of runs of documents, counted before the shuffle."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "docs"])

    held, size = [], 0
    for batch in batches:
        for packed in batch.column("pairs"):
            held.append(np.frombuffer(packed.as_buffer(), "<i8"))
            size += len(held[-1])
            if size >= _PAIRS:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether its A id has no pair with more; written once."""
    counts = aligned.select("pairs").mapInArrow(_pair_rows, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = materialise(counts, "pair-counts").withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # at most one row for each id of A
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def widespread(counts: DataFrame, size: int = TABLE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, pairs, counts, best) of all pairs with at least that count: the most, up to ``size`` pairs.

    The least count comes from a histogram of counts in steps of a sixteenth of a power of two, so the driver gets at most about a thousand
    rows and then at most ``size`` pairs.
    """
    width = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2("docs")) - 4))
    step = (F.floor(F.col("docs") / width) * width).cast("long")
    bins = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for bound, n in bins:
        if total + n > size:
            break
        least, total = bound, total + n
    table = counts.where(F.col("docs") >= F.lit(least)).toArrow().combine_chunks().sort_by("pair")
    return least, *[np.asarray(table.column(c).to_numpy(), kind) for c, kind in (("pair", np.int64), ("docs", np.int64), ("best", bool))]


def _looked_up(batch: pa.RecordBatch, table: Broadcast) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per document: its pairs, how often each, and each one's place in the broadcast table (-1: not there)."""
    known = table.value[0]
    for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
        p, t = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "<i8")
        at = np.minimum(np.searchsorted(known, p), max(0, len(known) - 1))
        yield p, t, np.where(known[at] == p, at, -1) if len(known) else np.full(len(p), -1)


def _answered_rows(table: Broadcast):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, best = table.value
        for batch in batches:
            sums, bests = [], []
            for _, t, at in _looked_up(batch, table):
                hit = at >= 0
                sums.append(int((t[hit] * docs[at[hit]]).sum()))
                bests.append(int(t[hit][best[at[hit]]].sum()))
            names = ["row", *_COLUMNS[:5], "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums, pa.int64()), pa.array(bests, pa.int64())], [*names, "hot_sum", "hot_best"])

    return rows


def _open_rows(table: Broadcast):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (p, t, at) in zip(batch.column("row").to_pylist(), _looked_up(batch, table), strict=True):
                cold = at < 0
                if cold.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(cold.sum()), row)), pa.array(p[cold]), pa.array(t[cold])], ["row", "pair", "times"])

    return rows


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, table: int = TABLE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (doc_id, text).

    Texts that are null, empty, or whose tokens' bytes differ from a blank and the text (B normalises them) have no
    tokens: zeros and an empty string. Every row is a document, so repeated rows count as often as they occur and get equal reports;
    null ids stay. Special strings in a text are plain text. Other columns are ignored; an empty table gives an empty result.
    The size of the broadcast table changes the speed only.
    """
    aligned = aligned_documents(docs, path_a, path_b)
    counts = pair_counts(aligned)
    least, *columns = widespread(counts, table)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(columns))
    answered = aligned.mapInArrow(_answered_rows(shared), f"row long, {_REPORT}, hot_sum long, hot_best long")
    cold = counts.where(F.col("docs") < F.lit(least))  # each in fewer documents than ``table`` others, or in as many
    open_pairs = aligned.select("row", "pairs", "times").mapInArrow(_open_rows(shared), "row long, pair long, times long")
    found = open_pairs.join(cold, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("docs")).alias("cold_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("cold_best")
    )
    both = answered.join(found, "row", "left")
    none = F.lit(0).cast("long")
    return both.withColumns(
        {"n_best": F.col("hot_best") + F.coalesce("cold_best", none), "count_sum": F.col("hot_sum") + F.coalesce("cold_sum", none)}
    ).select(*_COLUMNS)
