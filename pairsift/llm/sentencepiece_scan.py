"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The text is a lattice. For a unigram model the edges are pieces with their scores. For a BPE model no piece crosses the
start of a run of blanks behind another character, so the units between such places are merged on their own: the
edges are units with the sum of their pieces' scores, and the best path is what the library's merges give for the
whole text.

A document longer than ``CHUNK`` characters is cut into chunks of ``CHUNK`` characters, at any place. The state at a
boundary is how far the edge that straddles it reaches over it. Each chunk yields the max-plus transfer matrix from
states at its start to states at its end. The matrices are combined associatively by a prefix scan, which gives the
states of the best path at every boundary; each chunk then traces its own part back. Chunks are dealt out to all
tasks, twice: for their matrices and for their traces.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import text_key
from pairsift.session import checkpoint

CHUNK = 1 << 15
CACHE_LIMIT = 100_000  # units that a worker remembers
_LEARN = 4096
_JOINED = 64  # units encoded as one text
_CUT = re.compile("(?<=[^ ▁])(?= )")
Matrix = dict[tuple[int, int], float]


class _Units:
    """Piece ids of units (without their first blank) as bytes; short units are remembered within a bound."""

    def __init__(self, model, sizes: np.ndarray):
        self.model, self.sizes = model, sizes
        self.blank = np.array([model.piece_to_id("▁")], np.int32).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of all ``units``; those not met for long are forgotten first."""
        known, older = self.known, self.older
        found: dict[str, bytes] = {}
        inner, final = [], []  # units that end as those before a cut do, and others
        for u in units:
            if u in known:
                found[u] = known[u]
            elif u in older:
                found[u] = known[u] = older[u]
            else:
                (inner if u and u[-1] not in " ▁" else final).append(u)
        for missing, joined in ((inner, _JOINED), (final, 1)):
            for k in range(0, len(missing), _LEARN):
                part = missing[k : k + _LEARN]
                found.update(zip(part, self._encoded(part, joined), strict=True))
            known.update([(u, found[u]) for u in missing if len(u) <= 64])
        if len(known) > CACHE_LIMIT // 2:
            self.known, self.older = {}, known
        return found

    def _encoded(self, units: list[str], joined: int) -> list[bytes]:
        """Runs of ``joined`` units as one text each, told apart by their bytes; in halves where those of any differ."""
        if len(units) == 1:
            return [np.array(self.model.encode(units[0]), np.int32).tobytes() if units[0] else self.blank]
        texts = [" ".join(units[k : k + joined]) for k in range(0, len(units), joined)]
        ids = np.array(list(chain.from_iterable(self.model.encode(texts, num_threads=1))), np.int32)
        ends = np.cumsum(self.sizes[ids])
        borders = np.cumsum([len(u.replace("▁", " ").encode()) + 1 for u in units])
        at = np.searchsorted(ends, borders)
        if not len(ends) or ends[-1] != borders[-1] or not np.array_equal(ends[at], borders):
            half = len(units) // 2
            return [*self._encoded(units[:half], joined), *self._encoded(units[half:], joined)]
        packed, stops = ids.tobytes(), (4 * (at + 1)).tolist()
        return [packed[i:j] for i, j in zip([0, *stops], stops)]


class Pieces:
    """A SentencePiece model: edges of the lattice, encoding, decoding."""

    def __init__(self, model_file: str | None = None, model_proto: bytes | None = None, unigram: bool = False):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file) if model_file else sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        self.unigram = unigram
        self.scores = np.array([m.get_score(i) for i in range(m.get_piece_size())])
        self.bytes = [self._bytes(i) for i in range(m.get_piece_size())]
        self.units = _Units(m, np.array([len(x) for x in self.bytes], np.int64))
        if unigram:
            usual = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
            self.trie = {m.id_to_piece(i): i for i in usual}
            self.longest = max(map(len, self.trie))
            self.unknown = float(self.scores[usual].min()) - 10.0  # as the library's unknown penalty

    def _bytes(self, i: int) -> bytes:
        m = self.model
        if m.is_control(i):
            return b""
        if m.is_unknown(i):
            return " ⁇ ".encode()
        piece = m.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if m.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> bytes:
        """Piece ids of a whole text as little-endian 32-bit numbers."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """``ids`` of each text; what they share is looked up once."""
        if self.unigram:
            return [self.trace(text_body(t), 0, len(t) + 1, 0, 0) if t else b"" for t in texts]
        units = [self._cut(t) if t else [] for t in texts]
        known = self.units.learn(set().union(*units))
        return [b"".join(map(known.__getitem__, u)) for u in units]

    def _cut(self, text: str) -> list[str]:
        """The units of a whole text, each without its first blank."""
        whole = " " + text
        if "  " in whole or "▁" in whole:
            return [u[1:] for u in _CUT.split(whole)]
        return text.split(" ")

    def text(self, ids: bytes) -> str:
        joined = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode(errors="replace")
        return joined[1:] if joined.startswith(" ") else joined

    # -- lattice of a chunk: ``body`` starts with the character before the chunk ---------------------------------

    def stretch(self, body: str, size: int) -> tuple[list[int], int, list[bytes]]:
        """The edges of a BPE chunk: the places in [0, size) where units start, where the last one ends, and the ids of each."""
        cuts = [m.end() for m in _CUT.finditer(body)]
        own = cuts[: bisect_right(cuts, size)]
        end = cuts[len(own)] if len(own) < len(cuts) else len(body)
        units = [body[a + 1 : b] for a, b in zip(own, [*own[1:], end])]
        known = self.units.learn(set(units))
        return [at - 1 for at in own], end - 1, [known[u] for u in units]

    def edges(self, body: str, at: int) -> list[tuple[int, float, bytes]]:
        """(end, score, ids) of the edges of a unigram chunk from place ``at``."""
        out, rest = [], body[at + 1 : at + 1 + self.longest].replace(" ", "▁")
        for n in range(1, len(rest) + 1):
            i = self.trie.get(rest[:n])
            if i is not None:
                out.append((at + n, float(self.scores[i]), np.array([i], np.int32).tobytes()))
        if not out or out[0][0] != at + 1:
            unknown = [self.model.piece_to_id(f"<0x{b:02X}>") for b in rest[0].encode()]
            out.append((at + 1, self.unknown, np.array(unknown, np.int32).tobytes()))
        return out

    def matrix(self, body: str, size: int) -> Matrix:
        """Best scores from each entry state to each exit state of a chunk of ``size`` characters."""
        if not self.unigram:
            places, end, ids = self.stretch(body, size)
            if not places:  # one unit goes on through the whole chunk
                return {(end, end - size): 0.0}
            return {(places[0], end - size): float(self.scores[np.frombuffer(b"".join(ids), np.int32)].sum())}
        width = self.longest
        best = np.full((size + width + 1, width), -np.inf)
        for e in range(min(width, size + 1)):
            best[e, e] = 0.0
        for at in range(size):
            if np.isfinite(best[at]).any():
                for end, s, _ in self.edges(body, at):
                    np.maximum(best[end], best[at] + s, out=best[end])
        ends = [(e, x) for x in range(width) for e in range(width) if np.isfinite(best[size + x, e]) and size + x < len(body)]
        return {(e, x): float(best[size + x, e]) for e, x in ends}

    def trace(self, body: str, entry: int, size: int, leave: int, start: int = 0) -> bytes:
        """Ids of the best path from state ``entry`` to state ``leave`` of a chunk."""
        if not self.unigram:
            places, _, ids = self.stretch(body, size)
            return b"".join(ids[bisect_left(places, entry) :])
        best, back = {entry: 0.0}, {}
        for at in range(entry, size):
            if at in best:
                for end, s, ids in self.edges(body, at):
                    if best[at] + s > best.get(end, -np.inf):
                        best[end], back[end] = best[at] + s, (at, ids)
        out, at = [], size + leave
        while at > entry:
            at, ids = back[at]
            out.append(ids)
        return b"".join(reversed(out))


def text_body(text: str) -> str:
    """A whole text as one chunk: an empty-like character before it, and the blank that the library puts in front."""
    return "\n " + text


def combine(one: Matrix, two: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices; associative."""
    by: dict[int, list[tuple[int, float]]] = {}
    for (j, k), s in two.items():
        by.setdefault(j, []).append((k, s))
    out: Matrix = {}
    for (i, j), s in one.items():
        for k, t in by.get(j, ()):
            if s + t > out.get((i, k), -np.inf):
                out[i, k] = s + t
    return out


def prefix_products(ms: list[Matrix]) -> list[Matrix]:
    """Products of the first 1, 2, ... matrices, by pairs: as deep as the logarithm of their number."""
    if len(ms) < 2:
        return list(ms)
    pairs = prefix_products([combine(a, b) for a, b in zip(ms[::2], ms[1::2])])
    return [m for k in range(len(ms)) for m in [ms[0] if k == 0 else pairs[k // 2] if k % 2 else combine(pairs[k // 2 - 1], ms[k])]]


def best_states(ms: list[Matrix]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the best path, which starts and ends at state 0."""
    upto, leave, out = prefix_products(ms), 0, []
    for k in range(len(ms) - 1, -1, -1):
        ways = [(upto[k - 1][0, i] + s, -i, i) for (i, x), s in ms[k].items() if x == leave and (0, i) in upto[k - 1]] if k else [(0.0, 0, 0)]
        entry = max(ways)[2]
        out.append((entry, leave))
        leave = entry
    return out[::-1]


@cache
def load(path: str, unigram: bool) -> Pieces:
    return Pieces(path, unigram=unigram)


def _ids_array(ids: list[bytes | None]) -> pa.Array:
    offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _small_rows(path: str, unigram: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, p = batch.schema.get_field_index("text"), load(path, unigram)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_array(p.ids_of([t or "" for t in part.column(at).to_pylist()]))], [*part.schema.names, "ids"])

    return rows


CHUNK_ROW = "c1 long, c2 long, k int, size int, far int, body string"


def text_chunks(p: Pieces, text: str, chunk: int) -> Iterator[tuple[int, int, str | None]]:
    """(size, how far the last edge reaches over the end, body) of each chunk of a text.

    A chunk that lies within one unit has no body, as nothing starts in it.
    """
    whole = text_body(text)
    ahead = 1  # the first cut behind the start of the chunk; text_body has one there
    for start in range(0, len(whole) - 1, chunk):
        size = min(chunk, len(whole) - 1 - start)
        if p.unigram:
            yield size, 0, whole[start : start + 2 + size + p.longest]
            continue
        starts = ahead <= start + size
        if starts:
            cut = _CUT.search(whole, start + 1 + size)
            ahead = cut.end() if cut else len(whole)
        yield size, ahead - 1 - start - size, whole[start : ahead + 1] if starts else None


def _chunk_rows(path: str, unigram: bool, chunk: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path, unigram)
        for batch in batches:
            for c1, c2, text in zip(*(batch.column(k).to_pylist() for k in ("c1", "c2", "text")), strict=True):
                out = ([], [], [], [], [], [])
                for k, (size, far, body) in enumerate(text_chunks(p, text, chunk)):
                    for column, value in zip(out, (c1, c2, k, size, far, body), strict=True):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["c1", "c2", "k", "size", "far", "body"])

    return rows


def chunk_matrix(p: Pieces, size: int, far: int, body: str | None) -> Matrix:
    return {(size + far, far): 0.0} if body is None else p.matrix(body, size)


def _matrix_rows(path: str, unigram: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path, unigram)
        for batch in batches:
            args = zip(*(batch.column(k).to_pylist() for k in ("size", "far", "body")), strict=True)
            ms = [[{"e": e, "x": x, "s": s} for (e, x), s in chunk_matrix(p, *a).items()] for a in args]
            kind = pa.list_(pa.struct([("e", pa.int32()), ("x", pa.int32()), ("s", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("c1", "c2", "k")], pa.array(ms, kind)], ["c1", "c2", "k", "matrix"])

    return rows


def _state_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            chunks = sorted(row["chunks"], key=lambda c: c["k"])
            states = best_states([{(m["e"], m["x"]): m["s"] for m in c["matrix"]} for c in chunks])
            n = len(states)
            columns = [pa.array([row["c1"]] * n, pa.int64()), pa.array([row["c2"]] * n, pa.int64()), pa.array(range(n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([s[i] for s in states], pa.int32()) for i in (0, 1)]], ["c1", "c2", "k", "entry", "leave"])


def _trace_rows(path: str, unigram: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path, unigram)
        for batch in batches:
            args = zip(*(batch.column(k).to_pylist() for k in ("body", "entry", "size", "leave")), strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("c1", "c2", "k")], _ids_array([b"" if a[0] is None else p.trace(*a) for a in args])], ["c1", "c2", "k", "ids"])

    return rows


def encode_pieces(docs: DataFrame, model: str, unigram: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the pieces of ``text`` without begin and end marks.

    ``model``: path of the model file, the same on all machines; its normalizer must be the identity with a blank put
    in front. ``unigram``: find the best-scoring segmentation instead of BPE merges. Null and empty texts have
    no pieces; all rows and other columns stay (a column named ``ids`` is replaced). Byte fallback is used as the model
    has it.
    """
    docs = docs.drop("ids")
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "ids array<int>"])
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = docs.where(~giant).mapInArrow(_small_rows(model, unigram), shape)

    large = docs.where(giant).withColumns(dict(zip(("_c1", "_c2"), text_key(F.col("text")), strict=True)))
    texts = large.select(F.col("_c1").alias("c1"), F.col("_c2").alias("c2"), "text")
    chunks = texts.mapInArrow(_chunk_rows(model, unigram, chunk), CHUNK_ROW)
    chunks = checkpoint(chunks.dropDuplicates(["c1", "c2", "k"]))
    matrices = chunks.mapInArrow(_matrix_rows(model, unigram), "c1 long, c2 long, k int, matrix array<struct<e:int,x:int,s:double>>")
    states = matrices.groupBy("c1", "c2").agg(F.collect_list(F.struct("k", "matrix")).alias("chunks"))
    states = states.mapInArrow(_state_rows, "c1 long, c2 long, k int, entry int, leave int")
    traced = chunks.join(states, ["c1", "c2", "k"]).mapInArrow(_trace_rows(model, unigram), "c1 long, c2 long, k int, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    whole = traced.groupBy("c1", "c2").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
    whole = whole.withColumnsRenamed({"c1": "_c1", "c2": "_c2"})
    return small.unionByName(large.join(whole, ["_c1", "_c2"]).select(*docs.columns, "ids"))


def _per_row(ids: pa.Array, made: Callable[[bytes], str]) -> pa.Array:
    """``made`` of each row's ids as bytes (null for null), a few rows at a time."""
    parts = []
    for first in range(0, len(ids), 256):
        rows = [None if x.values is None else np.asarray(x.values, np.int32).tobytes() for x in ids.slice(first, 256)]
        parts.append(pa.array([None if x is None else made(x) for x in rows], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _decoded(path: str) -> Callable[[Column], Column]:
    def decoded(ids: pa.Array) -> pa.Array:
        return _per_row(ids, load(path, False).text)

    return F.arrow_udf(decoded, "string")


def _digest() -> Callable[[Column], Column]:
    def digest(ids: pa.Array) -> pa.Array:
        return _per_row(ids, lambda x: hashlib.sha256(x).hexdigest())

    return F.arrow_udf(digest, "string")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids`` (null for null). Undoes ``encode_pieces`` but for U+2581, a blank."""
    return rows.drop("decoded").withColumn("decoded", _decoded(model)(F.col("ids")))


def round_trip() -> Column:
    """Whether ``decoded`` is ``text``; null text is empty."""
    return F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")


def piece_report(docs: DataFrame, model: str, unigram: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256 of the ids as little-endian int32, round_trip: decoding gives the text back)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = decode_pieces(encode_pieces(rows, model, unigram, chunk), model)
    # column functions: Spark decodes and digests in one Python worker for each task, not in one for each step
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), _digest()(F.col("ids")).alias("ids_sha256"), round_trip().alias("round_trip"))
