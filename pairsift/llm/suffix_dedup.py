"""Removal of every byte covered by a long string that also starts somewhere else in the corpus.

1. Anchors: among the ``length // 4``-byte grams of a window of ``length`` bytes, the one with the least hash (the
   first, of equals) is the window's anchor. It depends on the window's bytes only, so equal windows have equal
   anchors at equal places. One window in ``3/8 * length`` or so starts a new anchor; only anchors are shuffled,
   and only those whose gram occurs twice go on.
2. Contexts: each repeated anchor brings the bytes that its windows span, to the left and to the right.
3. Sorting: the contexts of one gram are ordered as suffixes (to the right) and as reversed prefixes (to the left)
   by deep-shallow sorting. Going through the left order from long to short common prefixes, small groups are
   merged into larger ones that are kept in the right order; neighbours there have the longest common right part. A
   pair that shares ``l`` bytes to the left and ``r`` to the right, with ``l + r >= length``, covers all of them.
   Every comparison is made on bytes.
4. Groups with more than ``CROWD`` contexts don't fit one task. Their windows are named by 128-bit hashes and
   counted by Spark with partial aggregation instead, so a passage of a third of all documents is spread.
5. With ``words``, runs of so many words repeat too, however short the words are. Those of ``length`` bytes or more
   are found above; the few shorter ones are named by 128-bit hashes and counted in the same way.

Whole copies are counted beforehand; each distinct text takes part once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import Seen, few_rows, free_name, keyed_runs, packed_texts, run_starts, text_key, text_slices, with_texts
from pairsift.llm.deep_shallow import common_prefix, deep_shallow_order
from pairsift.llm.words import SPACE, prefix_sums, spans_hash, word_spans
from pairsift.session import checkpoint

CROWD = 20_000
PLACE_BITS = np.uint64(21)
CHUNK = 1 << 20


def window_anchors(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, place, first window, last window) of the anchors of all windows, in chunks of a long text.

    The last anchor of a chunk waits for the next chunk, whose first windows may have the same one: a place is one row.
    """
    width, held = length - gram + 1, None  # grams in a window
    for base in range(0, max(1, len(text) - length + 1), CHUNK):
        part = text[base : base + CHUNK + length - 1]
        if len(part) < length:
            break
        sums = prefix_sums(np.frombuffer(part, np.uint8))
        start = np.arange(len(part) - gram + 1)
        hashes = spans_hash(sums, start, start + gram)
        ranked = (hashes >> PLACE_BITS << PLACE_BITS) | start.astype(np.uint64)
        place = (_sliding_min(ranked, width) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        found = hashes[at].view(np.int64), at + base, first + base, last + base
        if held is not None:
            if held[1][0] == found[1][0]:
                found[2][0] = held[2][0]
            else:
                yield held
        yield tuple(x[:-1] for x in found)
        held = tuple(x[-1:] for x in found)
    if held is not None:
        yield held


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: suffix minima of one block and prefix minima of the next."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, width)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


ANCHOR = "g long, c1 long, c2 long, place int, first int, last int"


def _anchor_rows(length: int, gram: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            c1, c2 = batch.column("c1").to_pylist(), batch.column("c2").to_pylist()
            for begin, texts in text_slices(batch.column("text")):
                got, one, two = [], [], []
                for i, text in enumerate(texts, begin):
                    if len(text) < length or seen((c1[i], c2[i])):
                        continue
                    for found in window_anchors(text, length, gram):
                        got.append(found)
                        one.append(np.full(len(found[0]), c1[i]))
                        two.append(np.full(len(found[0]), c2[i]))
                if got:
                    g, place, first, last = (np.concatenate(x) for x in zip(*got, strict=True))
                    columns = [g, np.concatenate(one), np.concatenate(two)]
                    columns += [x.astype(np.int32) for x in (place, first, last)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "c1", "c2", "place", "first", "last"])

    return rows


def _repeated_rows(crowd: int):
    """From anchors in order: those whose gram has two or more places; ``crowded`` says that it has over ``crowd``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many, gram = 0, None

        def with_mark(part: pa.RecordBatch, mark: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(mark, pa.bool_())], [*part.schema.names, "crowded"])

        for batch in batches:  # a batch holds a bounded number of rows; a run may go on over many batches
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("g", "c1", "c2", "place")])
            fresh = np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0)))
            batch = batch.filter(pa.array(fresh))
            g = g[fresh]
            starts = np.append(run_starts(batch, ["g"]), batch.num_rows)
            sizes = np.diff(starts)
            keep = np.repeat(sizes > 1, sizes)
            mark = np.repeat(sizes > crowd, sizes)
            keep[: starts[1]] = keep[starts[-2] :] = False  # the first and the last run may go on in another batch
            for k, end in ((0, starts[1]), (len(sizes) - 1, len(g))) if len(sizes) > 1 else ((0, len(g)),):
                part = batch.slice(starts[k], end - starts[k])
                if g[starts[k]] != gram:
                    for x in held:
                        if many > 1:
                            yield with_mark(x, np.full(x.num_rows, many > crowd))
                    held, many, gram = [], 0, g[starts[k]]
                held.append(part)
                many += part.num_rows
                if many > crowd:
                    for x in held:
                        yield with_mark(x, np.full(x.num_rows, True))
                    held = []
                if k == 0 and keep.any():
                    yield with_mark(batch.filter(pa.array(keep)), mark[keep])
                    keep[:] = False
        for x in held:
            if many > 1:
                yield with_mark(x, np.full(x.num_rows, many > crowd))

    return rows


CONTEXT = "g long, c1 long, c2 long, place int, crowded boolean, left binary, right binary"


def _context_rows(length: int):
    schema = pa.schema([("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("place", pa.int32()), ("crowded", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            for begin, texts in text_slices(batch.column("text"), 4 << 20):
                out = [[] for _ in schema]
                for i, text in enumerate(texts, begin):
                    c1, c2 = batch.column("c1")[i].as_py(), batch.column("c2")[i].as_py()
                    if (c1, c2) == done:  # another copy of the same text
                        continue
                    done = (c1, c2)
                    for a in batch.column("anchors")[i].as_py():
                        row = (a["g"], c1, c2, a["place"], a["crowded"], text[a["first"] : a["place"]], text[a["place"] : a["last"] + length])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return rows


def longest_matches(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each distinct context, how far matches of ``length`` or more bytes with any other one reach: (left, right).

    (0, 0) means none. ``lefts`` are compared from their ends, ``rights`` from their starts.
    """
    m = len(lefts)
    reach = [(0, 0)] * m

    def note(x: int, y: int, left: int) -> None:
        right = common_prefix(rights[x], rights[y])
        if left + right >= length:
            for z in (x, y):
                reach[z] = max(reach[z][0], left), max(reach[z][1], right)

    turned = [s[::-1] for s in lefts]
    if m == 2:
        note(0, 1, common_prefix(turned[0], turned[1]))
        return reach
    order = deep_shallow_order(rights)
    rank = [0] * m
    for r, i in enumerate(order):
        rank[i] = r
    by_left = deep_shallow_order(turned)
    shared = [common_prefix(turned[a], turned[b]) for a, b in zip(by_left, by_left[1:])]
    parent = list(range(m))
    groups = {i: [rank[i]] for i in range(m)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(m - 1), key=shared.__getitem__, reverse=True):
        a, b = find(by_left[k]), find(by_left[k + 1])
        small, large = (a, b) if len(groups[a]) <= len(groups[b]) else (b, a)
        into, added = groups[large], groups.pop(small)
        parent[small] = large
        for r in added:
            insort(into, r)
        for r in added:
            at = bisect_left(into, r)
            for near in into[max(0, at - 1) : at] + into[at + 1 : at + 2]:
                note(order[r], order[near], shared[k])
    return reach


COVER = "c1 long, c2 long, start int, stop int"


def _each_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of (g, c1, c2, place), each place once: copies of a text that several tasks read bring it again."""
    last = None
    for batch in batches:
        if batch.num_rows:
            place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("g", "c1", "c2", "place")])
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0)
            fresh[0] = last is None or (place[:, 0] != last).any()
            last = place[:, -1]
            yield batch.filter(pa.array(fresh))


def _cover_rows(length: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in keyed_runs(_each_once(batches), ["g"]):
            starts = np.append(run_starts(table, ["g"]), table.num_rows)
            c1, c2, place = (table.column(k).to_pylist() for k in ("c1", "c2", "place"))
            left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
            out = ([], [], [], [])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                alike: dict[tuple[bytes, bytes], list[int]] = {}
                for i in range(a, b):
                    alike.setdefault((left[i], right[i]), []).append(i)
                contexts = list(alike)
                reach = longest_matches([x for x, _ in contexts], [y for _, y in contexts], length) if len(contexts) > 1 else [(0, 0)]
                for (x, y), own, (back, ahead) in zip(contexts, alike.values(), reach, strict=True):
                    if len(own) > 1:
                        back, ahead = len(x), len(y)
                    if back + ahead:
                        for i in own:
                            for column, value in zip(out, (c1[i], c2[i], place[i] - back, place[i] + ahead), strict=True):
                                column.append(value)
            if out[0]:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["c1", "c2", "start", "stop"])

    return rows


def _window_rows(length: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["left"] + row["right"]
                base, count = row["place"] - len(row["left"]), len(text) - length + 1
                named = [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k]] * count, pa.int64()) for k in ("c1", "c2")] + [pa.array(range(base, base + count), pa.int32()), pa.array(named, pa.binary())],
                    ["c1", "c2", "start", "name"],
                )

    return rows


def _crowd_cover(contexts: DataFrame, length: int) -> DataFrame:
    windows = contexts.select("c1", "c2", "place", "left", "right").mapInArrow(_window_rows(length), "c1 long, c2 long, start int, name binary")
    twice = windows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(twice, "name").select("c1", "c2", "start", (F.col("start") + length).alias("stop"))


def short_runs(text: bytes, length: int, words: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of each run of ``words`` words that has under ``length`` bytes, in chunks of a long text."""
    start, stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end] not in SPACE:  # no word is cut
            end += 1
        a, b = word_spans(np.frombuffer(text, np.uint8, end - at, at))
        start, stop = np.concatenate((start, a + at)), np.concatenate((stop, b + at))
        if len(start) >= words:
            first, last = start[: len(start) - words + 1], stop[words - 1 :]
            short = last - first < length
            yield from zip(first[short].tolist(), last[short].tolist(), strict=True)
            start, stop = start[len(first) :], stop[len(first) :]
        at = end


RUN = "c1 long, c2 long, start int, stop int, name binary"


def _run_rows(length: int, words: int):
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("name", pa.binary())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            c1, c2 = batch.column("c1").to_pylist(), batch.column("c2").to_pylist()
            out: list[tuple] = []

            def packed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

            for begin, texts in text_slices(batch.column("text")):
                for i, text in enumerate(texts, begin):
                    if len(text) < 2 * words - 1 or seen((c1[i], c2[i])):
                        continue
                    for a, b in short_runs(text, length, words):
                        out.append((c1[i], c2[i], a, b, hashlib.blake2b(text[a:b], digest_size=16).digest()))
                        if len(out) == 50_000:
                            yield packed()
                            out.clear()
            if out:
                yield packed()

    return rows


def _short_run_cover(texts: DataFrame, length: int, words: int) -> DataFrame:
    """(c1, c2, start, stop) of the short runs of words that also start anywhere else."""
    runs = checkpoint(texts.where(F.octet_length("text") >= 2 * words - 1).mapInArrow(_run_rows(length, words), RUN))
    place = F.struct("c1", "c2", "start")  # a text that several tasks read gives the same place again
    twice = runs.groupBy("name").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("name")
    return runs.join(twice, "name").select("c1", "c2", "start", "stop")


def covered(texts: DataFrame, length: int, crowd: int, words: int | None = None) -> DataFrame:
    """(c1, c2, spans) for the distinct texts that share a string of ``length`` bytes or ``words`` words; ``texts``: c1, c2, text."""
    gram = max(1, length // 4)
    anchors = texts.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, gram), ANCHOR)
    repeated = (
        anchors.repartition("g")
        .sortWithinPartitions("g", "c1", "c2", "place")
        .mapInArrow(_repeated_rows(crowd), ANCHOR + ", crowded boolean")
    )
    per_text = repeated.groupBy("c1", "c2").agg(F.collect_list(F.struct("g", "place", "first", "last", "crowded")).alias("anchors"))
    size = F.octet_length("text")
    packed = texts.where(size >= length).select("c1", "c2", "text", size.alias("size")).mapInArrow(packed_texts(["c1", "c2"]), "c1 long, c2 long, text binary, size int")
    contexts = packed.join(per_text, ["c1", "c2"]).sortWithinPartitions("c1", "c2").mapInArrow(with_texts(_context_rows(length)), CONTEXT)
    contexts = checkpoint(contexts)
    place = ["g", "c1", "c2", "place"]
    few = contexts.where("NOT crowded").repartition("g").sortWithinPartitions(*place).mapInArrow(_cover_rows(length), COVER)
    spans = few.unionByName(_crowd_cover(contexts.where("crowded").dropDuplicates(place), length))
    if words:
        spans = spans.unionByName(_short_run_cover(texts, length, words))
    return spans.groupBy("c1", "c2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _marks(texts: DataFrame, length: int, crowd: int, words: int | None = None) -> DataFrame:
    """(c1, c2, spans) of the texts that have anything to remove; ``texts``: c1, c2, text, copies included."""
    size, blank = F.octet_length("text"), F.lit(SPACE.decode())
    enough, start, stop = size >= length, F.lit(0), size
    if words:  # a shorter text repeats from its first word to its last
        many = F.size(F.split(F.trim("text", blank), f"[{SPACE.decode()}]+")) >= words
        start = F.when(enough, 0).otherwise(size - F.octet_length(F.ltrim("text", blank)))
        stop = F.when(enough, size).otherwise(F.octet_length(F.rtrim("text", blank)))
        enough = F.when(enough, True).when(size >= 2 * words - 1, many).otherwise(False)
    copies = texts.where(enough).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max(start).alias("start"), F.max(stop).alias("stop")).where("n > 1")
    whole = F.array(F.struct("start", "stop"))
    marks = copies.select("c1", "c2", whole.alias("whole")).join(covered(texts, length, crowd, words), ["c1", "c2"], "full")
    return marks.select("c1", "c2", F.coalesce("whole", "spans").alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 400, crowd: int = CROWD, words: int | None = None, out: str = "_spans") -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with ``out`` (not one of their names): the byte spans to remove, unmerged, or null.

    A span covers bytes of strings of ``length`` UTF-8 bytes that also start anywhere else, in the same text or in
    another row; strings never cross rows. Judged on the input. A null or short text has none. With ``words``, runs of
    so many words (of bytes but ASCII white space) count as well, with the white space between them.
    """
    keys = [free_name("_c1", docs), free_name("_c2", docs)]
    keyed = docs.withColumns(dict(zip(keys, text_key(F.col("text")), strict=True)))
    texts = keyed.select(F.col(keys[0]).alias("c1"), F.col(keys[1]).alias("c2"), F.col("text").cast("string").alias("text"))
    marks = _marks(texts, length, crowd, words).withColumnsRenamed({"c1": keys[0], "c2": keys[1], "spans": out})
    return keyed.join(marks, keys, "left").drop(*keys)


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        ids = batch.column("doc_id")
        for first, texts in text_slices(batch.column("text")):
            rows = []
            for i, text in enumerate(texts, first):
                spans = merged([(s["start"], s["stop"]) for s in batch.column("_spans")[i].as_py() or ()])
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(text, spans)).hexdigest()))
            columns = [ids.slice(first, len(texts)), *[pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without merged ``spans``."""
    if not spans:
        return text
    ends = [0, *[b for _, b in spans]]
    starts = [*[a for a, _ in spans], len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def _kept_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut ``text`` by the spans in the last column."""
    for batch in few_rows(batches):
        *columns, spans = batch.columns
        names = batch.schema.names[:-1]
        at = names.index("text")
        old = columns[at].to_pylist()
        new = [cut(t.encode(), merged([(s["start"], s["stop"]) for s in x])).decode(errors="ignore") if t and x else t for t, x in zip(old, spans.to_pylist(), strict=True)]
        columns[at] = pa.array(new, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names)


def removal_report(docs: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; null text is empty, null ids and repeated rows stay."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))
    marks = _marks(rows.select("c1", "c2", "text"), length, crowd).withColumnRenamed("spans", "_spans")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    packed = rows.select("*", size).mapInArrow(packed_texts(), "doc_id long, c1 long, c2 long, text binary, size int")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return packed.join(marks, ["c1", "c2"], "left").select("doc_id", "text", "size", "_spans").mapInArrow(with_texts(_digest_rows), shape)


def remove_repeats(docs: DataFrame, length: int = 400, crowd: int = CROWD, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text``; all rows and other columns stay as they are.

    A multi-byte character of which a part is removed goes as a whole. A text that is all repeats becomes empty.
    """
    spans = free_name("_spans", docs)
    marked = repeated_spans(docs, length, crowd, words, spans)
    return marked.select(*docs.columns, spans).mapInArrow(_kept_texts, docs.schema)
