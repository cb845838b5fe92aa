"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Every text becomes the sorted 64-bit hashes of its distinct word shingles. Texts with equal sets are one class.
2. Sizes are cut into bands so wide that two linked sets lie in one band or in neighbouring ones. For such a pair of
   bands, linked sets differ in at most ``d`` shingles. The hash space is cut into ``d + 1`` equal parts; by the
   pigeonhole principle two linked sets agree on the whole of at least one part. The tile of a set is
   (bands, part, hash of the set's shingles in that part): linked sets share a tile, and sets that only share a
   passage rarely do.
3. In a tile, sizes and the Hamming distance of the sets' hashed parity bitmaps bound the overlap from
   above: ``|A & B| <= (|A| + |B| - hamming) / 2``. Pairs below the threshold's overlap are ruled out: in tiles by
   bitmaps of at most ``SHORT_BITS`` bits, then pair by pair by bitmaps of up to ``MOST_BITS``; they follow the size of the sets.
4. The others are decided by an exact intersection of their sorted arrays.

Only links that join components matter, so pairs are verified in rounds, and a group of near copies costs about as many
pairs as it has members. In the first round, each set is paired with the tile leader (the first member) that it shares
most tiles with. In ``NEAREST_ROUNDS`` further rounds (one), each set is paired with the nearest member, by bitmaps, of another
component in its tiles. The last round takes all pairs of a tile whose members are still in different
components and whose bounds allow a link; so no link between components is lost. Tiles are handled in blocks
of ``BLOCK`` sets, and pairs of blocks are dealt out like tiles; tiles within one component are done.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import Seen, few_rows, free_name, keyed_runs, run_starts, text_key, text_slices
from pairsift.llm.components import components
from pairsift.llm.words import mix, shingle_sets
from pairsift.session import checkpoint

LEAST_BITS, SHORT_BITS, MOST_BITS = 1 << 10, 1 << 13, 1 << 16
BLOCK = 1024
NEAREST_ROUNDS = 1
SENT_IDS = 1 << 20  # the most class ids that are broadcast; more are shuffled
HELD_SHINGLES = 2_000_000  # a task's memory for shingle arrays while it verifies pairs
_SEED = {name: np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)) for k, name in enumerate(("class", "check", "part", "tile"), 1)}


class Bands:
    """Bands of set sizes for a threshold ``num / den``, and the parts of each pair of neighbouring bands."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den, self.starts = num, den, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self._grow()
        return bisect_right(self.starts, size) - 1

    def _grow(self) -> None:
        last = self.starts[-1]
        self.starts.append(max(last + 1, -(-last * self.den // self.num)))

    def parts(self, band: int) -> int:
        """One more than the most shingles in which linked sets of ``band`` and the next band differ."""
        while len(self.starts) < band + 2:
            self._grow()
        small = self.starts[band + 1] - 1
        both = small + small * self.den // self.num
        return both * (self.den - self.num) // (self.den + self.num) + 1

    def linked(self, common, total):
        """Whether sets of sizes adding up to ``total`` with ``common`` shared shingles are linked."""
        return self.den * common >= self.num * (total - common)


@cache
def _edges(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)


def tile_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ _SEED["part"]), out=sums[1:])
    band, out = bands.of(len(shingles)), []
    for family in (band, band - 1):
        if family < 0:
            continue
        k = bands.parts(family)
        cut = np.concatenate(([0], np.searchsorted(shingles, _edges(k)), [len(shingles)]))
        own = sums[cut[1:]] - sums[cut[:-1]]
        name = np.uint64(family << 32) + np.arange(k, dtype=np.uint64)
        out.append(mix(own + mix(name ^ _SEED["tile"])))
    return np.concatenate(out)


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set; the first names its class."""
    one, two = (mix(shingles ^ _SEED[s]).sum(dtype=np.uint64) for s in ("class", "check"))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the counts of hashes, modulo a power of two that follows the size of the set."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << len(shingles).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmaps: list[bytes], bits: int | None = None) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, longer ones folded by XOR to the shortest (or ``bits``): parities modulo it."""
    words = bits // 64 if bits else min(map(len, bitmaps)) // 8
    rows = [np.frombuffer(x, np.uint64) for x in bitmaps]
    return np.array([np.bitwise_xor.reduce(r.reshape(-1, words)) if len(r) > words else r for r in rows])


def _set_rows(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("chk", pa.int64()), ("bits", pa.binary()), ("short", pa.binary())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, t2 = (batch.column(k) for k in ("doc_id", "t", "t2"))
            for first, texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts, width)
                named = [class_of(s) if len(s) else (None, None) for s in sets]
                maps = [bitmap(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)),
                        t.slice(first, len(texts)),
                        t2.slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in named], pa.int64()),
                        pa.array([b for _, b in named], pa.int64()),
                        pa.array(maps, pa.binary()),
                        pa.array([m and folded([m], min(8 * len(m), SHORT_BITS)).tobytes() for m in maps], pa.binary()),
                    ],
                    schema=schema,
                )

    return rows


def _key_rows(width: int, num: int, den: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), Seen()
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                keys, names = [], []
                for s in shingle_sets(texts, width):
                    if len(s) and not seen(name := class_of(s)[0]):
                        keys.append(tile_keys(s, bands).view(np.int64))
                        names.append(np.full(len(keys[-1]), name, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], ["key", "cls"])

    return rows


def _tile_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, cls) in order: the members of each tile of two or more, in blocks.

    A tile of one block is named by its members, so equal tiles meet later; a larger one keeps its key, and each
    of its blocks also gets the tile's first member.
    """
    key = first = last = None
    block, held, out = 0, [], ([], [], [])

    def close(final: bool) -> None:
        nonlocal block, held
        if len(held) > 1:
            name = key if block or not final else int(mix(np.array(held, np.int64).view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
            for k, column in enumerate(([name] * len(held), [block] * len(held), held)):
                out[k].extend(column)
        block, held = block + 1, [first]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["tile", "block", "cls"])
        for c in out:
            c.clear()
        return made

    for rows in batches:
        if not rows.num_rows:
            continue
        k, c = rows.column("key").to_numpy(), rows.column("cls").to_numpy()
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        near = same.copy()
        near[:-1] |= same[1:]
        near[0] = near[-1] = True  # their tile may go on in another batch
        for kk, cc in zip(k[near].tolist(), c[near].tolist(), strict=True):
            if kk != key:
                close(True)
                key, first, last, block, held = kk, cc, cc, 0, [cc]
            elif cc != last:
                last = cc
                held.append(cc)
                if len(held) > BLOCK:
                    close(False)
        if len(out[0]) > 50_000:
            yield batch()
    close(True)
    if out[0]:
        yield batch()


def _leader_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of each run of (tile, block): its first member with each other one."""
    for table in keyed_runs(batches, ["tile", "block"]):
        starts, cls = run_starts(table, ["tile", "block"]), table.column("cls").to_numpy()
        leader = np.repeat(cls[starts], np.diff(np.append(starts, len(cls))))
        yield pa.RecordBatch.from_arrays([pa.array(leader[leader != cls]), pa.array(cls[leader != cls])], ["a", "b"])


def _pair_rows(num: int, den: int, nearest: bool):
    """In each run of (tile, block, other), pairs of different components whose bounds allow a link: (a, b, gap).

    ``nearest``: for each member only the one with the least gap, a bitmap distance relative to the sizes.
    """
    keys = ["tile", "block", "other"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for table in keyed_runs(batches, keys):
            starts = np.append(run_starts(table, keys), table.num_rows)
            cls, n, root = (table.column(k).to_numpy() for k in ("cls", "n", "root"))
            maps = table.column("bits").to_pylist()
            out = ([], [], [])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                size, own, bits = n[a:b], root[a:b], folded(maps[a:b])
                for i in range(b - a):
                    rest = np.flatnonzero(own != own[i]) if nearest else i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
                    if not len(rest):
                        continue
                    total = size[i] + size[rest]
                    differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    most = np.minimum((total - differ) // 2, np.minimum(size[i], size[rest]))
                    found = np.flatnonzero(bands.linked(most, total))
                    gap = differ[found] / total[found]
                    if nearest and len(found):
                        found, gap = found[[gap.argmin()]], gap[[gap.argmin()]]
                    out[0].append(np.full(len(found), cls[a + i]))
                    out[1].append(cls[a + rest[found]])
                    out[2].append(gap)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "gap"])

    return rows


def _packed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, t2, packed) of the texts, copies in a task once: a packed text takes a third of the bytes of its shingle array."""
    seen = Seen()
    for batch in batches:
        keys = list(zip(batch.column("t").to_pylist(), batch.column("t2").to_pylist(), strict=True))
        for first, texts in text_slices(batch.column("text")):
            kept = [(*keys[i], zlib.compress(x, 1)) for i, x in enumerate(texts, first) if x and not seen(keys[i])]
            if kept:
                types = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], ["t", "t2", "packed"])


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verified_rows(width: int, num: int, den: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, size = Bands(num, den), {}, 0
        for batch in few_rows(batches):
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "left", "right")), strict=True):
                if size > HELD_SHINGLES:
                    held, size = {}, 0
                new = {k: zlib.decompress(v) for k, v in ((a, x), (b, y)) if k not in held}
                for k, s in zip(new, shingle_sets(list(new.values()), width), strict=True):
                    held[k], size = s, size + len(s)
                keep.append(bool(bands.linked(common_count(held[a], held[b]), len(held[a]) + len(held[b]))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _possible_rows(num: int, den: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in few_rows(batches):
            keep = []
            for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in ("an", "bn", "abits", "bbits")), strict=True):
                one, two = folded([x, y])
                keep.append(bool(bands.linked(min(m, n, (m + n - int(np.bitwise_count(one ^ two).sum())) // 2), m + n)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _packed_texts(rows: DataFrame, tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, packed): one text of each class that shares a tile with another, packed and shuffled once for all rounds."""
    named = tiles.select("cls").distinct().join(classes.select("cls", "t", "t2"), "cls")
    texts = rows.mapInArrow(_packed_rows, "t long, t2 long, packed binary").join(named, ["t", "t2"])
    return texts.groupBy("cls").agg(F.min("packed").alias("packed"))


def _verify(pairs: DataFrame, classes: DataFrame, packed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose shingle arrays reach the threshold; whole bitmaps rule out most others beforehand.

    Packed texts are joined and their arrays made beside the intersection, so that less is written to disk.
    """
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(end), F.col("n").alias(f"{end}n"), F.col("bits").alias(f"{end}bits")), end)
    pairs = checkpoint(pairs.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(_possible_rows(num, den), "a long, b long"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    if pairs.count() * 2 <= SENT_IDS:
        ends = F.broadcast(ends)
    packed = packed.join(ends, "cls", "left_semi")
    # by b first: most pairs share their leader a, whose text then needn't be copied for each of them
    right = pairs.join(packed.select(F.col("cls").alias("b"), F.col("packed").alias("right")), "b")
    both = right.join(packed.select(F.col("cls").alias("a"), F.col("packed").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_verified_rows(width, num, den), "a long, b long")


def _open_tiles(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """The tiles with members in different components, with each member's ``root``."""
    placed = tiles.select("tile", "block", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = placed.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tile")
    return checkpoint(placed.join(mixed, "tile", "left_semi"))


def _dealt(tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with sizes and bitmaps, once for each pair of blocks of their tile, sorted by (tile, block, other).

    Pairs of blocks whose members are all in one component are left out.
    """
    blocks = tiles.groupBy("tile", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    others = blocks.select("tile", F.col("block").alias("with"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    mixed = blocks.join(others, "tile").where(F.least("lo", "lo2") < F.greatest("hi", "hi2")).select("tile", "block", "with")
    dealt = tiles.join(mixed, ["tile", "block"])
    dealt = dealt.withColumns({"other": F.greatest("block", "with"), "block": F.least("block", "with")}).drop("with")
    dealt = dealt.join(classes.select("cls", "n", F.col("short").alias("bits")), "cls")
    return dealt.repartition("tile", "block", "other").sortWithinPartitions("tile", "block", "other", "cls")


def _grouped_rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, t, t2, n, rep, root, component_id) per row of ``docs``; t, t2: the text's key, ``root`` names the component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns(dict(zip(("t", "t2"), text_key(F.col("text")), strict=True)))
    shape = "doc_id long, t long, t2 long, n long, cls long, chk long, bits binary, short binary"
    sets = checkpoint(rows.mapInArrow(_set_rows(width), shape))
    groups = sets.where("n > 0").groupBy("cls", "chk", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("t", "t2")).alias("t"), F.min("bits").alias("bits"), F.min("short").alias("short"))
    classes = checkpoint(groups.select("cls", "chk", "n", "rep", "t.t", "t.t2", "bits", "short"))
    keys = rows.select("text").mapInArrow(_key_rows(width, num, den), "key long, cls long")
    tiles = keys.repartition("key").sortWithinPartitions("key", "cls")
    tiles = checkpoint(tiles.mapInArrow(_tile_rows, "tile long, block int, cls long").dropDuplicates(["tile", "block", "cls"]))
    packed = checkpoint(_packed_texts(rows, tiles, classes))

    led = tiles.repartition("tile", "block").sortWithinPartitions("tile", "block", "cls").mapInArrow(_leader_rows, "a long, b long")
    shared = led.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    asked = checkpoint(shared.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    found = checkpoint(components(_verify(asked, classes, packed, width, num, den)))
    for turn in range(NEAREST_ROUNDS + 1):
        last = turn == NEAREST_ROUNDS
        tiles = _open_tiles(tiles, found)
        pairs = _dealt(tiles, classes).mapInArrow(_pair_rows(num, den, not last), "a long, b long, gap double")
        if not last:
            best = pairs.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("best"))
            pairs = best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
        else:
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        asked_now = checkpoint(pairs.distinct().join(asked, ["a", "b"], "left_anti"))
        links = _verify(asked_now, classes, packed, width, num, den)
        asked = asked.unionByName(asked_now)
        found = checkpoint(components(links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))))

    reps = classes.select("cls", "chk", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "root").select("cls", "chk", "rep", "root", "component_id")
    return sets.join(named, ["cls", "chk"], "left").select("doc_id", "t", "t2", "n", "rep", "root", "component_id")


def ngram_jaccard_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, is_copy) per row of ``docs`` (doc_id long, text string).

    Links: Jaccard similarity of the shingle sets >= num / den. component_id is the smallest doc_id reachable by
    links. Words are runs of non-white-space bytes, A-Z lower-cased. Fewer words than ``width`` make one shingle;
    a null, empty or blank text has none and is linked with nothing (its component is its own doc_id). Rows with a
    null doc_id keep it; their component is the smallest known id of their group, or null. Repeated rows give
    repeated results. Other columns are not used. An empty table gives an empty result. ``is_copy``: another
    class member (equal shingle sets) has a smaller doc_id.
    """
    return _grouped_rows(docs, width, num, den).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)).alias("is_copy"),
    )


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows are told apart by doc_id and text: repeated rows become one, and of different texts in a group under its
    smallest doc_id one stays; a text of another group stays whatever its doc_id. Rows with a null doc_id can't be told
    apart and stay, as do texts without words.
    """
    groups = _grouped_rows(docs, width, num, den).where("doc_id IS NOT NULL")
    place = F.min(F.struct("t", "t2")).alias("first")
    firsts = groups.where("n > 0 AND doc_id = component_id").groupBy("root", "doc_id").agg(place).select("doc_id", "first.t", "first.t2")
    keys = [free_name("_t", docs), free_name("_t2", docs)]
    stay = firsts.unionByName(groups.where("n = 0").select("doc_id", "t", "t2")).withColumnsRenamed(dict(zip(("t", "t2"), keys, strict=True)))
    keyed = docs.withColumns(dict(zip(keys, text_key(F.col("text").cast("string")), strict=True)))
    known = keyed.join(stay, ["doc_id", *keys], "left_semi").dropDuplicates(["doc_id", *keys])
    return known.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
