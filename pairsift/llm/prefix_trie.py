"""A trie of conversation prefixes with subtree totals by centroid decomposition.

Turns are hashed where they are read; no text is shuffled. The key of a prefix is the XOR of 128-bit hashes of (turn, position), so prefixes
are found by a running XOR, block by block within a conversation: a conversation with a third of all turns is scanned by many tasks.

Subtree totals come from the parent-edge forest, split again and again at centroids. Each component is a connected part of the trie
with a top. Its centroid is its deepest node that holds at least half of its weight (weight: members of all its nodes). What the centroid and the
parts below it add up to is added to every node on the path from the centroid to the top; then the centroid is done, and the parts below it
and the part above it are components of at most half the weight. Components over ``BOUND`` are split in rounds of joins, whose
number follows the logarithm of the number of turns; smaller ones are finished by one task each, in the same way, with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsift.llm.common import keyed_runs
from pairsift.operators.ordering import number_rows
from pairsift.operators.skew import spread_lookup
from pairsift.session import materialise

SHARE = 100  # so many consecutive ids share the first turns of the least of them
HEAD = 6  # they share at most HEAD - 1 turns
BLOCK = 4096
BOUND = 8192
_KEY = ["k1", "k2"]
_COMP = ["c1", "c2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, t1, t2, chars): turns as hashes, numbered from 0 in each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), text, role).alias("t2"),
        F.length(text).cast("long").alias("chars"),
    )
    return number_rows(rows, ["has_turn", "at", "t1", "t2"], "i", within=["conv"]).select("conv", "i", "t1", "t2", "chars")


def _shared(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEAD).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as rows (conv, depth, t1, t2, chars, len), depth from 1, and (conv, len) of all."""
    turns = materialise(_turns(conversations), "turns")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    root = F.col("conv") - F.col("conv") % SHARE
    heads = sizes.where(F.col("conv") % SHARE == 0).select(F.col("conv").alias("root"), F.col("n").alias("n_root"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    taken = F.least("h", F.coalesce("n_root", F.lit(0)))
    convs = (
        sizes.withColumn("root", root).withColumn("h", _shared(F.col("conv")))
        .join(heads, "root", "left")  # less than 2 * SHARE conversations have one root
        .withColumn("m", taken).withColumn("total", total)
        .withColumn("len", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    )
    convs = materialise(convs.select("conv", "root", "h", "m", "len", "n", "total"), "conversations")
    facts = convs.select("conv", "n", "total", "m", "len", "h")
    own = spread_lookup(turns, facts, "conv", weight="n", total="total", spread_by="t1").where("i >= h")
    own = own.select("conv", (F.col("m") + F.col("i") - F.col("h") + 1).alias("depth"), "t1", "t2", "chars", "len")
    first = turns.where((F.col("conv") % SHARE == 0) & (F.col("i") < HEAD - 1)).withColumnRenamed("conv", "root")
    head = convs.select("conv", "root", "h", "len").join(first, "root").where("i < h")
    return own.unionByName(head.select("conv", (F.col("i") + 1).alias("depth"), "t1", "t2", "chars", "len")), convs.select("conv", "len")


def positions(conversations: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, u1, u2, chars, len): the key of every prefix and of the prefix before it; written once."""
    rows, convs = rebuilt(conversations)
    rows = rows.withColumns({"x1": F.xxhash64("t1", "t2", "depth"), "x2": F.xxhash64(F.lit(7), "t2", "t1", "depth"), "block": F.floor(F.col("depth") / BLOCK)})
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumns({"p1": F.bit_xor("x1").over(inside), "p2": F.bit_xor("x2").over(inside)})
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("len") >= BLOCK).groupBy("conv", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    carried = blocks.select("conv", "block", F.bit_xor("b1").over(before).alias("o1"), F.bit_xor("b2").over(before).alias("o2")).where("o1 IS NOT NULL")
    zero = F.lit(0).cast("long")
    keyed = scanned.join(carried, ["conv", "block"], "left").withColumns(
        {"k1": F.col("p1").bitwiseXOR(F.coalesce("o1", zero)), "k2": F.col("p2").bitwiseXOR(F.coalesce("o2", zero))}
    )
    keyed = keyed.select("conv", "depth", *_KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("u2"), "chars", "len")
    none = F.lit(None).cast("long")
    tops = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("u1"), none.alias("u2"), zero.alias("chars"), "len")
    return materialise(keyed.unionByName(tops), "positions")


def trie_nodes(places: DataFrame) -> DataFrame:
    """One row per node: its key and its parent's, smallest member, counts, and its own shares of the totals; written once."""
    nodes = places.groupBy(*_KEY).agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"), F.min("u1").alias("u1"), F.min("u2").alias("u2"),
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.where("u1 IS NOT NULL").groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children.withColumnsRenamed({"u1": "k1", "u2": "k2"}), _KEY, "left")
    counted = materialise(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    total = counted.agg(F.count(F.lit(1)).alias("total")).scalar()
    facts = counted.where("n_children > 0").select(F.struct(*_KEY).alias("up"), F.col("conv").alias("parent_conv_id"), "n_children", total.alias("total"))
    keyed = counted.withColumn("up", F.when(F.col("u1").isNotNull(), F.struct(F.col("u1").alias("k1"), F.col("u2").alias("k2"))))
    return spread_lookup(keyed, facts, "up", weight="n_children", total="total", spread_by="k1").drop("up")


def roll_up(nodes: DataFrame, places: DataFrame, bound: int = BOUND) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens): totals of every node's subtree."""
    zero = F.lit(0).cast("long")
    state = nodes.select(
        *_KEY, "u1", "u2", zero.alias("c1"), zero.alias("c2"), "conv", "depth", "weight",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        zero.alias("add_leaf"), zero.alias("add_saved"),
    )
    finished: list[DataFrame] = []
    while True:
        sized = _with_component(state)
        small = sized.where(F.col("total") <= bound).select(*state.columns)
        finished.append(_finish(small))
        large = materialise(sized.where(F.col("total") > bound), "large")
        if large.isEmpty():
            break
        state, done = _split(large, places, state.columns)
        finished.append(done)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def _with_component(state: DataFrame) -> DataFrame:
    """Add ``total`` (the weight of the node's component), ``top`` (its least depth) and ``n`` (its nodes)."""
    facts = state.groupBy(*_COMP).agg(F.max("weight").alias("total"), F.min("depth").alias("top"), F.count(F.lit(1)).alias("n"))
    every = state.agg(F.count(F.lit(1)).alias("every")).scalar()
    facts = facts.select(F.struct(*_COMP).alias("comp"), "total", "top", "n", F.col("n").alias("rows"), every.alias("every"))
    keyed = state.withColumn("comp", F.struct(*_COMP))
    return spread_lookup(keyed, facts, "comp", weight="rows", total="every", spread_by="k1").drop("comp")


def _split(large: DataFrame, places: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split every component at its centroid: the new state, and the totals of the centroids."""
    heavy = F.struct("weight", "depth", "conv", *_KEY)
    cents = large.where(F.col("weight") * 2 >= F.col("total")).groupBy(*_COMP).agg(F.min(heavy).alias("cent"), F.first("n").alias("n"), F.first("top").alias("top"))
    cents = materialise(cents, "centroids")
    every = cents.agg(F.sum("n").alias("every")).scalar()
    facts = cents.select(F.struct(*_COMP).alias("comp"), "cent", F.col("n").alias("rows"), every.alias("every"))
    keyed = large.withColumns({"comp": F.struct(*_COMP), "part": F.floor(F.col("depth") / BLOCK)})
    led = spread_lookup(keyed, facts, "comp", weight="rows", total="every", spread_by="k1").drop("comp")

    # below its centroid is a node whose first member passes through it; a member's nodes are asked for in parts
    asked = led.where("depth > cent.depth").select("conv", *_COMP, "part", "cent").distinct()
    steps = places.select("conv", F.col("depth").alias("step"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "u1", "u2")
    met = asked.withColumn("step", F.col("cent.depth") + 1).join(steps, ["conv", "step"]).where("u1 = cent.k1 AND u2 = cent.k2")
    sided = led.join(met.select("conv", *_COMP, "part", "n1", "n2"), ["conv", *_COMP, "part"], "left")
    is_cent = (F.col("k1") == F.col("cent.k1")) & (F.col("k2") == F.col("cent.k2"))
    sided = materialise(sided.withColumns({"is_cent": is_cent, "below": F.col("n1").isNotNull() & (F.col("depth") > F.col("cent.depth"))}), "sided")

    sums = sided.where("is_cent OR below").groupBy(*_COMP).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    spans = cents.join(sums, _COMP).withColumn("part", F.explode(F.sequence(F.floor(F.col("top") / BLOCK), F.floor(F.col("cent.depth") / BLOCK))))
    spans = spans.select(F.col("cent.conv").alias("conv"), "part", "top", F.col("cent.depth").alias("end"), F.col("cent.weight").alias("cut"), "t_leaf", "t_saved")
    path = places.withColumn("part", F.floor(F.col("depth") / BLOCK)).join(spans, ["conv", "part"]).where("depth BETWEEN top AND end")
    path = path.select(*_KEY, "cut", "t_leaf", "t_saved")
    zero = F.lit(0).cast("long")
    moved = sided.join(path, _KEY, "left").withColumns(
        {
            "add_leaf": F.col("add_leaf") + F.coalesce("t_leaf", zero),
            "add_saved": F.col("add_saved") + F.coalesce("t_saved", zero),
            "weight": F.when(F.col("is_cent"), F.col("weight")).otherwise(F.col("weight") - F.coalesce("cut", zero)),
            "c1": F.when(F.col("below"), F.col("n1")).otherwise(F.col("c1")),
            "c2": F.when(F.col("below"), F.col("n2")).otherwise(F.col("c2")),
        }
    )
    moved = materialise(moved.select(*columns, "is_cent"), "moved")
    done = moved.where("is_cent").select(*_KEY, F.col("add_leaf").alias("n_leaves"), F.col("add_saved").alias("saved_tokens"))
    return moved.where("NOT is_cent").select(*columns), done


def _finish(state: DataFrame) -> DataFrame:
    """Totals of all nodes of components of bounded weight, each within one task."""
    rows = state.repartition(*_COMP).sortWithinPartitions(*_COMP)
    return rows.mapInArrow(_finish_rows, "k1 long, k2 long, n_leaves long, saved_tokens long")


def _finish_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in keyed_runs(batches, _COMP):
        v = {c: rows.column(c).to_numpy() for c in (*_KEY, "weight", "leaf", "saved", "add_leaf", "add_saved")}
        sums = centroid_sums(_parents(rows), v["weight"], np.stack([v["leaf"], v["saved"]], axis=1), np.stack([v["add_leaf"], v["add_saved"]], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v["k1"], v["k2"], sums[:, 0], sums[:, 1])], [*_KEY, "n_leaves", "saved_tokens"])


def _parents(rows: pa.Table) -> np.ndarray:
    """For each node the place of its parent among ``rows``; -1 for the top of a component."""
    k1, k2, c1, c2 = (rows.column(c).to_numpy() for c in (*_KEY, *_COMP))
    top = (k1 == c1) & (k2 == c2)
    u1, u2 = (np.where(top, k, rows.column(u).fill_null(0).to_numpy()) for k, u in ((k1, "u1"), (k2, "u2")))
    order = np.lexsort((k2, k1))
    at = np.searchsorted(k1[order], u1)
    while True:  # keys that share their first half lie next to each other
        wrong = k2[order][at] != u2
        if not wrong.any():
            return np.where(top, -1, order[at])
        at = at + wrong


def centroid_sums(parent: np.ndarray, weight: np.ndarray, own: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Subtree sums of ``own`` (plus ``added``, which stays with its node) by centroid decomposition of a forest.

    ``parent``: place of each node's parent, -1 at tops; ``weight``: any numbers of at least 1, summed up over subtrees.
    All components of one round are split at once.
    """
    parent, weight, out = parent.copy(), weight.copy(), added.copy()
    live = np.arange(len(parent))
    comp = _reach(parent, np.where(parent < 0, live, parent))
    while len(live):
        heavy = live[2 * weight[live] >= weight[comp[live]]]
        order = heavy[np.lexsort((weight[heavy], comp[heavy]))]
        cent = order[np.concatenate(([True], comp[order][1:] != comp[order][:-1]))]
        of = np.full(len(parent), -1)
        of[comp[cent]] = cent
        mine = of[comp]  # the centroid of each node's component; only asked for live nodes
        stop = (parent < 0) | (parent == mine) | (np.arange(len(parent)) == mine)
        end = _reach(parent, np.where(stop, np.arange(len(parent)), parent))
        below = np.zeros(len(parent), bool)
        below[live] = parent[end[live]] == mine[live]
        is_cent = np.zeros(len(parent), bool)
        is_cent[cent] = True
        total = np.zeros_like(own)
        part = live[below[live] | is_cent[live]]
        np.add.at(total, mine[part], own[part])
        step, source = parent[cent], cent
        while (up := step >= 0).any():  # from the centroids to the tops
            step, source = step[up], source[up]
            out[step] += total[source]
            weight[step] -= weight[source]
            step = parent[step]
        out[cent] += total[cent]
        comp = np.where(below, end, comp)
        parent[parent == mine] = -1
        live = live[~is_cent[live]]
    return out


def _reach(parent: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Where the jumps lead in the end, by doubling; ends jump to themselves."""
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def _end_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from rows sorted by node and chunk; a node with many members is read as a stream."""
    key, digest, done = None, None, []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([k[j] for k, _ in done], pa.int64()) for j in range(2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done])], [*_KEY, "ends_sha256"])

    for batch in batches:
        for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        if len(done) > BLOCK:
            yield flush()
            done = []
    if key is not None:
        done.append((key, digest.hexdigest()))
        yield flush()


def end_digests(places: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end.

    SHA-256 has to read the ids of a node in order, so one task hashes them; it gets them joined in chunks of up to ``BLOCK`` ids.
    """
    ends = places.where("depth = len").groupBy(*_KEY, F.floor(F.col("conv") / BLOCK).alias("chunk"))
    joined = ends.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    rows = joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")
    return rows.select(*_KEY, "ids").mapInArrow(_end_digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per distinct prefix.

    Reads conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn, null first; among equal turns by a hash
    of role and text, so the result doesn't depend on the order of rows, and a repeated row is a turn of its own. Null roles and texts are
    empty. Rows with a null conv_id belong to no conversation and take no part. The root (depth 0) holds all conversations, those without
    turns included; an empty table gives an empty result. ``bound`` changes where components are finished, not the result.
    """
    places = positions(conversations)
    nodes = materialise(trie_nodes(places), "trie")
    sums = roll_up(nodes, places, bound)
    ends = end_digests(places)
    out = nodes.join(sums, _KEY).join(ends, _KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
