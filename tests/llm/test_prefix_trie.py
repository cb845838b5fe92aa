"""The prefix trie against a dictionary of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pairsift.llm import prefix_trie
from pairsift.llm.queries import OP12_SQL

SF = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string, depth long, k1 long, n_convs string, conv string"


def rebuild(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    return out


def brute(rows):
    made = rebuild(rows)
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df, bound=prefix_trie.BOUND):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, bound).collect()), key=repr)


def made_up(seed, n=60, most=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 420), n):
        for t in range(r.choice([1, 2, 3, most])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["yes", "no", "a longer turn", "é日本語"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_centroid_sums_equal_sums_from_the_leaves(seed):
    r = np.random.default_rng(seed)
    for n in (1, 2, 3, 17, 300):
        for kind in range(4):
            parent = np.array([-1] + [(k - 1, 0, int(r.integers(max(0, k - 3), k)), int(r.integers(-1, k)))[kind] for k in range(1, n)])
            own, added, weight = r.integers(0, 9, (n, 2)), r.integers(0, 5, (n, 2)), np.ones(n, int)
            want = own.copy()
            for k in range(n - 1, 0, -1):
                if parent[k] >= 0:
                    weight[parent[k]] += weight[k]
                    want[parent[k]] += want[k]
            assert (prefix_trie.centroid_sums(parent, weight, own, added) == want + added).all()


def test_given_conversations_equal_brute_force_and_sql(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    got = trie(given)
    assert got == brute([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    names = [d[0] for d in con.execute(OP12_SQL).description]
    assert names == prefix_trie.prefix_trie(given).columns
    assert sorted((tuple(r) for r in con.fetchall()), key=repr) == got


@pytest.mark.parametrize("bound", [20])
def test_components_split_in_rounds_give_the_same(spark, bound, monkeypatch):
    rows = made_up(bound)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)  # many blocks in one conversation
    assert trie(df, bound) == brute(rows)


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(400)] + [(c, t, "user", f"turn {t % 7}") for c in (101, 102, 250) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    assert trie(df, 3000) == brute(rows)


def test_many_members_end_at_one_node(spark, monkeypatch):
    rows = [(c, 0, "user", "hello") for c in range(300)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    got = trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 5, "user", "x"), (1, 5, "user", "x"), (1, 3, "a", ""), (None, 0, "user", "lost"), (-7, 0, "user", "n"),
            (300, -4, "user", "w " * 50_000), (300, 2, None, "tail"), (301, 0, "user", "only"), (399, 0, "z", "last")]
    df = spark.createDataFrame([(*r, 9, 9, "n", "c") for r in rows], SHAPE)
    assert trie(df) == brute(rows)
    assert trie(df.where("false")) == []
