"""Token alignment against the libraries on whole texts and a scan over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairsift.llm import token_alignment
from pairsift.llm.settings import tokenizer_file

SF = "/root/testdata/sf0.001"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = (
    "", None, " ", "  ", "a ", "a  ", "  a", "one two", "tab\tand\nline \n end", "<|endoftext|> and <s> </s> <unk> <0x0A>", "▁ mark", "a▁b", "é日本語 ﬁ ① ™ 🙂 x", "don't  stop--now!!",
    "nul \x00 byte \x85 　 \xa0 blank", "x" * 5000, "日本語" * 700, "12 345 6.7e8", "a\r\n b\x1c c",
)


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    both = token_alignment.Aligner(A, B)
    per = []
    for t in texts:
        ids_a = both.a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = both.b.encode(t) if t else []
        a, b = [both.bytes_a[i] for i in ids_a], [both.bytes_b[i] for i in ids_b]
        if not t or not b"".join(a) == b"".join(b) == (" " + t).encode():
            per.append(None)
            continue
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, (start, end) in enumerate(a):
            while b[j][1] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][0] < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for _, e in a} & {e for _, e in b}):
            to_x, to_y = x, y
            while to_x < len(a) and a[to_x][1] <= end:
                to_x += 1
            while to_y < len(b) and b[to_y][1] <= end:
                to_y += 1
            groups.append(",".join(map(str, ids_a[x:to_x])) + "|" + ",".join(map(str, ids_b[y:to_y])))
            x, y = to_x, to_y
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    docs = Counter(pair for p in per if p for pair in set(p[3]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [
        (p[0], p[1], p[2], len(p[3]), sum(docs[q] == most[q[0]] for q in p[3]), sum(docs[q] for q in p[3]), p[4]) if p else (0, 0, 0, 0, 0, 0, "")
        for p in per
    ]


def report(df, **how):
    return sorted((tuple(r) for r in token_alignment.align_tokenizers(df, A, B, **how).collect()), key=repr)


def expected(df):
    rows = df.collect()
    return sorted(((r["doc_id"], *p) for r, p in zip(rows, brute([r["text"] for r in rows]), strict=True)), key=repr)


def test_groups_and_links_of_ends():
    groups = token_alignment.common_groups([1, 3, 6, 8], [2, 3, 7, 8])
    assert groups == [(0, 2, 0, 2), (2, 4, 2, 4)]
    links = [token_alignment.links_of([10, 11, 12, 13], [1, 3, 6, 8], [20, 21, 22, 23], [2, 3, 7, 8], g) for g in groups]
    assert links == [[(10, 20), (11, 20), (11, 21)], [(12, 22), (13, 22), (13, 23)]]


@pytest.mark.parametrize("table", [0, 300, token_alignment.TABLE])
def test_alignment_equals_brute_force(spark, table):
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").unionByName(odd).repartition(3)
    docs = docs.unionByName(odd)  # repeated rows count again
    assert report(docs, table=table) == expected(docs)


def test_edge_documents(spark, edge_docs, no_docs):
    assert report(edge_docs, table=50) == expected(edge_docs)
    assert report(no_docs) == []


def test_units_forget_and_stay_right(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 3)
    both = token_alignment.Aligner(A, B)
    for text in ("one two three four five", "two six seven", "x" * 100 + " one"):
        units = both.units(text)
        n_a, n_b, *_ = both.document(units, both.learn(set(units)))
        assert (n_a, n_b) == (len(both.a.encode(" " + text, add_special_tokens=False).ids), len(both.b.encode(text)))


def test_without_cuts_texts_stay_whole():
    both = token_alignment.Aligner(A, B)
    cut = both.document(both.units("one two  three "), both.learn(set(both.units("one two  three "))))
    both.cuts = False
    units = both.units("one two  three ")
    assert units == ["one two  three "]
    whole = both.document(units, both.learn(set(units)))
    assert cut[:5] == whole[:5] and (cut[5] == whole[5]).all() and (cut[6] == whole[6]).all()


def test_runs_of_units_equal_units_alone():
    """Units aligned together, odd ones between, against each alone and the groups and links of a plain walk."""
    both = token_alignment.Aligner(A, B)
    units = sorted({u for t in ODD if t for u in both.units(t)} | {f"wörd{k}{k * k}x." for k in range(300)})
    found = both.learn(set(units))
    assert found["▁"] is None and sum(x is None for x in found.values()) < 9
    for u in units:
        assert [found[u]] == both.align([u])
        if found[u] is None:
            continue
        groups, n_a, n_b, n_groups, pairs = found[u]
        a, b = both.a.encode(" " + u, add_special_tokens=False).ids, both.b.encode(u) if u else [both.b.piece_to_id("▁")]
        ends_a, ends_b = [e for _, e in spans([both.bytes_a[i] for i in a])], [e for _, e in spans([both.bytes_b[i] for i in b])]
        walked = token_alignment.common_groups(ends_a, ends_b)
        links = [x << 32 | y for g in walked for x, y in token_alignment.links_of(a, ends_a, b, ends_b, g)]
        assert (n_a, n_b, n_groups, np.frombuffer(pairs, "<i8").tolist()) == (len(a), len(b), len(walked), links)
        assert groups == ";".join(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])) for i, j, k, m in walked)


def test_units_met_often_are_aligned_once(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 40)
    both = token_alignment.Aligner(A, B)
    align, asked = both.align, []
    monkeypatch.setattr(both, "align", lambda units, *how: asked.extend(units) or align(units, *how))
    for k in range(30):
        both.learn({"often", "again", *(f"new{k}of{i}" for i in range(10))})
        assert len(both.known) + len(both.older) <= 64
    assert asked.count("often") == asked.count("again") == 1 and len(asked) == 302
