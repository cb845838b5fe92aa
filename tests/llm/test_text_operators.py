"""Text operators against brute force, on edge cases and on whole small tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pairsift.llm import common, mixing, ngram_join, quality, sentencepiece_scan, suffix_dedup, token_counts, words
from pairsift.llm.deep_shallow import common_prefix, deep_shallow_order
from pairsift.llm.settings import tokenizer_file

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_groups(rows, width, num, den):
    """Per row (doc_id, set size, smallest reachable id) by comparing all pairs of distinct sets."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((d, len(s), min(least[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def groups(docs, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_groups(docs, **how).collect()), key=repr)


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 4, 5)])
def test_ngram_groups_equal_brute_force(spark, edge_docs, width, num, den):
    r = random.Random(width)
    near = []
    for g in range(12):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([4, 12, 40, 90]))]
        for _ in range(6):
            copy = [w if r.random() > 0.02 else "changed" for w in words]
            near.append((100 + len(near), " ".join(copy)))
    docs = edge_docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(i, t, "x") for i, t in near], "doc_id long, text string, n string"))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert groups(docs, width=width, num=num, den=den) == brute_groups(rows, width, num, den)


def test_ngram_groups_in_small_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 59 - k % 2] + [f"x{k}"])) for k in range(40)], "doc_id long, text string")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert groups(docs, width=3, num=90, den=100) == brute_groups(rows, 3, 90, 100)
    keys = {k for s in [np.sort(np.array([5, 9, 12], np.uint64))] for k in ngram_join.tile_keys(s, ngram_join.Bands(9, 10)).tolist()}
    assert len(keys) == 2  # both families of bands, one part each


def test_tiles_of_several_blocks_keep_an_anchor(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 8 + [8, 9, 9]), pa.array([*range(8), 1, 4, 4])], ["key", "cls"])
    out = [r for b in ngram_join._tile_rows(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()]
    assert {r["tile"] for r in out} == {7}
    assert {r["cls"] for r in out} == set(range(8))
    assert {r["block"] for r in out if r["cls"] == 0} == {r["block"] for r in out}


def test_near_copies_leave_one_of_each_group(edge_docs, no_docs):
    kept = ngram_join.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 12, 13, 14]
    assert ids.count(None) == 2
    assert ngram_join.drop_near_copies(no_docs).count() == 0


def test_near_copies_with_one_id_and_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (2, c), (3, c + " end"), (3, c), (4, ""), (4, " "), (4, ""), (None, a)]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c), (4, ""), (4, " "), (None, a)], key=repr)


def brute_removal(rows, length):
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for doc, t in rows:
        spans = suffix_dedup.merged([(k, k + length) for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1])
        out.append((doc, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(suffix_dedup.cut(t, spans)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,crowd", [(400, 20_000), (60, 2)])
def test_removal_equals_brute_force(edge_docs, length, crowd):
    docs = edge_docs.where("doc_id IS NULL OR doc_id NOT IN (9, 10)")
    rows = [(x["doc_id"], (x["text"] or "").encode()) for x in docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.removal_report(docs, length, crowd).collect()), key=repr)
    assert got == brute_removal(rows, length)


def rows_without_spark(texts, length):
    """The steps of ``covered`` on one task's batches, with the rows that reach the report."""
    gram = length // 4
    ids = range(len(texts))
    batch = pa.RecordBatch.from_pydict({"c1": pa.array(ids, pa.int64()), "c2": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    anchors = pa.Table.from_batches(list(suffix_dedup._anchor_rows(length, gram)([batch])))
    ordered = anchors.sort_by([(k, "ascending") for k in ("g", "c1", "c2", "place")]).combine_chunks().to_batches(max_chunksize=3)
    per_text = defaultdict(list)
    for part in suffix_dedup._repeated_rows(20_000)(ordered):
        for a in part.to_pylist():
            per_text[a["c1"]].append(a)
    joined = pa.RecordBatch.from_pylist([{"c1": i, "c2": i, "text": texts[i], "anchors": per_text[i]} for i in per_text])
    contexts = pa.Table.from_batches(list(suffix_dedup._context_rows(length)([joined])))
    one_each = list({(c["g"], c["c1"], c["place"]): c for c in contexts.to_pylist()}.values())
    sorted_rows = pa.RecordBatch.from_pylist(sorted(one_each, key=lambda c: c["g"]), contexts.schema)
    spans = defaultdict(list)
    for part in suffix_dedup._cover_rows(length)([sorted_rows]):
        for c in part.to_pylist():
            spans[c["c1"]].append((c["start"], c["stop"]))
    return [suffix_dedup.merged(spans[i]) for i in ids]


def test_each_repeated_anchor_is_given_once_over_batches():
    r = random.Random(4)
    for size, crowd in ((1, 3), (3, 3), (7, 4), (20, 6), (1000, 6)):
        rows = sorted({(r.choice([1, 2, 2, 2, 3, 4, 4, 5, 6, 7 + r.randint(0, 40)]), r.randint(0, 9), 0, r.randint(0, 9)) for _ in range(300)})
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
        table = pa.Table.from_arrays([*columns, pa.array([0] * len(rows)), pa.array([0] * len(rows))], ["g", "c1", "c2", "place", "first", "last"])
        got = [a for part in suffix_dedup._repeated_rows(crowd)(table.to_batches(max_chunksize=size)) for a in part.to_pylist()]
        times = Counter(g for g, *_ in rows)
        want = [(*x, times[x[0]] > crowd) for x in rows if times[x[0]] > 1]
        assert sorted((a["g"], a["c1"], a["c2"], a["place"], a["crowded"]) for a in got) == want


def test_crowded_grams_over_small_batches(spark):
    r = random.Random(8)
    hot = ["".join(r.choice("abcdef") for _ in range(120)) for _ in range(3)]
    texts = ["".join(r.choice("ghijkl") for _ in range(r.randint(5, 60))) + r.choice(hot)[r.randint(0, 30) :] + str(k) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        got = sorted((tuple(x) for x in suffix_dedup.removal_report(docs, 60, 15).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_removal([(k, t.encode()) for k, t in enumerate(texts)], 60)


def test_repeats_at_chunk_boundaries(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    r, length, lost, split = random.Random(11), 80, 0, 0
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    for offset in range(-150, 60, 14):  # a passage that starts shortly before or behind byte k * 1000
        passages = [word(r.randint(length, 140)) for _ in range(4)]
        whole = word(1000 + offset)
        for p in passages[1:]:
            whole += p
            whole += word(-(len(whole) - offset) % 1000)
        texts = [word(1000 + offset) + passages[0] + word(900), whole, *[word(30) + p + word(30) for p in passages]]
        seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        brute = [suffix_dedup.merged([(k, k + length) for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1]) for t in texts]
        lost += rows_without_spark(texts, length) != brute
        for t in texts:  # each window has one anchor, and one place is one row
            _, place, first, last = (np.concatenate(x) for x in zip(*suffix_dedup.window_anchors(t.encode(), length, length // 4), strict=True))
            split += len(set(place)) < len(place) or (first[1:] != last[:-1] + 1).any() or last[-1] != len(t) - length
    assert (lost, split) == (0, 0)


def test_removal_of_overlapping_partial_matches(spark):
    r = random.Random(5)
    a, b, c = ("".join(r.choice("abcdef") for _ in range(90)) for _ in range(3))
    texts = [a + b + c, "zz" + a + b[:50], b[20:] + c + "q", a[50:] + b[:30] + "y" * 20, c + c]
    rows = list(enumerate(t.encode() for t in texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (20_000, 1):
        assert sorted((tuple(x) for x in suffix_dedup.removal_report(docs, 80, crowd).collect()), key=repr) == brute_removal(rows, 80)


def test_repeats_are_cut_from_texts(edge_docs, no_docs):
    kept = suffix_dedup.remove_repeats(edge_docs, 256)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in kept.where("doc_id IS NOT NULL").collect()}
    assert texts[1] == "" and texts[3] == " tail"[len(" tail") - len(texts[3]) :] and texts[4] is None and texts[7] == "one"
    assert suffix_dedup.remove_repeats(no_docs, 256).count() == suffix_dedup.removal_report(no_docs).count() == 0


def test_repeats_of_many_short_words(spark, monkeypatch):
    r, length, least = random.Random(2), 256, 50
    say = lambda n, long: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, long))) for _ in range(n))
    a, b, c, d = say(51, 4), say(50, 2), say(49, 3), say(60, 9)
    assert len(a) < length and len(b) < length and len(c) < length
    texts = [say(30, 6) + " " + a + "\n" + say(9, 5), "\t" + a + "  " + say(7, 7), b + "  ", say(80, 3) + " " + b, c, "x " + c, d + " é", d, " " + b + " \n", " " + b + " \n"]
    texts += [say(20, 8) + " " + a + "z " + a[:150], None, c, c, "one two", "日 " * 70, a.replace(" ", "  "), (say(4, 1) + " ") * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = [(t or "").encode() for t in texts]
    runs = []
    for t in rows:
        at = [m.span() for m in WORD.finditer(t)]
        runs.append([(k, k + length) for k in range(len(t) - length + 1)] + [(at[k][0], at[k + least - 1][1]) for k in range(len(at) - least + 1)])
    seen = Counter(t[x:y] for t, spans in zip(rows, runs, strict=True) for x, y in spans)
    want = {i: suffix_dedup.cut(t, suffix_dedup.merged([(x, y) for x, y in set(s) if seen[t[x:y]] > 1])).decode() for i, (t, s) in enumerate(zip(rows, runs, strict=True))}
    got = {x["doc_id"]: x["text"] or "" for x in suffix_dedup.remove_repeats(docs, length, words=least).collect()}
    assert got == want and a not in got[0] and a not in got[1] and b not in got[3]
    assert got[4] == c and got[12] == c  # 49 words of under 256 bytes stay
    text = " ".join(say(400, 4).split()).encode()
    plain = list(suffix_dedup.short_runs(text, length, least))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 70)
    assert plain and list(suffix_dedup.short_runs(text, length, least)) == plain


def test_pipeline_cuts_passages_of_short_words(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    assert len(passage) < 256 and len(passage.split()) == 51
    docs = spark.createDataFrame([(1, "first head " + passage + " one tail"), (2, "other start " + passage + " two ends")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    assert kept == {1: "first head  one tail", 2: "other start  two ends"}


def test_deep_shallow_sorts():
    r = random.Random(3)
    for _ in range(30):
        stem = bytes(r.choices(b"ab", k=r.randint(0, 150)))
        strings = [stem[: r.randint(0, len(stem))] + bytes(r.choices(b"ab\x00\xff", k=r.randint(0, 40))) for _ in range(r.randint(1, 80))]
        assert [strings[i] for i in deep_shallow_order(strings)] == sorted(strings)
        for x, y in pairwise(strings):
            n = common_prefix(x, y)
            assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_token_counts_equal_the_library(edge_docs, no_docs):
    path = tokenizer_file("byte_bpe_50k.json")
    r = random.Random(2)
    odd = ["a  b", "a   b", "\n  b", "x \n b", " <|endoftext|> x<|endoftext|>  y", "don't  I'll ''s", "a\x1c b", "a\u0085  b", "a　 b", "x'S ¹²"]
    odd += ["".join(r.choice(" ab\n\té日.' 　\x1c1s<|") for _ in range(60)) for _ in range(400)]
    spark = edge_docs.sparkSession
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = sorted(((d, len((t or "").encode()), len(token_counts.tokenizer(path).encode(t or "", add_special_tokens=False).ids)) for d, t in docs.collect()), key=repr)
    got = token_counts.token_counts(docs, path).collect()
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got), key=repr) == want
    assert all(x["over_limit"] == (x["n_tokens"] > 512) for x in got)
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_quality_learns_from_training_labels_only(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in quality.quality_scores(docs, labels, sample=1500).collect()}
    held = [(scored[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    right = sum((s >= 0.5) == (q == 1) for s, q in held) / len(held)
    assert len(held) > 1000 and right > 0.97
    empty = labels.where("false")
    assert {r["score"] for r in quality.quality_scores(edge_docs, empty).collect()} == {0.5}
    again = quality.keep_good(edge_docs, labels)
    assert again.columns == edge_docs.columns and quality.quality_scores(no_docs, labels).count() == 0


def test_attention_gradient_equals_differences():
    r = np.random.default_rng(0)
    x, at, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.AttentionModel(hidden=4, gate=3)

    def loss():
        s = m.forward(x, at)[0]
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    for k, g in m.gradient(x, at, y, 0.0).items():
        flat = m.p[k].reshape(-1)
        old = flat[0]
        flat[0] = old + 1e-6
        up = loss()
        flat[0] = old - 1e-6
        down = loss()
        flat[0] = old
        assert abs((up - down) / 2e-6 - g.reshape(-1)[0]) < 1e-5


def test_mixture_follows_the_weights(spark, edge_docs, no_docs):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' END AS source")
    mixed = mixing.mix_sources(docs, {"a": 0.2, "b": 0.5}, seed=3)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["a"] / 4000 - 1) < 0.05 and abs(n["b"] / 10_000 - 1) < 0.05 and abs(n[None] / 6000 - 1) < 0.05
    keys = [r["mix_key"] for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys)
    big = mixing.mix_sources(docs.where("doc_id < 100"), {"a": 0.0, "b": 1.0}, seed=3)
    assert {r["source"] for r in big.select("source").distinct().collect()} == {"b"}
    far = mixing.source_rates(spark.createDataFrame([("x" * 10, "a"), ("y" * 100_000, "b")], "text string, source string"), {"a": 0.5}).collect()
    assert max(r["parts"] for r in far) > 100
    assert mixing.mix_sources(no_docs, {"s1": 0.5}).count() == 0
    edges = mixing.mix_sources(edge_docs, {"s1": 0.5})
    assert set(edges.columns) == {*edge_docs.columns, "mix_key"} and edges.count() >= 0


@pytest.fixture(scope="module")
def unigram_proto():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    return proto.SerializeToString()


def chunked(pieces, text, size):
    """The scan of one text, chunk by chunk, as the tasks do it."""
    import pyarrow as pa

    whole, chunks = sentencepiece_scan.text_body(text), []
    for start in range(0, len(whole) - 1, size):
        n = min(size, len(whole) - 1 - start)
        cut = sentencepiece_scan._CUT.search(whole, start + 1 + n)
        stop = start + 1 + n + pieces.longest if pieces.unigram else cut.end() if cut else len(whole)
        chunks.append((whole[start : stop + 1], n))
    states = sentencepiece_scan.best_states([pieces.matrix(b, n) for b, n in chunks])
    assert pa  # the same code runs in Arrow batches
    return np.frombuffer(b"".join(pieces.trace(b, e, n, x) for (b, n), (e, x) in zip(chunks, states)), np.int32).tolist()


TEXTS = ["", " ", "a", "a ", " a", "a  b", "▁", "▁ a", " ▁b", "\n", "a\n b", "日本語 é", "<s> </s>", "x" * 90, "Thth is ershha erreth. Lyhe on  the"]


def test_bpe_scan_equals_the_library():
    p = sentencepiece_scan.Pieces(tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(1)
    for t in TEXTS + ["".join(r.choice(" ab\n▁é日.") for _ in range(r.randint(1, 60))) for _ in range(200)]:
        want = p.model.encode(t)
        assert np.frombuffer(p.ids(t), np.int32).tolist() == want
        assert p.text(p.ids(t)) == p.model.decode(want)
        assert not t or all(chunked(p, t, n) == want for n in (1, 3, 7))


def test_a_task_decodes_and_digests_in_one_worker(edge_docs):
    path = tokenizer_file("piece_bpe_32k.model")
    plan = sentencepiece_scan.piece_report(edge_docs.where("length(text) < 1000"), path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # once for the small texts and once for the giant ones
    assert plan.count("MapInArrow") == 4  # encoding of small texts; matrices, states and traces of giant ones
    nothing = edge_docs.selectExpr("CAST(NULL AS ARRAY<INT>) AS ids").limit(1)
    assert sentencepiece_scan.decode_pieces(nothing, path).first()["decoded"] is None


def test_remembered_units_are_few_and_their_runs_right(monkeypatch):
    assert sentencepiece_scan.CACHE_LIMIT <= 200_000  # each worker of an executor may hold so many
    monkeypatch.setattr(sentencepiece_scan, "CACHE_LIMIT", 40)
    p = sentencepiece_scan.Pieces(tokenizer_file("piece_bpe_32k.model"))
    encoded, asked = p.units._encoded, []
    monkeypatch.setattr(p.units, "_encoded", lambda units, joined: asked.extend(units) or encoded(units, joined))
    r = random.Random(8)
    for k in range(30):
        texts = [f"often again new{k}x{k}", "".join(r.choice(" ab\n▁é日\0.") for _ in range(30)), *TEXTS[k % 3 :: 3]]
        assert [np.frombuffer(x, np.int32).tolist() for x in p.ids_of(texts)] == [p.model.encode(t) for t in texts]
        assert len(p.units.known) + len(p.units.older) <= 100
    assert asked.count("often") == asked.count("again") == 1


def test_chunks_within_one_unit_carry_no_text():
    p = sentencepiece_scan.Pieces(tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(6)
    giants = ["".join(r.choice("abcXYZ019+/") for _ in range(5000)), "日本語" * 900, "a b " + "q" * 3000 + "  c d", "q" * 3000 + " " + "z" * 999, "▁" * 500 + "x" * 700]
    for t in giants + [x for x in TEXTS if x]:
        for size in (1, 7, 100):
            batch = pa.RecordBatch.from_pydict({"c1": pa.array([1], pa.int64()), "c2": pa.array([2], pa.int64()), "text": [t]})
            chunks = next(sentencepiece_scan._chunk_rows(tokenizer_file("piece_bpe_32k.model"), False, size)([batch]))
            assert sum(len(b or "") for b in chunks.column("body").to_pylist()) <= 2 * len(t) + 4 * chunks.num_rows
            (matrices,) = sentencepiece_scan._matrix_rows(tokenizer_file("piece_bpe_32k.model"), False)([chunks])
            states = sentencepiece_scan.best_states([{(m["e"], m["x"]): m["s"] for m in ms} for ms in matrices.column("matrix").to_pylist()])
            traced = chunks.append_column("entry", pa.array([e for e, _ in states], pa.int32())).append_column("leave", pa.array([x for _, x in states], pa.int32()))
            (ids,) = sentencepiece_scan._trace_rows(tokenizer_file("piece_bpe_32k.model"), False)([traced])
            assert sum(ids.column("ids").to_pylist(), []) == p.model.encode(t)


def test_unigram_scan_reaches_the_library_score(unigram_proto):
    p = sentencepiece_scan.Pieces(model_proto=unigram_proto, unigram=True)
    for t in [x for x in TEXTS if x and not re.search("[^a-zA-Z ▁.]", x)]:
        want = p.scores[p.model.encode(t)].sum()
        for got in (np.frombuffer(p.ids(t), np.int32), np.array(chunked(p, t, 5)), np.array(chunked(p, t, 16))):
            assert abs(p.scores[got].sum() - want) < 1e-3


def test_max_plus_product_is_associative():
    r = random.Random(4)
    ms = [{(i, j): float(r.randint(-9, 0)) for i in range(3) for j in range(3) if r.random() < 0.8} for _ in range(7)]
    left = ms[0]
    for k, m in enumerate(ms[1:], 1):
        left = sentencepiece_scan.combine(left, m)
        assert left == sentencepiece_scan.prefix_products(ms)[k]


def test_pieces_of_giant_documents(edge_docs, no_docs):
    path = tokenizer_file("piece_bpe_32k.model")
    p = sentencepiece_scan.Pieces(path)
    out = sentencepiece_scan.encode_pieces(edge_docs, path, chunk=1000)
    assert out.columns == [*[c for c in edge_docs.columns if c != "ids"], "ids"]
    rows = out.select("text", "ids").collect()
    assert len(rows) == edge_docs.count() and all(r["ids"] == p.model.encode(r["text"] or "") for r in rows)
    report = sentencepiece_scan.piece_report(edge_docs, path, chunk=1000)
    assert all(r["round_trip"] for r in report.collect())
    assert sentencepiece_scan.piece_report(no_docs, path).count() == 0


def test_pipeline_rows_equal_a_brute_force_chain(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(51))
    near = " ".join(f"near{k} copy{k % 9}" for k in range(120))
    more = [(-1, near), (-2, near + " end"), (-3, "alone " + passage + " here"), (-4, "elsewhere ▁ " + passage + " é日本 there"), (-5, None), (-6, "")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(60).collect()
    names = docs.columns
    filled = [tuple({**first[0].asDict(), "doc_id": i, "text": t}[c] for c in names) for i, t in more]
    docs = spark.createDataFrame([tuple(r) for r in first] + filled, docs.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    good = corpus_pipeline.reject_low_quality(spark, docs, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"]) for r in good]
    least = {d: c for d, _, c in brute_groups(rows, 5, 4, 5)}
    rows = [(d, t) for d, t in rows if least[d] == d]
    texts, runs = [(t or "").encode() for _, t in rows], []
    for t in texts:
        at = [m.span() for m in WORD.finditer(t)]
        runs.append({*((k, k + 256) for k in range(len(t) - 255)), *((at[k][0], at[k + 49][1]) for k in range(len(at) - 49))})
    seen = Counter(t[x:y] for t, spans in zip(texts, runs, strict=True) for x, y in spans)
    cut = {d: suffix_dedup.cut(t, suffix_dedup.merged([s for s in spans if seen[t[s[0] : s[1]]] > 1])).decode(errors="ignore") for (d, _), t, spans in zip(rows, texts, runs, strict=True)}
    whole = {r["doc_id"]: r for r in good}
    kept = [tuple({**whole[d].asDict(), "text": cut[d] if t is not None else None}[c] for c in names) for d, t in rows]
    mixed = corpus_pipeline.mix_to_weights(spark, spark.createDataFrame(kept, docs.schema), SF).collect()
    p = sentencepiece_scan.Pieces(tokenizer_file("piece_bpe_32k.model")).model
    want = []
    for r in mixed:
        ids = p.encode(r["text"] or "")
        want.append((r["doc_id"], r["source"], ids, len(ids), p.decode(ids) == (r["text"] or "").replace("▁", " ")))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "ids", "n_pieces", "round_trip"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(want, key=repr) and all(r[4] for r in got)


def test_columns_with_internal_names_pass_unchanged(spark):
    names = "_score _n _own _bucket _parts _upto _c1 _c2 _spans _t _t2 _h _row copy_ c1 c2 g place k n".split()
    text = "many words that come back in another document of this small table " * 12
    rows = [(i, f"{text if i < 2 else ''} own {i}", "en", "src0", 3, *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    same = lambda df: {tuple(r[c] for c in names) for r in df.collect()}
    want = same(docs)
    assert same(quality.keep_good(docs, labels, least=0.0)) == want
    assert same(suffix_dedup.remove_repeats(docs, 100, words=20)) == want
    assert same(ngram_join.drop_near_copies(docs, 5, 4, 5)) <= want
    assert same(mixing.mix_sources(docs, {"src0": 1.0}, 1)) <= want
    assert suffix_dedup.remove_repeats(docs, 100).columns == docs.columns


def test_workers_hold_a_run_of_texts_and_small_tables(monkeypatch):
    texts = pa.array([None, "", *[chr(97 + k % 26) * 4000 for k in range(4000)], "é"])
    want = [(t or "").encode() for t in texts.to_pylist()]
    tracemalloc.start()
    try:
        for first, part in common.text_slices(texts):
            assert part == want[first : first + len(part)]
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x for _, part in common.text_slices(texts) for x in part] == want
    assert held < 6 << 20  # of 16 MB
    monkeypatch.setattr(words, "_held", words.powers(0), raising=False)
    words.shingle_sets([b"one two three " * 20], 5)
    assert sum(x.nbytes for x in words._tables(1000)) <= 8 << 20
    few = words.shingle_sets([b" ".join(b"w%d" % (k * k % 9973) for k in range(200_000))], 5)  # over a million bytes: the table grows
    assert len(few[0]) > 5000 and len(words._tables(1)[0]) > 1 << 19


def test_small_slices_give_the_same_pairs_and_texts():
    assert [x.num_rows for x in common.few_rows([pa.RecordBatch.from_pydict({"a": list(range(600))})])] == [256, 256, 88]
    text = lambda k: " ".join(f"w{k * j % 211}" for j in range(90 + k % 3)).encode()
    rows = {"a": list(range(700)), "b": [k + 1 for k in range(700)], "left": [zlib.compress(text(k)) for k in range(700)], "right": [zlib.compress(text(k + 1 if k % 2 else k)) for k in range(700)]}
    got = [a for part in ngram_join._verified_rows(3, 4, 5)([pa.RecordBatch.from_pydict({**rows, "b": [-k - 1 for k in range(700)]})]) for a in part.column("a").to_pylist()]
    sets = [(shingles(text(k).decode(), 3), shingles(text(k + 1 if k % 2 else k).decode(), 3)) for k in range(700)]
    assert got == [k for k, (x, y) in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)]


def test_packed_texts_come_back(spark):
    texts = [None, "", "é日本語 " * 80, "plain", "plain", "x" * 100_000]
    sizes = [len((t or "").encode()) for t in texts]
    batch = pa.RecordBatch.from_pydict({"k": [0, 1, 2, 3, 3, 4], "text": pa.array(texts, pa.string()), "size": pa.array(sizes, pa.int32())})
    back = common.with_texts(lambda batches: batches)
    whole = [x for part in back(common.packed_texts()([batch, batch])) for x in part.to_pylist()]
    assert [x["text"] for x in whole] == [(t or "").encode() for t in texts] * 2
    once = [x for part in back(common.packed_texts(["k"])([batch, batch])) for x in part.to_pylist()]
    assert [(x["k"], len(x["text"])) for x in once] == [(k, sizes[i]) for k, i in enumerate((0, 1, 2, 3, 5))]
    report = suffix_dedup.removal_report(spark.createDataFrame([(1, "some text " * 90), (2, None)], "doc_id long, text string"))
    top = report._jdf.queryExecution().optimizedPlan()
    while top.nodeName() != "Join":
        top = top.children().head()
    assert top.children().head().schema().apply("text").dataType().simpleString() == "binary"  # no plain text is shuffled


def test_contexts_given_twice_are_no_repeats():
    r = random.Random(6)
    word = lambda n: bytes(r.choices(b"abcdefgh", k=n))
    hot = word(50)
    rows = [{"g": g, "c1": k, "c2": k, "place": 30 + g, "crowded": False, "left": word(30), "right": (hot if k % 3 else word(50)) + word(20)} for g in range(5) for k in range(40)]
    schema = pa.schema([("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("place", pa.int32()), ("crowded", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
    table = lambda x: pa.Table.from_pylist(x, schema).combine_chunks()
    found = lambda x, n: sorted((*c.values(),) for part in suffix_dedup._cover_rows(48)(table(x).to_batches(max_chunksize=n)) for c in part.to_pylist())
    want = found(rows, 1000)
    assert want and len(want) < len(rows)
    assert found([x for x in rows for _ in range(3)], 1000) == found([x for x in rows for _ in range(3)], 7) == want


def test_pipeline_stages_get_bounded_batches(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    monkeypatch.setattr(ngram_join, "drop_near_copies", lambda docs, **_: docs)
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda docs, **_: docs)
    docs = spark.createDataFrame([(1, "some text", "src0")], "doc_id long, text string, source string")
    try:
        for own, want in ((None, str(4 << 20)), ("65536", "65536")):
            for stage in (corpus_pipeline.one_of_near_copies, corpus_pipeline.cut_repeated_passages):
                spark.conf.unset(limit) if own is None else spark.conf.set(limit, own)
                stage(spark, docs, SF)
                assert spark.conf.get(limit, None) == want
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
