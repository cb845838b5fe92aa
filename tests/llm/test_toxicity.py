"""Toxicity scores against a loop over n-grams, the gradient against differences, and accuracy on held-out ids."""

import random
import zlib

import numpy as np
import pytest

from pairsift.llm import toxicity

BAD = ("idiot", "worthless", "pathetic", "scoundrel")


def corpus(n=600, seed=3):
    r = random.Random(seed)
    common = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(common) for _ in range(r.randint(20, 300))]
        toxic = int(k % 4 == 0)
        for j in range(len(words)):
            if toxic and r.random() < 0.03 or toxic and j == 5:
                words[j] = r.choice(BAD)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return rows, labels, common


def loop_features(text):
    """Buckets of all features of one text, one by one, through the one-n-gram path of the module."""
    low = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in text.lower())
    grams = []
    for word in low.split():
        marked = f" {word} "
        grams += [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        grams.append(word)
    return grams


def test_features_are_all_grams_and_words():
    texts = ["Hello, you IDIOT!", "", "a", "é日本語 x--y", "  two  words "]
    cps, at = toxicity.code_points(texts)
    found = list(toxicity.features(cps))
    sizes = [*toxicity.GRAMS, None]
    got = []
    for n, (place, _) in zip(sizes, found, strict=True):
        for i in place:
            end = i + n if n else next(j for j in range(i, len(cps)) if cps[j] == 32)
            got.append("".join(map(chr, cps[i:end])))
    assert sorted(got) == sorted(g for t in texts for g in loop_features(t))
    assert [chr(c) for c in cps[at[:2]]] == ["h", " "]


def test_scores_equal_a_loop_over_documents(monkeypatch):
    r = np.random.default_rng(1)
    gains, bias = r.normal(size=toxicity.BUCKETS), -0.4
    texts = ["You idiot, you", "", " .! ", "a", "word " * 500 + "é日本語", "x"]
    want = []
    for t in texts:
        b, share = toxicity.bag(t)
        want.append(bias + float(gains[b] @ share))
    raw = [t.encode() for t in texts]
    assert np.allclose(toxicity.log_odds(raw, gains, bias), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "pieces", lambda t: [t[:1000], t[1000:]] if len(t) > 2000 else [t])
    assert np.allclose(toxicity.log_odds(raw, gains, bias), want, atol=1e-5)  # the cut lies at a blank


def test_gradient_equals_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "RARE", 2)
    bags = [toxicity.bag(t) for t in ("you idiot", "you there", "idiot there you", "there")]
    model = toxicity.SubwordSoftmax(bags)
    y, w, rows = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 1.5, 1.0]), np.arange(4)
    _, g = model.gradient(rows, y, w, 1e-3)
    for name, at in (("E", (1, 2)), ("W", (0, 1)), ("b", (1,))):
        shift = 1e-6
        model.p[name][at] += shift
        up = model.gradient(rows, y, w, 1e-3)[0]
        model.p[name][at] -= 2 * shift
        down = model.gradient(rows, y, w, 1e-3)[0]
        model.p[name][at] += shift
        assert g[name][at] == pytest.approx((up - down) / 2 / shift, rel=1e-3, abs=1e-7)


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows, labels, common = corpus()
    r = random.Random(9)
    clean = [" ".join(r.choice(common) for _ in range(60)) for _ in range(40)]
    wrong = {5: "idiott", 15: "worthles", 25: "patthetic", 35: "scoundrell"}
    misspelt = [" ".join(wrong.get(i, r.choice(common)) for i in range(60)) for _ in range(40)]
    extra = [(10_000 + k, t) for k, t in enumerate([*clean, *misspelt])]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity_scores(docs, marks).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(held)) for k in truth)
    assert np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.95
    assert np.mean([got[10_000 + k]["predicted"] for k in range(40)]) < 0.05
    assert np.mean([got[10_040 + k]["predicted"] for k in range(40)]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())


def test_labels_of_held_out_ids_are_never_learnt(spark):
    rows, labels, _ = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels]
    scores = [
        sorted((x["doc_id"], x["score"]) for x in toxicity.toxicity_scores(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect())
        for m in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_edge_cases(spark, edge_docs, no_docs):
    shape = "doc_id long, quality int, toxic int, text string, score double"
    labels = spark.createDataFrame([(k, 1, int(k == 13), "x", 0.5) for k in range(1, 15)] + [(None, 1, 1, "x", 0.0), (7, None, None, None, None), (7, 1, 1, "", 0.0)], shape)
    got = toxicity.toxicity_scores(edge_docs, labels).collect()
    assert len(got) == edge_docs.count()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2] and scores[4] == scores[5] == scores[6]
    assert all(r["score"] == 0.5 for r in toxicity.toxicity_scores(edge_docs, labels.where("false")).collect())
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    ones = toxicity.toxicity_scores(edge_docs, labels.where("toxic = 1")).collect()
    assert len(ones) == len(got) and all(np.isfinite(r["score"]) for r in ones)
