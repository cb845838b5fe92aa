"""BLEU and chrF against a plain-Python statement of the public definitions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairsift.operators import distill, examples, langid, metrics, qc


def grams(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def plain_bleu(pairs):
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        h, r = h.split(), r.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            a, b = grams(h, n), grams(r, n)
            total[n - 1] += sum(a.values())
            match[n - 1] += sum((a & b).values())
    if not any(match) or not all(total):
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log((m or 1 / smooth) / t)
    return 100 * min(1.0, math.exp(1 - ref_len / hyp_len)) * math.exp(logs / 4)


def plain_chrf(pairs):
    sums = [[0, 0, 0] for _ in range(6)]
    for h, r in pairs:
        h, r = "".join(h.split()), "".join(r.split())
        for n in range(1, 7):
            a, b = grams(h, n), grams(r, n)
            sums[n - 1][0] += sum(a.values()) if b else 0
            sums[n - 1][1] += sum(b.values())
            sums[n - 1][2] += sum((a & b).values())
    used = [s for s in sums if s[0] and s[1]]
    if not used:
        return 0.0
    p, r = (sum(s[2] / s[k] for s in used) / len(used) for k in (0, 1))
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(1)
    words = ["lo", "gat", "es", "negre", "e", "blanc", "òc", "日本"]
    rows = []
    for i in range(200):
        ref = [rnd.choice(words) for _ in range(rnd.randint(0, 12))]
        hyp = [w if rnd.random() < 0.7 else rnd.choice(words) for w in ref][: rnd.randint(0, 12)]
        rows.append((i, i % 2, " ".join(hyp), " ".join(ref)))
    return rows, spark.createDataFrame(rows, "pair_id long, system int, hyp string, gold string")


def test_metrics_equal_plain_python(pairs):
    rows, df = pairs
    got = {r.system: r for r in metrics.score_systems(df).collect()}
    for system in (0, 1):
        mine = [(h, r) for _, s, h, r in rows if s == system]
        assert abs(got[system].bleu - plain_bleu(mine)) < 1e-9
        assert abs(got[system].chrf - plain_chrf(mine)) < 1e-9


def test_ids_do_not_matter_and_nulls_are_empty(spark):
    rows = [("lo gat es negre e", "lo gat es blanc e"), ("lo lo gat es", "gat es lo lo negre"), (None, "lo gat"), ("e blanc", None), (None, None)]
    df = spark.createDataFrame([(7, 0, *r) for r in rows], "pair_id long, system int, hyp string, gold string")
    plain = [(h or "", r or "") for h, r in rows]
    got = metrics.score_systems(df).first()
    assert abs(got.bleu - plain_bleu(plain)) < 1e-9 and abs(got.chrf - plain_chrf(plain)) < 1e-9
    assert abs(metrics.corpus_bleu(df).first().bleu - got.bleu) < 1e-12
    assert got.hyp_len == 11 and got.ref_len == 12 and abs(got.precisions[0] - 100 * 8 / 11) < 1e-9
    empty = metrics.score_systems(df.where("hyp IS NULL")).first()
    assert (empty.bleu, empty.chrf, empty.hyp_len, empty.brevity_penalty) == (0.0, 0.0, 0, 0.0)


def test_identical_texts_score_100(spark):
    df = spark.createDataFrame([(1, "lo gat es negre .", "lo gat es negre .")], "pair_id long, hyp string, gold string")
    assert abs(metrics.corpus_bleu(df).first().bleu - 100) < 1e-9
    assert abs(metrics.corpus_chrf(df).first().chrf - 100) < 1e-9


def test_char_chunks_do_not_change_the_sums(pairs, monkeypatch):
    from pairsift.functions import char_ngrams

    _, df = pairs
    whole = metrics.corpus_chrf(df).first().chrf
    monkeypatch.setattr(char_ngrams, "CHUNK", 10)
    assert metrics.corpus_chrf(df).first().chrf == whole


def test_13a_tokens(spark):
    df = spark.createDataFrame([("Hello, world! 3.5 km-2 a-b &amp; (x) end.",)], "t string")
    assert df.select(metrics.tokenize_13a(F.col("t")).alias("o")).first().o == (
        "Hello , world ! 3.5 km-2 a-b & ( x ) end .".split()
    )


def test_accepted_and_rejected_cover_the_input(spark):
    rows = [(1, "Hi", "g", "oc: hi"), (2, "Hello all", "g", ""), (3, "Good day", "g", "Bon jorn"), (4, "in 2019", "g", "en 2020")]
    df = spark.createDataFrame(rows, "pair_id long, src string, gold string, raw string")
    good, bad = qc.qc_generations(df)
    assert [r.pair_id for r in good.collect()] == [3]
    assert {r.pair_id: r.reason for r in bad.collect()} == {
        1: "empty/source leak",
        2: "empty/source leak",
        4: "Number Mismatch",
    }


def test_teacher_confidence_golden(spark):
    rows = [("a", -1.0), ("a", -1.0), ("b", -5.0), ("c", None)]
    df = spark.createDataFrame(rows, "sent_id string, log_prob double")
    got = {r.sent_id: r.sent_weight for r in distill.teacher_confidence(df).collect()}
    assert round(got["a"], 6) == 0.268941 and got["b"] == 0.2 and got["c"] == 0.5


def test_log_prob_floor_and_mask(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 1000.0], 0), ([0.0, 0.0], -100)], "logits array<double>, gold int")
    got = [r.log_prob for r in distill.token_log_prob(df).collect()]
    assert abs(got[0] - math.log(0.5)) < 1e-12 and abs(got[1] - math.log(1e-8)) < 1e-9 and got[2] is None


def test_labels_and_padding(spark):
    from pairsift.functions import examples as ex

    ids = F.array(*[F.lit(i) for i in (7, 8, 9, 4, 5)])
    df = spark.range(1)
    assert df.select(ex.mask_labels(ids, F.lit(3)).alias("o")).first().o == [-100, -100, -100, 4, 5]
    long_ids = F.array_repeat(F.lit(1), 256)
    assert df.select(ex.mask_labels(long_ids, F.lit(300)).alias("o")).first().o == [-100] * 256
    rows = spark.createDataFrame([(0, [1] * 3, [1] * 3, [5] * 3), (1, [1] * 9, [1] * 9, [5] * 9)],
                                 "idx long, input_ids array<int>, attention_mask array<int>, labels array<int>")
    for side in ("left", "right"):
        out = {r.idx: r for r in examples.pad_batches(rows, side=side).collect()}
        assert len(out[0].input_ids) == len(out[1].labels) == 16
        filler = out[0].labels[:13] if side == "left" else out[0].labels[3:]
        assert set(filler) == {-100}


def test_later_label_wins_on_equal_names(spark):
    preds = spark.createDataFrame(
        [(1, "__label__oci_Latn", 0.5), (1, "__label__prv_Latn", 0.3), (1, "__label__eng_Latn", 0.04), (2, "__label__eng_Latn", 0.01)],
        "pair_id long, label string, prob double",
    )
    names = spark.createDataFrame([("oci", "Occitan"), ("prv", "Occitan"), ("eng", "English")], "code string, name string")
    got = {r.pair_id: r.langs for r in langid.langid_scores(preds, names).collect()}
    assert got == {1: {"Occitan": 0.3}, 2: {}}
