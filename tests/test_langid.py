"""The token model: tokens in the broadcast table and tokens joined by a shuffle give the same posterior."""

import math
from collections import Counter, defaultdict

import pytest

from pairsift.operators import langid

TRAIN = [(1, "the cat the dog", "en"), (2, "le chat le chien", "fr"), (3, "the chien", "en"), (4, "el gato", "es"), (5, None, "en"), (6, "  ", "fr")]
ASK = [(1, "The chat the unknown"), (2, None), (3, ""), (4, " \t "), (5, "the " * 500 + "gato"), (6, "zzz " * 40)]


def brute():
    counts, docs = defaultdict(Counter), Counter()
    for _, text, label in TRAIN:
        docs[label] += 1
        counts[label].update((text or "").lower().split())
    room = len(set().union(*counts.values()))
    out = {}
    for k, text in ASK:
        toks = (text or "").lower().split()
        logs = {}
        for x, c in counts.items():
            logs[x] = math.log(docs[x] / len(TRAIN)) + sum(math.log((c[t] + 1) / (sum(c.values()) + room)) for t in toks)
        top = max(logs.values())
        out |= {(k, x): math.exp(v - top) / sum(math.exp(w - top) for w in logs.values()) for x, v in logs.items()}
    return out


@pytest.mark.parametrize("room", [langid.BROADCAST_GAINS, 9, 3, 0])
def test_posterior_equals_brute_force(spark, room):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")
    model = langid.langid_train(train, "text", "lang", broadcast_gains=room)
    assert (model.least is None) == (room > 20)
    rows = langid.langid_predict(spark.createDataFrame(ASK, "doc_id long, text string"), model).collect()
    got = {(r["doc_id"], r["label"]): r["prob"] for r in rows}
    want = brute()
    assert got.keys() == want.keys() and len(rows) == len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_single_shuffle_without_rare_tokens(spark):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")
    model = langid.langid_train(train, "text", "lang")
    plan = langid.langid_probs(spark.createDataFrame(ASK, "doc_id long, text string"), model)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1 and "Window" not in physical


def test_saved_model_and_survivors_only(spark, tmp_path):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")
    model = langid.langid_train(train, "text", "lang")
    langid.save_model(model, str(tmp_path / "model"))
    again = langid.load_model(spark, str(tmp_path / "model"))
    assert (again.names, again.priors, again.unseen, again.least) == (model.names, model.priors, model.unseen, model.least)
    who = langid.Identifier(again, {"fr": "French", "es": "Spanish", "en": "Spanish"})
    pairs = spark.createDataFrame([(1, "le chat le chien le chat"), (2, "le"), (3, None), (4, "the dog the cat the dog")], "pair_id long, tgt string")
    got = {r["pair_id"]: r for r in langid.identify(pairs, who).collect()}
    assert set(got) == {1, 4}  # the others are too short to be judged
    probs = {r["pair_id"]: dict(zip(again.names, r["probs"], strict=True)) for r in langid.langid_probs(pairs, again, "pair_id", "tgt").collect()}
    for k in got:
        want = {"French": probs[k]["fr"]}
        en, es = probs[k]["en"], probs[k]["es"]
        want["Spanish"] = min(en, es) if min(en, es) >= langid.MIN_PROB else max(en, es)
        assert got[k]["langs"] == pytest.approx({n: p for n, p in want.items() if p >= langid.MIN_PROB})
        assert got[k]["tgt_score"] == 0.0  # no label is shown as Occitan
