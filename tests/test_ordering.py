"""Ranks, quantiles and row numbers, on the one-window path and on the bucketed one."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsift.operators import dedup, ordering, scoring, select, stats
from pairsift.operators.skew import spread_lookup


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(5)
    rows = [(i, 0.5 if i % 3 == 0 else round(rnd.gauss(0, 1), 2)) for i in range(3000)]
    rows += [(3000, None), (3001, float("nan"))]
    return spark.createDataFrame(rows, "id long, v double").repartition(5).cache()


def test_golden_rank_and_quantiles(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 4.0)], "id long, v double")
    ranks = {r.id: r.r for r in ordering.pct_rank_avg(df, "v", "r").collect()}
    assert ranks == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}
    q = ordering.quantiles(df, "v", {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.75}).first()
    assert [round(x, 9) for x in q] == [1.3, 1.75, 2.0, 2.5]


def test_ranks_with_a_hot_value(values):
    pdf = ordering.pct_rank_avg(values, "v", "r", buckets=16).toPandas().set_index("id").sort_index()
    expected = values.toPandas().set_index("id").sort_index().v.rank(pct=True)
    assert len(pdf) == 3002
    pd.testing.assert_series_equal(pdf.r, expected, check_names=False, atol=1e-12)


def test_spread_lookup_is_a_left_join_on_both_sides_of_the_split(spark):
    rows = [(i, "hot" if i < 700 else None if i < 720 else f"k{i % 50}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k string")
    facts = df.where("k is not null and k <> 'k7'").groupBy("k").agg(F.count("*").alias("w")).withColumns(
        {"t": F.lit(1000), "fact": F.concat(F.lit("f-"), "k")}
    )
    out = spread_lookup(df, facts, "k", weight="w", total="t", spread_by="id", slots=8).collect()
    assert len(out) == 1000
    for r in out:
        assert r.fact == (None if r.k in (None, "k7") else f"f-{r.k}")


def test_number_rows_is_contiguous_with_and_without_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.random(), "big" if i % 5 else "small") for i in range(2000)]
    df = spark.createDataFrame(rows, "k double, g string").repartition(7)
    flat = ordering.number_rows(df, ["k"], buckets=32).toPandas().sort_values("k")
    assert list(flat.idx) == list(range(2000))
    grouped = ordering.number_rows(df, ["k"], within=["g"], buckets=32).toPandas().sort_values("k")
    assert (grouped.groupby("g").cumcount() == grouped.idx).all()


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_results_do_not_depend_on_partitions(spark, values, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        ranks = ordering.pct_rank_avg(values, "v", "r").toPandas().sort_values("id").r
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = values.toPandas().sort_values("id").v.rank(pct=True)
    assert ((ranks.reset_index(drop=True) - expected.reset_index(drop=True)).abs().dropna() < 1e-12).all()


def test_dedup_keeps_first_or_first_repeat(spark):
    rows = [(1, "a", "t"), (2, "b", "t"), (3, "b", "t"), (4, "c", "u"), (5, "b", "t")]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    assert sorted(r.pair_id for r in dedup.dedup_keep_first(df).collect()) == [1, 4]
    assert sorted(r.pair_id for r in dedup.dedup_keep_first(df, prefer_repeated=True).collect()) == [3, 4]


def test_histogram_last_bin_is_closed_and_flat_input_works(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    bins = {r.bin: r.n for r in stats.histogram50(df, "v").collect()}
    assert sum(bins.values()) == 101 and max(bins) == 49 and bins[49] == 3
    flat = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [(r.bin, r.n) for r in stats.histogram50(flat, "v").collect()] == [(25, 4)]


def test_scores_stay_in_range(spark):
    rows = [(i, i % 7 / 7, i % 5 / 5, i % 11 / 10, 5 + i % 9, 6 + i % 4, 2 + i % 3, 2 + i % 5) for i in range(200)]
    df = spark.createDataFrame(
        rows, "pair_id long, sim_a double, sim_b double, tgt_score double, len_src int, len_tgt int, tok_src int, tok_tgt int"
    )
    out = scoring.score_pairs(df).toPandas()
    assert len(out) == 200
    for c in ("sim_a_rank", "sim_b_rank", "combined_rank", "sim_rank", "lang_prob_score", "length_score", "score"):
        assert out[c].between(0, 1).all()
    assert (out.sim_a_rank > 0).all()


def test_distill_and_eval_sets_are_disjoint(spark):
    dev = spark.createDataFrame([(i, "s", "t") for i in range(20)], "pair_id long, src string, tgt string")
    devtest = spark.createDataFrame([(100 + i, "s", "t") for i in range(1100)], "pair_id long, src string, tgt string")
    distill, held_out = select.build_distill_eval_sets(dev, devtest, "pair_id")
    assert (distill.count(), held_out.count()) == (20 + 503, 500)
    assert distill.select("pair_id").intersect(held_out.select("pair_id")).count() == 0


def test_rows_of_a_null_group_are_numbered(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, None)], "id int, g string")
    got = {r["id"]: r["idx"] for r in ordering.number_rows(df, ["id"], within=["g"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


@pytest.mark.parametrize("accuracy", [2, 20, ordering.SKETCH])
def test_quantiles_don_t_depend_on_the_sketch(spark, accuracy):
    r = random.Random(accuracy)
    probs = {"none": 0.0, "low": 0.1, "quarter": 0.25, "half": 0.5, "near": 0.51, "top": 0.999, "all": 1.0}
    for rows in ([3.5], [1.0, 2.0], [7.0] * 50, [r.choice([1.0, 1.0, 2.0, r.gauss(0, 1)]) for _ in range(700)]):
        df = spark.createDataFrame([(x,) for x in [*rows, None, float("nan")]], "v double").repartition(3)
        got = ordering.quantiles(df, "v", probs, accuracy).first()
        want = pd.Series(rows).quantile(list(probs.values()))
        assert list(got) == pytest.approx(list(want), abs=1e-12)
    assert list(ordering.quantiles(spark.createDataFrame([(None,)], "v double"), "v", probs, accuracy).first()) == [None] * len(probs)


def test_quantiles_scan_the_values_twice_and_keep_a_small_part(spark, monkeypatch):
    kept = []
    wrap = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, name: (lambda out: kept.append((name, out.count())) or out)(wrap(df, name)))
    q = ordering.quantiles(spark.range(200_000).selectExpr("double(id) AS v"), "v", {"q": 0.3})
    assert q.first()["q"] == pytest.approx(0.3 * 199_999)
    assert [n for n, _ in kept] == ["values", "spans"] and kept[1][1] < 1000


@pytest.mark.parametrize("buckets", [1, 3, 16, 64])
def test_ranks_of_several_columns_with_values_over_many_buckets(spark, buckets):
    r = random.Random(buckets)
    pick = lambda: r.choice([None, 0.0, 0.0, 0.0, 1.0, 1.0, round(r.gauss(0, 1), 1), float("nan")])
    rows = [(i, pick(), r.choice([5.0, 5.0, r.random()]), 7.0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(6)
    outs = {"a": "ra", "b": "rb", "c": "rc"}
    got = ordering.pct_ranks(df, outs, buckets=buckets).toPandas().set_index("id").sort_index()
    values = df.toPandas().set_index("id").sort_index()
    for value, out in outs.items():
        pd.testing.assert_series_equal(got[out], values[value].rank(pct=True), check_names=False, atol=1e-12)
    assert ordering.pct_ranks(df.where("false"), outs, buckets=buckets).count() == 0


@pytest.mark.parametrize(("few", "values"), [(1, "tied"), (10_000, "tied"), (1, "one"), (1, "none")])
def test_parts_cut_at_positions(spark, monkeypatch, few, values):
    monkeypatch.setattr(ordering, "FEW", few)
    r = random.Random(few)
    key = {"tied": lambda i: r.choice([None, 3, 3, 3, r.randrange(40)]), "one": lambda i: 5, "distinct": lambda i: i, "none": lambda i: i}[values]
    rows = [(key(i), f"t{i // 2}", i) for i in range(0 if values == "none" else 300)]
    df = spark.createDataFrame(rows, "k int, t string, i int").repartition(5)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    edges = [7, 110, 110, 1000]
    parts = [[tuple(x) for x in p.collect()] for p in ordering.cut_at(df, ["k"], edges)]
    assert sorted(map(repr, sum(parts, []))) == sorted(map(repr, rows))
    for first, last, part in zip([0, *edges], [*edges, None], parts, strict=True):
        assert sorted(map(repr, (x[0] for x in part))) == sorted(map(repr, (x[0] for x in order[first:last])))
    pair = [tuple(x) for x in ordering.cut_at(df, ["k", "i"], [20, 45])[1].collect()]
    assert sorted(map(repr, pair)) == sorted(map(repr, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))[20:45]))


def test_a_slice_is_a_filter_on_its_key(spark, capsys):
    df = spark.range(50_000).selectExpr("id", "repeat('x', 50) AS text")
    part = ordering.cut_at(df, ["id"], [503, 1003])[1]
    part.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Window" not in plan
    assert [x["id"] for x in part.orderBy("id").collect()] == list(range(503, 1003))
