"""Named queries against their SQL, and the stream against the batch plan."""

import math

import duckdb
import pytest

from pairsift.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "clean_pairs", "route_three_way", "stage_c", "dedup_keep_first", "dedup_prefer_repeated", "langid_scores",
    "langid_predict", "pre_similarity_clean", "pre_similarity_clean_by_labels", "score_pairs", "quality_tier", "histogram50", "zip_parallel",
    "number_rows_within", "pad_batches", "weighted_ce_loss", "score_systems", "qc_generations", "clean_stream",
    "dedup_stream", "curate",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def test_every_query_but_two_has_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"alt_number_words_src", "alt_number_words_tgt"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())
    assert got
