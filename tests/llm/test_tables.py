"""Pages, vectors, shards and the pipeline."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pairsift.llm import block_join, html_main, pivot_topk, sharding
from pairsift.llm.html_main import learn_weights, main_text

SF = "/root/testdata/sf0.001"


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_main.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<html><body class="page"><header><h1>Site</h1> menu</header><div id="cookie-banner">We use cookies a b c d</div>
<div class="content"><h2>Title here</h2><p>First para with words and <a href=x>link</a>, more.</p><div class="advert">Buy this now</div>
<p>Second &lt;b&gt; para&nbsp;x words</p><form><label>Your mail</label><input></form><aside>side words</aside><p>Third para.</p>
<section class="comments"><p>nice post man</p></section></div><div class="sidebar"><p>other stuff here</p></div>
<footer>copyright stuff</footer><script>var t="</p><p>no</p>"</script></body></html>"""


LONG = "plain words of the story that go on for a while"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body class='no-sidebar'><div class='content has-sidebar'><p>{LONG}</p></div></body>", LONG),
        (f"<div class='content sidebar-left'><p>{LONG}</p></div><div class='sidebar-left'>{LONG}</div>", LONG),
        (f"<article><p data-id='ad' data-x='class=ad'>{LONG}</p><p class='ad'>buy</p></article>", LONG),
        (f"<article><p><a href='x'>{LONG}</a></p><p>{LONG}</p><p>See <a href='y'>that other page</a></p></article>", f"{LONG} {LONG} See that other page"),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> end</p></article>", f"{LONG} x=2 end"),
        (f"<main><p>{LONG}</p><ol class='commentlist'><li>{LONG} I say</li></ol></main>", LONG),
        (f"<main><article><p>{LONG}</p></article><div class='sidebar'><article><p>{LONG} other</p></article></div></main>", LONG),
        (f"<div><ul><li><a href='a'>Home page</a></li><li><a href='b'>All news</a></li></ul><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><div class='my-ad-slot'>buy now</div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    ],
)
def test_main_text_of_small_pages(page, want):
    assert main_text(page, learn_weights(Counter(), Counter())) == want


def test_main_text_leaves_out_what_is_no_text(spark):
    from collections import Counter

    weights = learn_weights(Counter(), Counter())
    assert main_text(PAGE, weights) == "Title here First para with words and link, more. Second <b> para x words Third para."
    assert main_text("plain <b>x</b>y & z", weights) == "plain xy & z"
    assert main_text("<p>a < b", weights).startswith("a")
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", PAGE, "t"), (4, "v", "<div><p>one<p>two", "t"), (4, "v", "<div><p>one<p>two", "t")], "page_id long, url string, html string, text string")
    rows = html_main.extract_main_text(pages).collect()
    assert len(rows) == 5 and [r["text"] for r in rows if r["page_id"] == 4] == ["one two"] * 2
    assert [r["n_chars"] for r in rows if r["page_id"] in (1, 2)] == [0, 0]
    assert html_main.extract_main_text(pages.where("false")).count() == 0


def vectors(spark, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # equal vectors: ties
    rows += [(1000, None), (1050, [1.0] * 7 + [math.nan]), (1100, [0.0] * 8), (1150, [1.0] * 7 + [math.inf]), (1200, []), (1250, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [rows[7]]  # a repeated row
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int"), rows


def brute(rows, score, zero):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted(((-score(v, w), i) for i, w in good if i != q))[:5]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots,ring", [(8, 20), (1, 10_000)])
def test_exact_top_k_equals_brute_force(spark, pivots, ring):
    df, rows = vectors(spark)
    want = brute(rows, lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)), True)
    assert sorted(tuple(r) for r in pivot_topk.exact_top_k(df, pivots=pivots, ring=ring).collect()) == want
    few = df.where("vec_id IN (50, 51, 52)")
    assert pivot_topk.exact_top_k(few).count() == 2
    assert pivot_topk.exact_top_k(df.where("false")).count() == 0


@pytest.mark.parametrize("block,query_block", [(64, 4), (4096, 1024)])
def test_block_join_equals_brute_force(spark, block, query_block):
    df, rows = vectors(spark, 2)

    def cosine(a, b):
        a, b = np.array(a)[None], np.array(b)[None]
        return float(block_join.cosines(a, b)[0])

    assert sorted(tuple(r) for r in block_join.nearest_by_cosine(df, block=block, query_block=query_block).collect()) == brute(rows, cosine, False)
    assert block_join.nearest_by_cosine(df.where("false")).count() == 0


def test_quantisation_bounds_hold():
    v = np.random.default_rng(3).normal(size=(200, 16)) * 10.0 ** np.arange(-8, 8)
    code, scale, error = block_join.quantise(v)
    unit = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
    near = (code.astype(float) @ code.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - unit @ unit.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-9).all()


def check_shards(rows, shards):
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for k in range(shards):
        own = by.get(k, [])
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= total / shards / sharding.GROUP + largest


def test_shards_of_equal_bytes(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    copies = docs.where("doc_id = 3").crossJoin(spark.range(300).withColumnRenamed("id", "k")).withColumn("doc_id", docs["doc_id"] * 100_000 + 5 * 1)
    both = docs.select("doc_id", "text").union(copies.select("doc_id", "text"))
    rows = sharding.byte_shards(both, 24).collect()
    assert len(rows) == both.count()
    check_shards(rows, 24)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = [r for r in rows if r["doc_id"] in texts]
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in known)
    edge = sharding.byte_shards(edge_docs, 4).collect()
    assert len(edge) == edge_docs.count() and {r["law"] for r in edge} == {"bytes"}
    assert all(r["size"] == 8 for r in edge if r["doc_id"] in (4, 5))
    assert sharding.byte_shards(no_docs, 4).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert counts[0] >= counts[1] == counts[2] and counts[3] == counts[4]
    model = __import__("pairsift.llm.sentencepiece_scan", fromlist=["x"]).Pieces(corpus_pipeline.tokenizer_file("piece_bpe_32k.model")).model
    mixed = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(r["ids"] == model.encode(mixed[r["doc_id"]]) for r in random.Random(1).sample(docs.collect(), 20))


def test_vectors_of_other_lengths_and_large_components(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1.0, 1e3]) * r.gauss(0, 400) for _ in range(6)]) for i in range(240)]
    odd = [(1000, [1.0, 2.0, 3.0]), (1050, [1.0] * 9), (1100, [])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    assert max(sum(x * x for x in v) for v in whole.values()) > 2**53
    got = [tuple(x) for x in pivot_topk.exact_top_k(df, pivots=5, ring=16).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 240, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    near = block_join.nearest_by_cosine(df, block=30, query_block=2)
    assert {x["query_id"] for x in near.collect()} == set(range(0, 240, 50)) and near.count() == 25
    with pytest.raises(ValueError, match="2\\*\\*62"):
        pivot_topk.exact_top_k(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"))
