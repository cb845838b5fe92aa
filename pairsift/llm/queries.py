"""The operators of this subpackage as named queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsift.llm import (
    block_join, html_main, mixing, ngram_join, pivot_topk, prefix_trie, quality, sentencepiece_scan, sharding, suffix_dedup, token_alignment, token_counts, toxicity,
)
from pairsift.llm.settings import MIX_SEED, MIX_WEIGHTS, tokenizer_file


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_jaccard_groups(table(spark, sf, "documents"), width=3, num=90, den=100)


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf, "documents"), length=400)


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), MIX_WEIGHTS, MIX_SEED)


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf, "pages"))


def op7_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_topk.exact_top_k(table(spark, sf, "embeddings"), k=5, every=50)


def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_scan.piece_report(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf, "documents"), shards=24)


def op10_block_join(spark: SparkSession, sf: str) -> DataFrame:
    return block_join.nearest_by_cosine(table(spark, sf, "embeddings"), k=5, every=50)


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _shingle_sql(width: int) -> str:
    word = "unnest(range(1, len(w) - {k} + 2))".format(k=width)
    return f"""words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g
  FROM (SELECT doc_id, w, {word} AS i FROM words WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') || ' ' FROM words WHERE len(w) BETWEEN 1 AND {width - 1})"""


OP1_SQL = f"""WITH RECURSIVE {_shingle_sql(3)},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
ids AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
  FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM shingles GROUP BY doc_id)
SELECT ids.doc_id, n_shingles, component_id,
  coalesce(min(ids.doc_id) OVER (PARTITION BY s) < ids.doc_id AND s IS NOT NULL, false) AS is_copy
FROM ids LEFT JOIN sets ON sets.doc_id = ids.doc_id"""

OP3_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
parts AS (SELECT doc_id, n, j, substr(x, 800 * j + 1, 1598) AS x FROM (SELECT doc_id, x, n, unnest(range(0, (n - 400) // 400 + 1)) AS j FROM h WHERE n >= 400)),
w AS (SELECT doc_id, 400 * j + i AS s, md5(substr(x, 2 * i - 1, 800)) AS k FROM (SELECT doc_id, j, x, unnest(range(1, least(400, n - 400 - 400 * j + 1) + 1)) AS i FROM parts)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w SEMI JOIN twice USING (k)),
runs AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM hit),
spans AS (SELECT doc_id, r, min(s) AS a, max(s) + 399 AS z FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT h.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS x,
    sum(z - a + 1) AS n_removed, count(*) AS n_spans
  FROM h JOIN gaps ON gaps.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id"""

OP5_SQL = f"""WITH d AS (SELECT *, CASE WHEN source IN ({", ".join(map(_quote, MIX_WEIGHTS))}) THEN source END AS bucket FROM documents),
sizes AS (SELECT bucket, sum(coalesce(strlen(text), 0)) AS bytes FROM d GROUP BY bucket),
rates AS (
  SELECT bucket, CASE WHEN bytes = 0 THEN 1 ELSE (CASE {" ".join(f"WHEN bucket = {_quote(k)} THEN {w}" for k, w in MIX_WEIGHTS.items())}
    ELSE {max(0.0, 1 - sum(MIX_WEIGHTS.values()))!r} END)::DOUBLE * (SELECT sum(bytes) FROM sizes) / bytes END AS mean FROM sizes),
shares AS (SELECT bucket, greatest(1, ceil(mean / {mixing.STEP}))::BIGINT AS parts, mean / greatest(1, ceil(mean / {mixing.STEP})) AS m FROM rates),
terms AS (SELECT bucket, parts, k, exp(-m + CASE WHEN k = 0 THEN 0 ELSE k * ln(m) END - lgamma(k + 1)) AS t FROM shares, (SELECT unnest(range({mixing.DEPTH + 1})) AS k)),
upto AS (SELECT bucket, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM (
  SELECT bucket, parts, k, sum(t) OVER (PARTITION BY bucket ORDER BY k) AS c FROM terms) GROUP BY bucket),
drawn AS (
  SELECT d.* EXCLUDE (bucket), list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(cs, lambda c:
    c <= ('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':' || p), 1, 13))::BIGINT / 4503599627370496.0)))) AS n
  FROM d JOIN upto ON d.bucket IS NOT DISTINCT FROM upto.bucket),
taken AS (SELECT * EXCLUDE (n), unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn)
SELECT *, md5('order {MIX_SEED}:' || doc_id || ':' || copy) AS mix_key FROM taken"""

_WHOLE_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP7_SQL = f"""WITH {_WHOLE_SQL},
scores AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q, v x WHERE q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5"""

OP10_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scores AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(x.v, x.v))) AS score
  FROM v q, v x WHERE q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5"""

# the digits' CRC-32, bit by bit; prefixes are named by the MD5 of their turns, and subtree totals walk up from each node along its first member
OP12_SQL = """WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS n, c - c % 100 AS root, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 6 AS h
  FROM own GROUP BY c),
made AS (
  SELECT convs.c, i, role, text FROM convs JOIN own ON own.c = root AND i < h
  UNION ALL SELECT convs.c, i + 6, role, text FROM convs JOIN own ON own.c = convs.c AND i >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, text, md5(length(role) || ':' || role || text) AS t FROM made),
marked AS (SELECT c, d, length(text) AS chars, md5(string_agg(t, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM placed),
rows AS (
  SELECT c, d, chars, k, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY d) AS up FROM marked
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
lens AS (SELECT c, max(d) AS len FROM rows GROUP BY c),
nodes AS (
  SELECT k, any_value(up) AS up, min(d) AS d, min(c) AS c, count(*) AS n, min(chars) AS chars FROM rows GROUP BY k),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT r.k, sum(CASE WHEN kids.up IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((u.n - 1) * u.chars)::BIGINT AS saved_tokens
  FROM nodes u LEFT JOIN kids ON kids.up = u.k JOIN rows r ON r.c = u.c AND r.d <= u.d GROUP BY r.k),
ends AS (SELECT k, sha256(string_agg(r.c::VARCHAR, ',' ORDER BY r.c)) AS e FROM rows r JOIN lens ON lens.c = r.c AND len = d GROUP BY k)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  coalesce(e, sha256('')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.k = x.up LEFT JOIN kids ON kids.up = x.k JOIN sums ON sums.k = x.k LEFT JOIN ends ON ends.k = x.k"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_token_counts, op3_suffix_dedup, op4_quality, op5_mix_sources, op6_main_text,
        op7_exact_top_k, op8_sentencepiece, op9_shards, op10_block_join, op11_toxicity, op12_prefix_trie, op13_token_alignment, pipeline,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op5_mix_sources": OP5_SQL, "op7_exact_top_k": OP7_SQL, "op10_block_join": OP10_SQL, "op12_prefix_trie": OP12_SQL}
