"""Similarities, score components, ranks, statistics and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsift.functions import scores as sc
from pairsift.operators import alternates as alt
from pairsift.operators import ordering, scoring, select, stats
from pairsift.plans import curate
from pairsift.registry import inputs as inp
from pairsift.registry.core import query

IN, SCORED = inp.SCORED_IN, inp.SCORED


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def sql_r6(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("cosine_similarity", f"WITH {inp.SIMS} SELECT pair_idx, {sql_r6('sim_a', 'sim_b')} FROM sims")
def cosine_similarity(spark, sf):
    return inp.sims(spark, sf).select("pair_idx", *r6("sim_a", "sim_b"))


@query(
    "pair_similarity",
    f"""WITH {inp.LINE_PAIRS}, {inp.SIMS}
SELECT pair_id, src, tgt, {sql_r6('sim_a', 'sim_b')} FROM line_pairs p JOIN sims s ON s.pair_idx = p.pair_id % (SELECT count(*) FROM sims)""",
)
def pair_similarity(spark, sf):
    halves = inp.vector_halves(spark, sf)
    n = halves.agg(F.count(F.lit(1))).scalar()
    pairs = inp.line_pairs(spark, sf).drop("lang").withColumn("_n", n)
    keyed = pairs.withColumn("pair_idx", F.col("pair_id") % F.col("_n")).drop("_n")
    out = curate.pair_similarity(keyed, halves, "pair_idx")
    return out.select("pair_id", "src", "tgt", *r6("sim_a", "sim_b"))


@query("agree_max", f"WITH {IN} SELECT pair_id, round(least(sim_a, sim_b), 6) AS agree_raw, round(greatest(sim_a, sim_b), 6) AS max_raw FROM scored_in")
def agree_max(spark, sf):
    return scoring.agree_max(inp.scored_in(spark, sf)).select("pair_id", *r6("agree_raw", "max_raw"))


@query("pct_rank_avg", f"WITH {IN} SELECT pair_id, round({inp.pct_rank_sql('sim_a')}, 9) AS pct_rank FROM scored_in")
def pct_rank_avg(spark, sf):
    df = inp.scored_in(spark, sf).select("pair_id", "sim_a")
    return ordering.pct_rank_avg(df, "sim_a", "pct_rank").select("pair_id", F.round("pct_rank", 9).alias("pct_rank"))


@query(
    "pct_rank_avg_hot",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_extendedprice END::DOUBLE AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER (), 9) AS pct_rank FROM v""",
)
def pct_rank_avg_hot(spark, sf):
    """The same rank where one value holds about half of all rows."""
    x = F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_extendedprice").cast("double"))
    df = inp.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return ordering.pct_rank_avg(df, "x", "pct_rank").select(
        "l_orderkey", "l_linenumber", F.round("pct_rank", 9).alias("pct_rank")
    )


@query("combined_rank", f"WITH {SCORED} SELECT pair_id, {sql_r6('sim_a_rank', 'sim_b_rank', 'combined_rank')} FROM scored")
def combined_rank(spark, sf):
    out = scoring.combined_rank(inp.scored_in(spark, sf).select("pair_id", "sim_a", "sim_b"), "sim_a", "sim_b")
    return out.select("pair_id", *r6("sim_a_rank", "sim_b_rank", "combined_rank"))


@query("sim_rank", f"WITH {SCORED} SELECT pair_id, {sql_r6('sim_rank')} FROM scored")
def sim_rank(spark, sf):
    return scoring.sim_rank(inp.scored_in(spark, sf).select("pair_id", "sim_a", "sim_b")).select("pair_id", *r6("sim_rank"))


@query("lang_prob_score", f"WITH {SCORED} SELECT pair_id, {sql_r6('lang_prob_score')} FROM scored")
def lang_prob_score(spark, sf):
    score = sc.lang_prob_score(F.col("tgt_score"), F.col("tok_tgt"))
    return inp.scored_in(spark, sf).select("pair_id", F.round(score, 6).alias("lang_prob_score"))


@query("length_score", f"WITH {SCORED} SELECT pair_id, {sql_r6('length_score')} FROM scored")
def length_score(spark, sf):
    return scoring.length_scores(inp.scored_in(spark, sf)).select("pair_id", *r6("length_score"))


@query("min_embedding_score", f"WITH {SCORED} SELECT pair_id, {sql_r6('min_embedding_score')} FROM scored")
def min_embedding_score(spark, sf):
    return scoring.min_embedding_score(inp.scored_in(spark, sf)).select("pair_id", *r6("min_embedding_score"))


@query("ensemble_score", f"WITH {SCORED} SELECT pair_id, {sql_r6('score')} FROM scored")
def ensemble_score(spark, sf):
    return inp.scored(spark, sf).select("pair_id", *r6("score"))


@query("veto_flag", f"WITH {SCORED} SELECT pair_id, veto FROM scored")
def veto_flag(spark, sf):
    return inp.scored(spark, sf).select("pair_id", "veto")


PARTS = ("sim_a_rank", "sim_b_rank", "combined_rank", "sim_rank", "lang_prob_score", "length_score", "min_embedding_score", "score")


@query("score_pairs", f"WITH {SCORED} SELECT pair_id, src, tgt, {sql_r6(*PARTS)}, veto FROM scored")
def score_pairs(spark, sf):
    return inp.scored_once(spark, sf).select("pair_id", "src", "tgt", *r6(*PARTS), "veto")


# -- statistics ---------------------------------------------------------------------

@query("score_stats", f"WITH {SCORED} SELECT round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(mb, 6) AS mean_b, round(sb, 6) AS std_b FROM stats")
def score_stats(spark, sf):
    return stats.score_stats(inp.scored_in(spark, sf)).select(*r6("mean_a", "std_a", "mean_b", "std_b"))


CUTS = "quantile_cont(score, 0.75) AS q75, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.1) AS q10"


@query("score_quantiles", f"WITH {SCORED}, q AS (SELECT {CUTS} FROM scored) SELECT {sql_r6('q75', 'q50', 'q10')} FROM q")
def score_quantiles(spark, sf):
    return stats.score_quantiles(inp.scored(spark, sf)).select(*r6("q75", "q50", "q10"))


TIERS = f"""{SCORED}, q AS (SELECT {CUTS} FROM scored),
tiers AS (SELECT pair_id, CASE WHEN score > q75 THEN 'high' WHEN score > q50 THEN 'medium' WHEN score >= q10 THEN 'low' ELSE 'very low' END AS tier FROM scored, q)"""


@query("quality_tier", f"WITH {TIERS} SELECT pair_id, tier FROM tiers")
def quality_tier(spark, sf):
    return stats.quality_tier(inp.scored(spark, sf).select("pair_id", "score")).select("pair_id", "tier")


@query("tier_counts", f"WITH {TIERS} SELECT tier, count(*) AS n FROM tiers GROUP BY tier")
def tier_counts(spark, sf):
    return stats.tier_counts(inp.scored(spark, sf).select("pair_id", "score"))


def sql_histogram(value, source):
    return f"""SELECT least(floor(({value} - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS n
FROM {source}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) GROUP BY ALL"""


@query("histogram50", f"WITH {SCORED} {sql_histogram('score', 'scored')}")
def histogram50(spark, sf):
    return stats.histogram50(inp.scored(spark, sf).select("score"), "score")


def sql_describe(value, source):
    return f"""SELECT count({value}) AS "count", round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std, round(min({value}), 6) AS "min",
  round(quantile_cont({value}, 0.25), 6) AS q25, round(quantile_cont({value}, 0.5), 6) AS q50, round(quantile_cont({value}, 0.75), 6) AS q75,
  round(max({value}), 6) AS "max" FROM {source}"""


DESCRIBED = ("mean", "std", "min", "q25", "q50", "q75", "max")


@query("describe_scores", f"WITH {SCORED} {sql_describe('score', 'scored')}")
def describe_scores(spark, sf):
    return stats.describe_scores(inp.scored(spark, sf).select("score"), "score").select("count", *r6(*DESCRIBED))


HALVES = """gs AS (SELECT l.vec_id // 2 AS pair_id, list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS sim
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0)"""


def _gold_vs_synthetic(spark, sf):
    e = inp.table(spark, sf, "embeddings").withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    gold = e.where(F.col("vec_id") % 2 == 0).select("pair_id", F.col("embedding").alias("gold_vec"))
    hyp = e.where(F.col("vec_id") % 2 == 1).select("pair_id", F.col("embedding").alias("hyp_vec"))
    return curate.gold_vs_synthetic_similarity(gold.join(hyp, "pair_id"))


@query("gold_vs_synthetic_similarity", f"WITH {HALVES} SELECT pair_id, {sql_r6('sim')} FROM gs")
def gold_vs_synthetic_similarity(spark, sf):
    return _gold_vs_synthetic(spark, sf)[0].select("pair_id", *r6("sim"))


@query("gold_vs_synthetic_histogram", f"WITH {HALVES} {sql_histogram('sim', 'gs')}")
def gold_vs_synthetic_histogram(spark, sf):
    return _gold_vs_synthetic(spark, sf)[1]


@query("gold_vs_synthetic_describe", f"WITH {HALVES} {sql_describe('sim', 'gs')}")
def gold_vs_synthetic_describe(spark, sf):
    return _gold_vs_synthetic(spark, sf)[2].select("count", *r6(*DESCRIBED))


@query("value_counts", f"WITH {inp.LINE_PAIRS} SELECT tgt, count(*) AS n FROM line_pairs GROUP BY tgt")
def value_counts(spark, sf):
    return stats.value_counts(inp.line_pairs(spark, sf), "tgt")


@query("count_containing", f"WITH {inp.LINE_PAIRS} SELECT count(*) AS n FROM line_pairs WHERE contains(src, 'tion')")
def count_containing(spark, sf):
    return stats.count_containing(inp.line_pairs(spark, sf), "src", "tion")


# -- selections -----------------------------------------------------------------------

@query("select_train_head", f"WITH {inp.LINE_PAIRS} SELECT pair_id, src, tgt FROM line_pairs ORDER BY pair_id LIMIT 3000")
def select_train_head(spark, sf):
    return select.select_train_head(inp.line_pairs(spark, sf).drop("lang"))


@query("select_topk_by_score", f"WITH {SCORED} SELECT pair_id, src, tgt FROM scored ORDER BY score DESC, pair_id LIMIT 250")
def select_topk_by_score(spark, sf):
    return curate.early_stop_set(inp.scored(spark, sf))


@query("preview", f"WITH {inp.LINE_PAIRS} SELECT pair_id, src, tgt FROM line_pairs ORDER BY pair_id LIMIT 10")
def preview(spark, sf):
    return select.preview(inp.line_pairs(spark, sf).drop("lang"), "pair_id")


@query("slice_rows", f"WITH {inp.LINE_PAIRS} SELECT pair_id, src, tgt FROM line_pairs ORDER BY pair_id LIMIT 500 OFFSET 503")
def slice_rows(spark, sf):
    return select.slice_rows(inp.line_pairs(spark, sf).drop("lang"), ["pair_id"], 503, 1003)


@query(
    "first_n_per_group",
    f"WITH {inp.LINE_PAIRS} SELECT lang, pair_id, src, tgt FROM line_pairs QUALIFY row_number() OVER (PARTITION BY lang ORDER BY pair_id) <= 10",
)
def first_n_per_group(spark, sf):
    return select.first_n_per_group(inp.line_pairs(spark, sf), "lang", ["pair_id"])


@query(
    "head_sample",
    "SELECT doc_id, source || '-' || lang AS corpus, text FROM documents QUALIFY row_number() OVER (PARTITION BY source || '-' || lang ORDER BY doc_id) <= 10",
)
def head_sample(spark, sf):
    d = inp.table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("corpus"), "text")
    return select.head_sample(d, "corpus", ["doc_id"])


@query("add_row_index", f"WITH {inp.LINE_PAIRS} SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS idx FROM line_pairs")
def add_row_index(spark, sf):
    return ordering.add_row_index(inp.line_pairs(spark, sf).select("pair_id"), ["pair_id"])


@query(
    "number_rows_within",
    "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem",
)
def number_rows_within(spark, sf):
    """Contiguous numbers inside three groups that hold the whole table."""
    df = inp.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return ordering.number_rows(df, ["l_orderkey", "l_linenumber"], within=["l_returnflag"])


# -- optional scorers -----------------------------------------------------------------

ALT = {
    "alt_length_score": (
        lambda: alt.alt_length_score(F.col("tok_src"), F.col("tok_tgt")),
        "least(greatest(exp(-1.5 * abs(ln((tok_tgt + 1)::DOUBLE / (tok_src + 1)))), 0), 1)",
    ),
    "alt_length_agreement": (
        lambda: alt.alt_length_agreement(F.col("len_src"), F.col("len_tgt"), F.col("tok_src"), F.col("tok_tgt")),
        """least(greatest(0.6 * (least(tok_src, tok_tgt)::DOUBLE / greatest(tok_src, tok_tgt) - 0.4) / 0.6
          + 0.4 * (least(len_src, len_tgt)::DOUBLE / greatest(len_src, len_tgt) - 0.1) / 0.9, 0), 1)""",
    ),
    "alt_logit_temperature": (lambda: alt.alt_logit_temperature(F.col("tgt_score") * 0.99), "1 / (1 + exp(-ln(tgt_score * 0.99 / (1 - tgt_score * 0.99)) / 0.8))"),
    "alt_langid_calibration": (
        lambda: alt.alt_langid_calibration(F.col("tgt_score"), F.col("tok_tgt")),
        """exp(-tok_tgt / 12.0) * 0.5 + (1 - exp(-tok_tgt / 12.0)) / (1 + exp(-ln(least(greatest(tgt_score, 1e-6), 1 - 1e-6)
          / (1 - least(greatest(tgt_score, 1e-6), 1 - 1e-6))) / 0.8))""",
    ),
    "alt_zscore_sigmoid": (lambda: alt.alt_zscore_sigmoid(F.col("sim_a"), F.lit(0.1), F.lit(0.2)), "1 / (1 + exp(-((sim_a - 0.1) / 0.2)))"),
}


def _register_alt(name, rule, sql):
    @query(name, f"WITH {IN} SELECT pair_id, round({sql}, 6) AS score FROM scored_in")
    def run(spark, sf):
        return inp.scored_in(spark, sf).where((F.col("tok_src") > 0) | (F.col("tok_tgt") > 0)).select(
            "pair_id", F.round(rule(), 6).alias("score")
        )


for _name, (_rule, _sql) in ALT.items():
    _register_alt(_name, _rule, _sql)

ROBUST = "1 / (1 + exp(-(({c} - {q}50) / (CASE WHEN {q}75 - {q}25 > 1e-8 THEN {q}75 - {q}25 ELSE 1.0 END / 1.349)) / 1.5))"
ROBUST_Q = """rq AS (SELECT quantile_cont(sim_a, 0.25) AS a25, quantile_cont(sim_a, 0.5) AS a50, quantile_cont(sim_a, 0.75) AS a75,
  quantile_cont(sim_b, 0.25) AS b25, quantile_cont(sim_b, 0.5) AS b50, quantile_cont(sim_b, 0.75) AS b75 FROM scored_in)"""


@query("alt_robust_scale", f"WITH {IN}, {ROBUST_Q} SELECT pair_id, round({ROBUST.format(c='sim_a', q='a')}, 6) AS score FROM scored_in, rq")
def alt_robust_scale(spark, sf):
    out = alt.alt_robust_scale(inp.scored_in(spark, sf).select("pair_id", "sim_a"), "sim_a", "score")
    return out.select("pair_id", *r6("score"))


def sql_hint(x):
    t = f"(' ' || lower({x}) || ' ')"
    plus = " + ".join(f"contains({t}, {inp.quote(h)})::INT" for h in alt.TARGET_HINTS)
    minus = " - ".join(f"contains({t}, {inp.quote(h)})::INT" for h in alt.COUNTER_HINTS)
    return f"(({plus} - {minus})::DOUBLE / length({t}))"


@query("alt_target_hint", f"WITH {inp.LINE_PAIRS} SELECT pair_id, round({sql_hint('tgt')}, 6) AS score FROM line_pairs")
def alt_target_hint(spark, sf):
    return inp.line_pairs(spark, sf).select("pair_id", F.round(alt.alt_target_hint(F.col("tgt")), 6).alias("score"))


@query(
    "alt_curation_score",
    f"""WITH {IN}, {ROBUST_Q},
n AS (SELECT scored_in.*, {ROBUST.format(c='sim_a', q='a')} AS an, {ROBUST.format(c='sim_b', q='b')} AS bn, {sql_hint('tgt')} AS hint,
  {ALT['alt_length_score'][1]} AS len, {ALT['alt_langid_calibration'][1]} AS cal, (tok_tgt + 1)::DOUBLE / (tok_src + 1) AS lr FROM scored_in, rq),
m AS (SELECT *, least(an, bn) AS agree, greatest(an, bn) AS mx FROM n)
SELECT pair_id, round(0.45 * (0.7 * {inp.pct_rank_sql('agree')} + 0.3 * {inp.pct_rank_sql('mx')}) + 0.25 * len + 0.15 * cal
  + 0.15 * {inp.pct_rank_sql('hint')}, 6) AS curation_score, (lr < 0.45 OR lr > 2.2) AND agree < 0.75 AS hard_veto FROM m""",
)
def alt_curation_score(spark, sf):
    return alt.alt_curation_score(inp.scored_in(spark, sf)).select("pair_id", *r6("curation_score"), "hard_veto")


@query("alt_similarity_quantile_filter", f"WITH {IN} SELECT pair_id, {sql_r6('sim_a')} FROM scored_in WHERE sim_a >= (SELECT quantile_cont(sim_a, 0.1) FROM scored_in)")
def alt_similarity_quantile_filter(spark, sf):
    return alt.alt_similarity_quantile_filter(inp.scored_in(spark, sf)).select("pair_id", *r6("sim_a"))


@query("alt_language_distribution", "SELECT lang AS label, count(*) AS n FROM documents WHERE lang NOT IN ('en', '') GROUP BY lang")
def alt_language_distribution(spark, sf):
    docs = inp.table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return alt.alt_language_distribution(docs, "label", ("en", ""))


@query(
    "alt_digit_match",
    f"""WITH {inp.NOISY_PAIRS} SELECT pair_id, list_sort(regexp_extract_all(src, '\\d+')) = list_sort(regexp_extract_all(tgt, '\\d+')) AS same_digits
FROM noisy_pairs""",
)
def alt_digit_match(spark, sf):
    return inp.noisy_pairs(spark, sf).select("pair_id", alt.alt_digit_match(F.col("src"), F.col("tgt")).alias("same_digits"))
