"""Pair flags, routing, filters, dedup and language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsift.functions import flags as fl
from pairsift.functions import text as tx
from pairsift.operators import dedup, langid, routing
from pairsift.plans import curate
from pairsift.profile import ENGLISH_OCCITAN as P
from pairsift.registry import inputs as inp
from pairsift.registry.cleaning import rep, sql_contractions, sql_garbage_ctes, sql_spaces
from pairsift.registry.core import query
from pairsift.registry.inputs import WORD, sql_solid, sql_strip, sql_token_count

NP = inp.NOISY_PAIRS


def ranges(pairs) -> str:
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in pairs)


# -- flags ------------------------------------------------------------------------

def sql_ratio(x):
    w = sql_solid(x)
    return f"coalesce(length({rep(w, '[^' + chr(92) + 'p{L}]', '')}) , 0)", w


def sql_non_letter(x):
    letters, solid = sql_ratio(x)
    return f"CASE WHEN {solid} = '' THEN 1.0::DOUBLE ELSE (length({solid}) - {letters})::DOUBLE / length({solid}) END"


def sql_bad_char(x):
    outside = f"regexp_matches({x}, '[^{ranges(P.allowed_ranges)}]')"
    unprintable = rf"regexp_matches(translate({x}, ' ' || chr(9) || chr(10) || chr(13), ''), '[\p{{C}}\p{{Z}}]')"
    return f"({outside} OR {unprintable})"


FLAGS = (
    ("flag_no_letters", fl.no_letters, lambda x: rf"NOT regexp_matches({x}, '\p{{L}}')"),
    ("flag_len_le_1", fl.len_le_1, lambda x: f"length({sql_strip(x)}) <= 1"),
    ("flag_token_le_1", fl.token_le_1, lambda x: f"{sql_token_count(x)} <= 1"),
    ("non_letter_ratio", lambda x: F.round(fl.non_letter_ratio(x), 6), lambda x: f"round({sql_non_letter(x)}, 6)"),
    ("letter_ratio", lambda x: F.round(fl.letter_ratio(x), 6),
     lambda x: f"round(CASE WHEN {sql_strip(x)} = '' THEN 0.0::DOUBLE ELSE length({rep(x, '[^' + chr(92) + 'p{L}]', '')})::DOUBLE / length({sql_strip(x)}) END, 6)"),
    ("flag_disallowed_char", lambda x: fl.disallowed_char(x, P), sql_bad_char),
)


def _register(name, rule, sql):
    @query(name, f"WITH {NP} SELECT pair_id, {sql('src')} AS src_flag, {sql('tgt')} AS tgt_flag FROM noisy_pairs")
    def run(spark, sf):
        return inp.noisy_pairs(spark, sf).select(
            "pair_id", rule(F.col("src")).alias("src_flag"), rule(F.col("tgt")).alias("tgt_flag")
        )


for _n, _r, _s in FLAGS:
    _register(_n, _r, _s)


def sql_side_drop(x):
    return f"""NOT regexp_matches({x}, '\\p{{L}}') OR length({sql_strip(x)}) <= 1 OR {sql_non_letter(x)} > 0.8 OR {sql_bad_char(x)}"""


ROUTED = f"""{NP},
routed AS (SELECT *, {sql_side_drop('src')} OR {sql_side_drop('tgt')} AS is_discarded,
  {sql_token_count('src')} <= 1 OR {sql_token_count('tgt')} <= 1 AS is_single FROM noisy_pairs)"""


@query(
    "route_three_way",
    f"""WITH {ROUTED} SELECT 'discarded' AS route, pair_id, src, tgt FROM routed WHERE is_discarded
UNION ALL SELECT 'single', pair_id, src, tgt FROM routed WHERE is_single
UNION ALL SELECT 'main', pair_id, src, tgt FROM routed WHERE NOT is_discarded AND NOT is_single""",
)
def route_three_way(spark, sf):
    return routing.with_routes(inp.noisy_pairs(spark, sf))


@query("route_main", f"WITH {ROUTED} SELECT pair_id, src, tgt FROM routed WHERE NOT is_discarded AND NOT is_single")
def route_main(spark, sf):
    return routing.route_three_way(inp.noisy_pairs(spark, sf))[2]


@query("route_discarded", f"WITH {ROUTED} SELECT pair_id, src, tgt FROM routed WHERE is_discarded")
def route_discarded(spark, sf):
    return routing.route_three_way(inp.noisy_pairs(spark, sf))[0].select("pair_id", "src", "tgt")


@query("route_single", f"WITH {ROUTED} SELECT pair_id, src, tgt FROM routed WHERE is_single")
def route_single(spark, sf):
    return routing.route_three_way(inp.noisy_pairs(spark, sf))[1].select("pair_id", "src", "tgt")


@query("project_pairs", f"WITH {inp.LINE_PAIRS} SELECT src, tgt FROM line_pairs")
def project_pairs(spark, sf):
    from pairsift.sources.corpus import project_pairs as project

    return project(inp.line_pairs(spark, sf))


# -- pair filters -----------------------------------------------------------------

def sql_anagram(a="src", b="tgt"):
    def chars(x):
        return f"list_sort(string_split({sql_solid(f'lower({x})')}, ''))"

    return f"{chars(a)} = {chars(b)}"


def sql_contained(a="src", b="tgt", fold=""):
    x, y = f"replace({fold}({a}), ' ', '')", f"replace({fold}({b}), ' ', '')"
    return f"(contains({x}, {y}) OR contains({y}, {x}))"


TOK_S, TOK_T = sql_token_count("src"), sql_token_count("tgt")
FILTERS = (
    ("filter_anagram", routing.filter_anagram, f"NOT ({sql_anagram()})"),
    ("filter_containment", routing.filter_containment, f"NOT {sql_contained()}"),
    ("filter_containment_ignore_case", lambda d: routing.filter_containment(d, True), f"NOT {sql_contained(fold='lower')}"),
    ("filter_empty", routing.filter_empty, "src <> '' AND tgt <> ''"),
    ("filter_char_ratio", routing.filter_char_ratio, "length(tgt) > 0 AND length(src)::DOUBLE / greatest(length(tgt), 1) BETWEEN 0.1 AND 10"),
    ("filter_char_bounds", routing.filter_char_bounds, "length(src) BETWEEN 2 AND 500 AND length(tgt) BETWEEN 2 AND 500"),
    ("filter_token_bounds", routing.filter_token_bounds, f"{TOK_S} > 1 AND {TOK_S} < 100 AND {TOK_T} > 1 AND {TOK_T} < 100"),
    ("filter_token_ratio", routing.filter_token_ratio, f"{TOK_T} > 0 AND {TOK_S}::DOUBLE / greatest({TOK_T}, 1) BETWEEN 0.33 AND 3"),
)


def _register_filter(name, op, sql):
    @query(name, f"WITH {NP} SELECT pair_id, src, tgt FROM noisy_pairs WHERE {sql}")
    def run(spark, sf):
        return op(inp.noisy_pairs(spark, sf)).select("pair_id", "src", "tgt")


for _n, _r, _s in FILTERS:
    _register_filter(_n, _r, _s)


def stage_c_ctes(source: str, out: str) -> str:
    return f"""{sql_garbage_ctes(source, 'pair_id', ('src', 'tgt'), out + '_cut')},
{out}_norm AS MATERIALIZED (SELECT * REPLACE ({sql_spaces('src')} AS src, {sql_contractions('tgt')} AS tgt) FROM {out}_cut),
{out}_len AS MATERIALIZED (SELECT *, length(src)::INT AS len_src, length(tgt)::INT AS len_tgt, {TOK_S}::INT AS tok_src, {TOK_T}::INT AS tok_tgt
  FROM {out}_norm WHERE src <> '' AND tgt <> ''),
{out} AS (SELECT * FROM {out}_len WHERE len_src::DOUBLE / len_tgt BETWEEN 0.1 AND 10 AND len_src BETWEEN 2 AND 500 AND len_tgt BETWEEN 2 AND 500
  AND tok_src > 1 AND tok_src < 100 AND tok_tgt > 1 AND tok_tgt < 100 AND tok_src::DOUBLE / tok_tgt BETWEEN 0.33 AND 3
  AND NOT {sql_contained()} AND NOT ({sql_anagram()}))"""


@query(
    "stage_c",
    f"WITH {NP}, {stage_c_ctes('noisy_pairs', 'usable')} SELECT pair_id, src, tgt, len_src, len_tgt, tok_src, tok_tgt FROM usable",
)
def stage_c(spark, sf):
    return routing.stage_c(inp.noisy_pairs(spark, sf))


def sql_word(x, w):
    return f"regexp_matches({x}, '(?i)(^|[^{WORD}]){w}([^{WORD}]|$)')"


def sql_indicators(x):
    return "(" + " + ".join(f"{sql_word(x, w)}::INT" for w in P.source_stop_words) + ")"


@query("indicator_count", f"WITH {NP} SELECT pair_id, {sql_indicators('tgt')}::INT AS indicators FROM noisy_pairs")
def indicator_count(spark, sf):
    return inp.noisy_pairs(spark, sf).select("pair_id", tx.indicator_count(F.col("tgt"), P).alias("indicators"))


@query("filter_indicator_count", f"WITH {NP} SELECT pair_id, tgt FROM noisy_pairs WHERE {sql_indicators('tgt')} < 2")
def filter_indicator_count(spark, sf):
    return routing.filter_indicator_count(inp.noisy_pairs(spark, sf)).select("pair_id", "tgt")


@query("contains_word", f"WITH {NP} SELECT pair_id, {sql_word('src', 'the')} AS has_the, {sql_word('tgt', 'with')} AS has_with FROM noisy_pairs")
def contains_word(spark, sf):
    return inp.noisy_pairs(spark, sf).select(
        "pair_id", tx.contains_word(F.col("src"), "the").alias("has_the"), tx.contains_word(F.col("tgt"), "with").alias("has_with")
    )


# -- dedup ------------------------------------------------------------------------

@query(
    "dedup_keep_first",
    f"""WITH {inp.LINE_PAIRS} SELECT pair_id, src, tgt FROM line_pairs
QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pair_id) = 1""",
)
def dedup_keep_first(spark, sf):
    return dedup.dedup_keep_first(inp.line_pairs(spark, sf).drop("lang"))


@query(
    "dedup_prefer_repeated",
    f"""WITH {inp.LINE_PAIRS}, tagged AS (
  SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY pair_id) > 1 AS is_repeat FROM line_pairs)
SELECT pair_id, src, tgt FROM tagged QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY is_repeat DESC, pair_id) = 1""",
)
def dedup_prefer_repeated(spark, sf):
    return dedup.dedup_keep_first(inp.line_pairs(spark, sf).drop("lang"), prefer_repeated=True)


@query(
    "drop_by_index",
    f"""WITH {inp.LINE_PAIRS} SELECT pair_id, src, tgt FROM line_pairs
WHERE pair_id NOT IN (SELECT pair_id FROM line_pairs WHERE src = tgt)""",
)
def drop_by_index(spark, sf):
    p = inp.line_pairs(spark, sf).drop("lang")
    return dedup.drop_by_index(p, p.where(F.col("src") == F.col("tgt")))


# -- language identification ----------------------------------------------------------

GATE = f"(length(tgt) > 15 AND {TOK_T} >= 3)"


@query("langid_gate", f"WITH {NP} SELECT pair_id, {GATE} AS is_judged FROM noisy_pairs")
def langid_gate(spark, sf):
    return inp.noisy_pairs(spark, sf).select("pair_id", langid.gate(F.col("tgt")).alias("is_judged"))


LANG_SCORES = f"""{inp.langpred_sql('noisy_pairs')},
top5 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY prob DESC, label) AS place FROM langpred QUALIFY place <= 5),
named AS (SELECT pair_id, prob, place, coalesce(n.name, c.code) AS name FROM (
  SELECT *, regexp_extract(label, '__label__([^_]*)', 1) AS code FROM top5) c LEFT JOIN lang_names n ON n.code = c.code),
lang_scores AS (SELECT pair_id, name, prob FROM named WHERE prob >= 0.05 QUALIFY row_number() OVER (PARTITION BY pair_id, name ORDER BY place DESC) = 1)"""


@query("langid_top_k", f"WITH {NP}, {LANG_SCORES} SELECT pair_id, label, round(prob, 6) AS prob, place::INT AS place FROM top5")
def langid_top_k(spark, sf):
    top = langid.langid_top_k(inp.langpred(inp.noisy_pairs(spark, sf)))
    return top.select("pair_id", "label", F.round("prob", 6).alias("prob"), "place")


@query("langid_scores", f"WITH {NP}, {LANG_SCORES} SELECT pair_id, name, round(prob, 6) AS prob FROM lang_scores")
def langid_scores(spark, sf):
    out = langid.langid_scores(inp.langpred(inp.noisy_pairs(spark, sf)), inp.lang_names(spark))
    return out.select("pair_id", F.explode("langs").alias("name", "p")).select("pair_id", "name", F.round("p", 6).alias("prob"))


TGT_SCORE = f"""{LANG_SCORES},
identified AS (SELECT p.*, CASE WHEN {GATE} THEN coalesce(s.prob, 0.0) ELSE 0.0 END::DOUBLE AS tgt_score
  FROM noisy_pairs p LEFT JOIN lang_scores s ON s.pair_id = p.pair_id AND s.name = 'Occitan')"""


def _identified(spark, sf, pairs):
    scores = langid.langid_scores(inp.langpred(pairs), inp.lang_names(spark))
    return langid.attach_langid(pairs, scores)


@query("target_lang_score", f"WITH {NP}, {TGT_SCORE} SELECT pair_id, round(tgt_score, 6) AS tgt_score FROM identified")
def target_lang_score(spark, sf):
    return _identified(spark, sf, inp.noisy_pairs(spark, sf)).select("pair_id", F.round("tgt_score", 6).alias("tgt_score"))


@query("filter_langid", f"WITH {NP}, {TGT_SCORE} SELECT pair_id, tgt FROM identified WHERE tgt_score > 0")
def filter_langid(spark, sf):
    return langid.filter_langid(_identified(spark, sf, inp.noisy_pairs(spark, sf))).select("pair_id", "tgt")


@query(
    "pre_similarity_clean",
    f"""WITH {NP},
uniq AS MATERIALIZED (SELECT * FROM noisy_pairs QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pair_id) = 1),
{inp.predicted_sql('uniq', GATE)}
SELECT u.pair_id, src, tgt, round(s.prob, 6) AS tgt_score, {sql_indicators('tgt')}::INT AS indicators
FROM uniq u JOIN lang_scores s ON s.pair_id = u.pair_id AND s.name = {inp.quote(inp.TARGET.target_name)}
WHERE {GATE} AND NOT ({sql_anagram()}) AND {sql_indicators('tgt')} < 2""",
)
def pre_similarity_clean(spark, sf):
    out = curate.pre_similarity_clean(inp.noisy_pairs(spark, sf), inp.identifier(spark, sf), inp.TARGET)
    return out.select("pair_id", "src", "tgt", F.round("tgt_score", 6).alias("tgt_score"), "indicators")


@query(
    "pre_similarity_clean_by_labels",
    f"""WITH {NP},
uniq AS MATERIALIZED (SELECT * FROM noisy_pairs QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pair_id) = 1),
{LANG_SCORES}
SELECT u.pair_id, src, tgt, round(s.prob, 6) AS tgt_score, {sql_indicators('tgt')}::INT AS indicators
FROM uniq u JOIN lang_scores s ON s.pair_id = u.pair_id AND s.name = 'Occitan'
WHERE {GATE} AND NOT ({sql_anagram()}) AND {sql_indicators('tgt')} < 2""",
)
def pre_similarity_clean_by_labels(spark, sf):
    """The same with a table of label scores made elsewhere."""
    pairs = inp.noisy_pairs(spark, sf)
    scores = langid.langid_scores(inp.langpred(pairs), inp.lang_names(spark))
    out = curate.pre_similarity_clean(pairs, scores)
    return out.select("pair_id", "src", "tgt", F.round("tgt_score", 6).alias("tgt_score"), "indicators")


SQL_MODEL = inp.sql_model()


@query(
    "langid_train",
    f"""WITH {SQL_MODEL} SELECT c.label, c.tok, round(ln((n + 1)::DOUBLE) + unseen, 6) AS log_prob
FROM counts c JOIN known_labels l ON l.label = c.label""",
)
def langid_train(spark, sf):
    model = langid.langid_train(inp.widen(inp.table(spark, sf, "documents")), "text", "lang")
    return model.rows().select("label", "tok", F.round("log_prob", 6).alias("log_prob"))


@query(
    "langid_predict",
    f"""WITH {SQL_MODEL},
gains AS (SELECT t.doc_id, c.label, sum(ln((c.n + 1)::DOUBLE)) AS g FROM toks t JOIN counts c ON c.tok = t.tok GROUP BY ALL),
ntok AS (SELECT doc_id, {inp.sql_token_count('text')} AS n FROM documents),
lp AS (SELECT d.doc_id, l.label, prior + n * unseen + coalesce(g, 0) AS lp FROM ntok d CROSS JOIN known_labels l LEFT JOIN gains g ON g.doc_id = d.doc_id AND g.label = l.label),
ex AS (SELECT doc_id, label, exp(lp - max(lp) OVER (PARTITION BY doc_id)) AS e FROM lp)
SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM ex""",
)
def langid_predict(spark, sf):
    docs = inp.widen(inp.table(spark, sf, "documents"))
    out = langid.langid_predict(docs, langid.langid_train(docs, "text", "lang"), "doc_id", "text")
    return out.select("doc_id", "label", F.round("prob", 6).alias("prob"))
