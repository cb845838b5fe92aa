"""Post-processing, corpus metrics and acceptance rules over generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsift.functions import flags as fl
from pairsift.functions import generation as gen
from pairsift.functions import text as tx
from pairsift.operators import alternates as alt
from pairsift.operators import metrics, qc
from pairsift.plans import curate
from pairsift.profile import EMOJI_RANGES
from pairsift.profile import ENGLISH_OCCITAN as P
from pairsift.registry import inputs as inp
from pairsift.registry.cleaning import quote, rep
from pairsift.registry.core import query
from pairsift.registry.pairs import ranges, sql_word
from pairsift.registry.scoring import r6, sql_r6

GEN = inp.GENERATIONS
PROMPT = f"('{inp.PROMPT_HEAD}' || src || '{inp.PROMPT_TAIL}')"


def sql_strip_prompt(first_line: bool) -> str:
    cut = f"CASE WHEN contains(raw, {PROMPT}) THEN substr(raw, 1, instr(raw, {PROMPT}) - 1) || substr(raw, instr(raw, {PROMPT}) + length({PROMPT})) ELSE raw END"
    if first_line:
        cut = f"split_part({cut}, chr(10), 1)"
    return f"rtrim({inp.sql_strip(cut)}, ' .,;:')"


HYPS = f"""{GEN},
hyps AS MATERIALIZED (SELECT pair_id, system, src, gold, raw, {sql_strip_prompt(True)} AS hyp FROM generations)"""
HYPS_FULL = f"""{GEN},
hyps AS MATERIALIZED (SELECT pair_id, system, src, gold, raw, {sql_strip_prompt(False)} AS hyp FROM generations)"""


def hyps(spark, sf, first_line=True):
    return qc.postprocess_causal(inp.generations(spark, sf), first_line=first_line)


for _name in ("strip_prompt", "postprocess_causal"):

    @query(_name, f"WITH {HYPS} SELECT pair_id, src, gold, hyp FROM hyps")
    def postprocess_causal(spark, sf):
        return hyps(spark, sf).select("pair_id", "src", "gold", "hyp")


@query("postprocess_seq2seq", f"WITH {GEN} SELECT pair_id, {inp.sql_strip('raw')} AS hyp FROM generations")
def postprocess_seq2seq(spark, sf):
    return qc.postprocess_seq2seq(inp.generations(spark, sf)).select("pair_id", "hyp")


# -- degenerate output -----------------------------------------------------------------

def sql_emoji(x):
    return f"regexp_matches({x}, '[{ranges(EMOJI_RANGES)}]')"


def sql_degenerate(x):
    body = inp.sql_strip(x)
    letters = f"length({rep(x, '[^' + chr(92) + 'p{L}]', '')})"
    return f"(length({body}) < 2 OR {sql_emoji(body)} OR {letters}::DOUBLE / greatest(length({body}), 1) < 0.5)"


@query("contains_emoji", f"WITH {GEN} SELECT pair_id, {sql_emoji('raw')} AS has_emoji FROM generations")
def contains_emoji(spark, sf):
    return inp.generations(spark, sf).select("pair_id", fl.contains_emoji(F.col("raw")).alias("has_emoji"))


@query("is_degenerate", f"WITH {HYPS} SELECT pair_id, {sql_degenerate('hyp')} AS degenerate FROM hyps")
def is_degenerate(spark, sf):
    return hyps(spark, sf).select("pair_id", fl.is_degenerate(F.col("hyp")).alias("degenerate"))


@query("count_degenerate", f"WITH {HYPS} SELECT system, count(*) FILTER ({sql_degenerate('hyp')}) AS n_degenerate FROM hyps GROUP BY system")
def count_degenerate(spark, sf):
    return metrics.count_degenerate(hyps(spark, sf))


@query("filter_degenerate", f"WITH {HYPS} SELECT pair_id, hyp FROM hyps WHERE NOT {sql_degenerate('hyp')}")
def filter_degenerate(spark, sf):
    return metrics.filter_degenerate(hyps(spark, sf)).select("pair_id", "hyp")


# -- metrics ---------------------------------------------------------------------------

def sql_13a(x):
    y = inp.sql_strip(x)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        y = f"replace({y}, {quote(old)}, {quote(new)})"
    y = f"(' ' || {y} || ' ')"
    y = rep(y, r"([\{-~\[-` -&\(-\+:-@/])", r" \1 ")
    y = rep(y, r"([^0-9])([.,])", r"\1 \2 ")
    y = rep(y, r"([.,])([^0-9])", r" \1 \2")
    y = rep(y, r"([0-9])(-)", r"\1 \2 ")
    return inp.sql_tokens(y)


WORDS = ("len({x})", "array_to_string({x}[i:i + n - 1], chr(1))")
CHARS = ("length({x})", "substr({x}, i, n)")


def ngram_ctes(name: str, source: str, units, order: int, how=WORDS) -> str:
    """(system, n, hyp, hyp_with_ref, ref, match) summed over sentences."""
    size, gram = how
    return f"""{name}_u AS MATERIALIZED (SELECT system, pair_id, {units('hyp')} AS h, {units('gold')} AS r FROM {source}),
{name}_g AS (
  SELECT system, pair_id, n, {gram.format(x="h")} AS g, 1 AS hc, 0 AS rc FROM (
    SELECT system, pair_id, n, h, unnest(range(1, {size.format(x="h")} - n + 2)) AS i FROM {name}_u, (SELECT unnest(range(1, {order + 1})) AS n))
  UNION ALL
  SELECT system, pair_id, n, {gram.format(x="r")}, 0, 1 FROM (
    SELECT system, pair_id, n, r, unnest(range(1, {size.format(x="r")} - n + 2)) AS i FROM {name}_u, (SELECT unnest(range(1, {order + 1})) AS n))),
{name}_c AS (SELECT system, pair_id, n, g, sum(hc) AS hc, sum(rc) AS rc FROM {name}_g GROUP BY ALL),
{name}_s AS (SELECT system, pair_id, n, sum(hc) AS hyp, sum(rc) AS ref, sum(least(hc, rc)) AS m FROM {name}_c GROUP BY ALL),
{name}_t AS (SELECT system, n, sum(hyp)::DOUBLE AS hyp, sum(CASE WHEN ref > 0 THEN hyp ELSE 0 END)::DOUBLE AS hyp_r, sum(ref)::DOUBLE AS ref, sum(m)::DOUBLE AS m
  FROM {name}_s GROUP BY ALL)"""


def bleu_ctes(source: str, out: str, units=sql_13a) -> str:
    return f"""{ngram_ctes(out + 'b', source, units, 4)},
{out}b_z AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY system ORDER BY n) AS zeros FROM {out}b_t),
{out} AS (SELECT system, CASE WHEN sum(m) > 0 AND count(*) FILTER (hyp > 0) = 4 THEN 100 * least(1, exp(1 - max(ref) FILTER (n = 1) / max(hyp) FILTER (n = 1)))
    * exp(avg(ln(CASE WHEN m > 0 THEN m ELSE pow(2.0, -zeros) END / CASE WHEN hyp > 0 THEN hyp END))) ELSE 0.0 END AS bleu FROM {out}b_z GROUP BY system)"""


def chrf_ctes(source: str, out: str) -> str:
    return f"""{ngram_ctes(out + 'c', source, inp.sql_solid, 6, CHARS)},
{out}_pr AS (SELECT system, avg(m / hyp_r) FILTER (hyp_r > 0 AND ref > 0) AS p, avg(m / ref) FILTER (hyp_r > 0 AND ref > 0) AS r FROM {out}c_t GROUP BY system),
{out} AS (SELECT system, coalesce(CASE WHEN 4 * p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) END, 0.0) AS chrf FROM {out}_pr)"""


ONE = "one AS MATERIALIZED (SELECT * REPLACE (0 AS system) FROM hyps)"


@query("corpus_bleu", f"WITH {HYPS}, {ONE}, {bleu_ctes('one', 'b')} SELECT {sql_r6('bleu')} FROM b")
def corpus_bleu(spark, sf):
    return metrics.corpus_bleu(hyps(spark, sf)).select(*r6("bleu"))


@query("corpus_bleu_untokenized", f"WITH {HYPS}, {ONE}, {bleu_ctes('one', 'b', inp.sql_tokens)} SELECT {sql_r6('bleu')} FROM b")
def corpus_bleu_untokenized(spark, sf):
    return metrics.corpus_bleu(hyps(spark, sf), tokenizer=tx.tokens).select(*r6("bleu"))


@query("corpus_chrf", f"WITH {HYPS}, {ONE}, {chrf_ctes('one', 'c')} SELECT {sql_r6('chrf')} FROM c")
def corpus_chrf(spark, sf):
    return metrics.corpus_chrf(hyps(spark, sf)).select(*r6("chrf"))


def scored_systems(source):
    return f"""{bleu_ctes(source, 'b')}, {chrf_ctes(source, 'c')}
SELECT b.system, {sql_r6('bleu', 'chrf')} FROM b JOIN c ON c.system = b.system"""


@query("score_systems", f"WITH {HYPS}, {scored_systems('hyps')}")
def score_systems(spark, sf):
    return metrics.score_systems(hyps(spark, sf)).select("system", *r6("bleu", "chrf"))


@query(
    "blank_degenerate",
    f"WITH {HYPS}, blanked AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {sql_degenerate('hyp')} THEN '' ELSE hyp END AS hyp) FROM hyps), {scored_systems('blanked')}",
)
def blank_degenerate(spark, sf):
    return metrics.score_systems(metrics.blank_degenerate(hyps(spark, sf))).select("system", *r6("bleu", "chrf"))


@query("truncate_degenerate", f"WITH {HYPS}, kept AS MATERIALIZED (SELECT * FROM hyps WHERE NOT {sql_degenerate('hyp')}), {scored_systems('kept')}")
def truncate_degenerate(spark, sf):
    return metrics.truncate_degenerate(hyps(spark, sf)).select("system", *r6("bleu", "chrf"))


@query(
    "evaluate_systems",
    f"""WITH {HYPS}, variants AS MATERIALIZED (
  SELECT * REPLACE (system || ' / as generated' AS system) FROM hyps UNION ALL
  SELECT * REPLACE (system || ' / degenerate blanked' AS system, CASE WHEN {sql_degenerate('hyp')} THEN '' ELSE hyp END AS hyp) FROM hyps UNION ALL
  SELECT * REPLACE (system || ' / degenerate removed' AS system) FROM hyps WHERE NOT {sql_degenerate('hyp')}),
{scored_systems('variants').replace('SELECT b.system', 'SELECT b.system AS label')}""",
)
def evaluate_systems(spark, sf):
    return curate.evaluate_systems(inp.generations(spark, sf)).select("label", *r6("bleu", "chrf"))


# -- acceptance --------------------------------------------------------------------------

LEAK = "CASE WHEN hyp = '' OR contains(lower(hyp), lower(src)) THEN 'empty/source leak' END"
DAYS = "CASE WHEN " + " OR ".join(f"({sql_word('src', a)} AND NOT contains(lower(hyp), '{b.lower()}'))" for a, b in P.weekdays) + " THEN 'Day of Week Mismatch' END"
TERMS = f"""CASE WHEN regexp_matches(src, '(?i)inkjet') AND regexp_matches(hyp, '(?i)laser') THEN 'Factual Error: Inkjet vs Laser'
  WHEN {sql_word('src', 'seasons?')} AND {sql_word('hyp', 'jornadas?')} THEN 'Factual Error: Season vs Jornadas' END"""


def sql_nums(x):
    return rf"list_sort(list_distinct(regexp_extract_all({x}, '\d+\.?\d*')))"


def sql_differ(a, b, reason):
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 AND {a} <> {b} THEN '{reason}' END"


NUMBERS = sql_differ(sql_nums("src"), sql_nums("hyp"), "Number Mismatch")


def sql_clocked(x):
    """One clock form for all: a bare "1030 hours" is written 10:30 first, then blanks of clock times are single characters."""
    return rep(x, rf"(^|[^{inp.WORD}])(1[0-2]|0?[1-9])([0-5]\d)\s*hours?($|[^{inp.WORD}])", r"\1\2:\3\4")


def sql_times(x):
    found = rf"regexp_extract_all({sql_clocked(x)}, '(^|[^{inp.WORD}])(\d{{1,2}}[:hH]\d{{2}})', 2)"
    return f"list_sort(list_distinct(list_transform({found}, lambda t: translate(t, 'hH', '::'))))"


def sql_rest_nums(x):
    """Numbers by their place: those that begin inside a clock time are left out."""
    bare = rep(sql_clocked(x), rf"(^|[^{inp.WORD}])(\d{{1,2}})[:hH](\d{{2}})($|[^{inp.WORD}])", r"\1 \4")
    return sql_nums(bare)


TIMES = sql_differ(sql_times("src"), sql_times("hyp"), "Time Mismatch")
CRITICAL = f"coalesce({DAYS}, {TERMS}, {NUMBERS})"
REST_NUMBERS = sql_differ(sql_rest_nums("src"), sql_rest_nums("hyp"), "Number Mismatch")
RULES = (
    ("reject_empty_or_leak", lambda: gen.reject_empty_or_leak(F.col("src"), F.col("hyp")), LEAK),
    ("check_day_names", lambda: gen.check_day_names(F.col("src"), F.col("hyp"), P), DAYS),
    ("check_term_conflict", lambda: gen.check_term_conflict(F.col("src"), F.col("hyp"), P), TERMS),
    ("check_time_numbers", lambda: gen.check_time_numbers(F.col("src"), F.col("hyp")), TIMES),
    ("check_numbers", lambda: gen.check_numbers(F.col("src"), F.col("hyp")), NUMBERS),
    ("critical_error", lambda: gen.critical_error(F.col("src"), F.col("hyp"), P), CRITICAL),
    ("critical_error_with_times", lambda: gen.critical_error(F.col("src"), F.col("hyp"), P, check_times=True), f"coalesce({DAYS}, {TERMS}, {TIMES}, {REST_NUMBERS})"),
)


def _register(name, rule, sql):
    @query(name, f"WITH {HYPS_FULL} SELECT pair_id, coalesce({sql}, '') AS reason FROM hyps")
    def run(spark, sf):
        return hyps(spark, sf, False).select("pair_id", F.coalesce(rule(), F.lit("")).alias("reason"))


for _n, _r, _s in RULES:
    _register(_n, _r, _s)


@query(
    "qc_generations",
    f"WITH {HYPS_FULL} SELECT pair_id, src, gold, hyp, coalesce({LEAK}, {CRITICAL}, 'accepted') AS reason FROM hyps",
)
def qc_generations(spark, sf):
    accepted, rejected = qc.qc_generations(inp.generations(spark, sf))
    cols = ["pair_id", "src", "gold", "hyp"]
    return accepted.select(*cols, F.lit("accepted").alias("reason")).unionByName(rejected.select(*cols, "reason"))


@query("rejection_summary", f"WITH {HYPS_FULL} SELECT coalesce({LEAK}, {CRITICAL}, 'accepted') AS reason, count(*) AS n FROM hyps GROUP BY ALL")
def rejection_summary(spark, sf):
    return qc.rejection_summary(qc.with_reason(hyps(spark, sf, False)))


@query("extract_numbers", rf"WITH {HYPS} SELECT pair_id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '\d+\.?\d*'))), '|') AS numbers FROM hyps")
def extract_numbers(spark, sf):
    found = F.array_join(F.array_sort(tx.extract_numbers(F.col("raw"))), "|")
    return hyps(spark, sf).select("pair_id", found.alias("numbers"))


@query(
    "number_set_diff",
    f"""WITH {HYPS} SELECT pair_id, array_to_string(list_filter({sql_nums('src')}, lambda x: NOT list_contains({sql_nums('hyp')}, x)), '|') AS only_src,
  array_to_string(list_filter({sql_nums('hyp')}, lambda x: NOT list_contains({sql_nums('src')}, x)), '|') AS only_hyp FROM hyps""",
)
def number_set_diff(spark, sf):
    a, b = gen.number_set_diff(F.col("src"), F.col("hyp"))
    joined = [F.array_join(F.array_sort(x), "|").alias(n) for x, n in ((a, "only_src"), (b, "only_hyp"))]
    return hyps(spark, sf).select("pair_id", *joined)


# number words are appended so that whole texts hold some; rows-only, golden tests cover the values
NUMBER_TEXTS = ("", " twenty one and three", " fifty-two hundred", " cinquanta un e dos cent", " vint-e-un 17", " dètz-e-sèt mil")


@query("alt_number_words_src")
def alt_number_words_src(spark, sf):
    t = F.concat("src", inp.pick(NUMBER_TEXTS, F.col("pair_id")))
    found = alt.alt_number_words_src(t).cast("array<string>")
    return inp.line_pairs(spark, sf).select("pair_id", F.array_join(found, "|").alias("numbers"))


@query("alt_number_words_tgt")
def alt_number_words_tgt(spark, sf):
    t = F.concat("tgt", inp.pick(NUMBER_TEXTS, F.col("pair_id")))
    found = alt.alt_number_words_tgt(t).cast("array<string>")
    return inp.line_pairs(spark, sf).select("pair_id", F.array_join(found, "|").alias("numbers"))
