"""Text rules one by one, the whole cleaning chain, and the change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.functions import unicode as uc
from pairsift.operators import cleaning
from pairsift.profile import ENGLISH_OCCITAN as P
from pairsift.profile import DEFAULT_SCRIPT, SCRIPT_RANGES, WINDOWS_1252, WINDOWS_1252_UNASSIGNED
from pairsift.operators import catalog
from pairsift.registry import inputs as inp
from pairsift.registry.core import query
from pairsift.registry.inputs import WORD, WS, quote

NOT_WS = "[^" + WS[1:]
DIGIT = r"\p{Nd}"


def rep(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, '{flags}')"


# -- SQL of each rule -----------------------------------------------------------

def sql_unicode(x):
    return f"replace(nfc_normalize({x}), chr(65279), '')"


def sql_line_endings(x):
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def sql_control(x):
    return rep(x, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]+", "")


ENTITIES = (("&eacute;", "é"), ("&lt;", "<"), ("&gt;", ">"), ("&#233;", "é"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def sql_unescape(x):
    for a, b in ENTITIES:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return x


def sql_tags(x):
    x = rep(x, r"<(?:script|style)[\s\S]*?</(?:script|style)>", "", "gi")
    return rep(rep(x, r"<[^>]+>", ""), r"&[A-Za-z0-9#]+;", "")


def sql_urls(x):
    x = rep(x, rf"https?://{NOT_WS}+|www\.{NOT_WS}+", "")
    x = rep(x, rf"[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]{{2,}}", "")
    return rep(x, rf"(?:[A-Za-z]:\\|/)[{WORD}./\\-]+", "")


def sql_markup(x):
    x = rep(x, rf"@{WS}*[{WORD}][{WORD}:-]*", "")
    return rep(x, r"[\[{(][^\])}]{0,200}[\])}]", "")


def sql_typography(x):
    for a, b in P.typography:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return x


def sql_punct(x):
    return rep(x, r"([!?.,:;—–-])[!?.,:;—–-]{3,}", r"\1")


def sql_spaces(x):
    return f"trim({rep(x, WS + '+', ' ')})"


LETTER = "a-zA-ZÀ-ÿ"


def sql_apostrophe(x):
    return rep(x, rf"([{LETTER}]){WS}*'{WS}*([{LETTER}])", r"\1'\2")


def sql_slash(x):
    return rep(x, rf"{WS}*/{WS}*", "/")


def sql_punct_spacing(x):
    return rep(rep(x, rf"{WS}+([!?;,:])", r"\1"), rf"([!?])([{LETTER}])", r"\1 \2")


def sql_spaced_entities(x):
    x = rep(x, rf"{WS}*&{WS}*#{WS}*160{WS}*;", " ")
    x = rep(x, rf"&{WS}*#{WS}*{DIGIT}+{WS}*;", "")
    return rep(x, rf"&{WS}*(?:amp|quot|lt|gt|nbsp){WS}*;", "")


def sql_metadata(x):
    for p in P.metadata_patterns:
        x = rep(x, p.replace(r"\s", WS), "", "gi")
    return x


def sql_guillemets(x):
    return rep(rep(x, f"«{WS}+", "«"), f"{WS}+»", "»")


def sql_numbers(x):
    x = rep(x, rf"({DIGIT}+)(?:[,. ]|({WS}))({DIGIT}{{3}})", r"\1\2\3")
    return rep(x, rf"({DIGIT}+),({DIGIT}+)", r"\1.\2")


def sql_times(x):
    x = rep(x, rf"({DIGIT}{{1,2}}) *: *({DIGIT}{{2}})", r"\1:\2")
    return rep(x, rf"({DIGIT}{{1,2}}) *([hH]) {{2,}}", r"\1\2")


def sql_placeholders(x):
    for sign in "%&#":
        x = rep(x, rf"{WS}*{sign}{WS}*({DIGIT}+)", rf"{sign}\1")
    return x


def sql_run_on(x):
    return rep(rep(x, "([a-zà-ÿ])([A-Z])", r"\1 \2"), "([A-ZÀ-Ÿ])([A-ZÀ-Ÿ][a-z])", r"\1 \2")


def collapse_repeat_ctes(source: str, key: str, col: str, out: str) -> str:
    """RE2 has no back-references: find runs of one character by position instead."""
    return f"""{out}_chars AS (
  SELECT {key}, unnest(string_split({col}, '')) AS c, generate_subscripts(string_split({col}, ''), 1) AS i FROM {source} WHERE {col} <> ''),
{out}_runs AS (
  SELECT {key}, c, min(i) AS p0, count(*) AS n FROM (
    SELECT {key}, c, i, i - row_number() OVER (PARTITION BY {key}, c ORDER BY i) AS g FROM {out}_chars) GROUP BY {key}, c, g),
{out} AS (
  SELECT s.* EXCLUDE ({col}), coalesce(r.x, '') AS {col} FROM {source} s LEFT JOIN (
    SELECT {key}, string_agg(repeat(c, (CASE WHEN n > 10 AND c <> chr(10) THEN 3 ELSE n END)::BIGINT), '' ORDER BY p0) AS x
    FROM {out}_runs GROUP BY {key}) r ON r.{key} = s.{key})"""


# name, the Column rule, the SQL rule, input
RULES = (
    ("normalize_unicode", cleaning.normalize_unicode, sql_unicode),
    ("normalize_line_endings", tx.normalize_line_endings, sql_line_endings),
    ("remove_control_chars", tx.remove_control_chars, sql_control),
    ("html_unescape", uc.html_unescape, sql_unescape),
    ("remove_html_tags", tx.remove_html_tags, sql_tags),
    ("remove_urls_emails_paths", tx.remove_urls_emails_paths, sql_urls),
    ("strip_markup_tokens", tx.strip_markup_tokens, sql_markup),
    ("replace_typography", lambda x: tx.replace_typography(x, P), sql_typography),
    ("collapse_punct", tx.collapse_punct, sql_punct),
    ("collapse_whitespace", tx.collapse_whitespace, sql_spaces),
    ("fix_run_on_text", tx.fix_run_on_text, sql_run_on),
    ("apostrophe_fix", tx.apostrophe_fix, sql_apostrophe),
    ("slash_fix", tx.slash_fix, sql_slash),
    ("fix_punct_spacing", tx.fix_punct_spacing, sql_punct_spacing),
    ("remove_spaced_entities", tx.remove_spaced_entities, sql_spaced_entities),
    ("remove_corpus_metadata", lambda x: tx.remove_corpus_metadata(x, P), sql_metadata),
    ("fix_guillemets", tx.fix_guillemets, sql_guillemets),
    ("normalise_number_separators", tx.normalise_number_separators, sql_numbers),
    ("normalise_time_units", tx.normalise_time_units, sql_times),
    ("fix_placeholder_spacing", tx.fix_placeholder_spacing, sql_placeholders),
    ("preprocess_for_embedding", tx.preprocess_for_embedding, sql_spaces),
)


def _register(name, rule, sql_rule):
    @query(name, f"WITH {inp.NOISY_DOCS} SELECT doc_id, {sql_rule('text')} AS clean FROM noisy_docs")
    def run(spark, sf):
        return inp.noisy_docs(spark, sf).select("doc_id", rule(F.col("text")).alias("clean"))


for _name, _rule, _sql in RULES:
    _register(_name, _rule, _sql)


@query("remove_html_tags_pages", f"WITH {inp.PAGE_TEXTS} SELECT page_id, {sql_tags('text')} AS clean FROM page_texts")
def remove_html_tags_pages(spark, sf):
    return inp.page_texts(spark, sf).select("page_id", tx.remove_html_tags(F.col("text")).alias("clean"))


@query("html_unescape_pages", f"WITH {inp.PAGE_TEXTS} SELECT page_id, {sql_unescape('text')} AS clean FROM page_texts")
def html_unescape_pages(spark, sf):
    return inp.page_texts(spark, sf).select("page_id", uc.html_unescape(F.col("text")).alias("clean"))


@query(
    "collapse_repeat_char",
    f"WITH {inp.NOISY_DOCS}, {collapse_repeat_ctes('noisy_docs', 'doc_id', 'text', 'done')} SELECT doc_id, text AS clean FROM done",
)
def collapse_repeat_char(spark, sf):
    return inp.noisy_docs(spark, sf).select("doc_id", tx.collapse_repeat_char(F.col("text")).alias("clean"))


@query("repair_mojibake", "SELECT doc_id, text AS clean FROM documents")
def repair_mojibake(spark, sf):
    """Breaks every document, UTF-8 read as Latin-1 or as Windows-1252, every other one twice, and repairs it again."""
    controls = "".join(chr(b) for b in range(0x80, 0xA0) if b not in WINDOWS_1252_UNASSIGNED)
    latin = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    windows = lambda x: F.translate(latin(x), controls, WINDOWS_1252)
    way = F.col("doc_id") % 4
    broken = F.when(way == 0, latin("text")).when(way == 1, windows("text")).when(way == 2, windows(windows("text"))).otherwise(latin(windows("text")))
    docs = inp.widen(inp.table(spark, sf, "documents")).select("doc_id", broken.alias("text"))
    return docs.select("doc_id", tx.repair_mojibake(F.col("text")).alias("clean"))


@query("flag_very_long", "SELECT doc_id, length(text) > 10000 AS very_long FROM documents")
def flag_very_long(spark, sf):
    d = inp.widen(inp.table(spark, sf, "documents"))
    return d.select("doc_id", tx.flag_very_long(F.col("text")).alias("very_long"))


@query("char_count", "SELECT doc_id, length(text)::INT AS n FROM documents")
def char_count(spark, sf):
    return inp.widen(inp.table(spark, sf, "documents")).select("doc_id", tx.char_count(F.col("text")).alias("n"))


@query("token_count", f"WITH {inp.NOISY_DOCS} SELECT doc_id, {inp.sql_token_count('text')}::INT AS n FROM noisy_docs")
def token_count(spark, sf):
    return inp.noisy_docs(spark, sf).select("doc_id", tx.token_count(F.col("text")).alias("n"))


# -- stage C text rules ------------------------------------------------------------

def sql_garbage_ctes(source: str, key: str, cols: tuple[str, ...], out: str) -> str:
    """One CTE per indicator: cut at its first hit and trim, as the rule is worded."""
    parts, prev = [], source
    for i, p in enumerate(P.garbage_patterns):
        name = f"{out}{i}"
        cuts = ", ".join(
            f"CASE WHEN regexp_matches({c}, {quote(p)}, 'i') THEN "
            f"{inp.sql_strip(rep(c, f'(?:{p})(?s:.*)', '', 'i'))} ELSE {c} END AS {c}"
            for c in cols
        )
        parts.append(f"{name} AS (SELECT * EXCLUDE ({', '.join(cols)}), {cuts} FROM {prev})")
        prev = name
    parts.append(f"{out} AS (SELECT * FROM {prev})")
    return ",\n".join(parts)


def sql_contractions(x):
    for a, b in P.contractions:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return sql_spaces(x)


@query(
    "cut_at_garbage",
    f"WITH {inp.NOISY_PAIRS}, {sql_garbage_ctes('noisy_pairs', 'pair_id', ('src', 'tgt'), 'cut')} SELECT pair_id, src, tgt FROM cut",
)
def cut_at_garbage(spark, sf):
    p = inp.noisy_pairs(spark, sf)
    return p.select("pair_id", *[tx.cut_at_garbage(F.col(c), P).alias(c) for c in ("src", "tgt")])


@query("expand_contractions", f"WITH {inp.NOISY_PAIRS} SELECT pair_id, {sql_contractions('tgt')} AS tgt FROM noisy_pairs")
def expand_contractions(spark, sf):
    return inp.noisy_pairs(spark, sf).select("pair_id", tx.expand_contractions(F.col("tgt"), P).alias("tgt"))


# -- the whole chain ----------------------------------------------------------------

SQL_STEPS = (
    ("unicode_norm", sql_unicode),
    ("line_endings_norm", sql_line_endings),
    ("control_chars_removed", sql_control),
    ("html_unescaped", sql_unescape),
    ("html_tags_removed", sql_tags),
    ("urls_emails_paths_removed", sql_urls),
    ("markup_tokens_removed", sql_markup),
    ("typography_normalized", sql_typography),
    ("punct_collapsed", None),
    ("whitespace_collapsed", sql_spaces),
    ("very_long_line", None),
    ("apostrophe_fixed", sql_apostrophe),
    ("slash_fixed", sql_slash),
    ("universal_punct_fixed", sql_punct_spacing),
    ("html_entities_removed", sql_spaced_entities),
    ("opus_metadata_removed", sql_metadata),
    ("occitan_punct_fixed", sql_guillemets),
    ("number_separators_normalised", sql_numbers),
    ("time_units_normalised", sql_times),
    ("placeholder_spacing_fixed", sql_placeholders),
)


def chain_ctes(source: str, key: str, col: str, is_target: bool, out: str) -> str:
    """The chain as a stack of CTEs over (key, col), giving (key, clean, steps)."""
    parts = [f"{out}_0 AS MATERIALIZED (SELECT {key}, {col} AS raw, coalesce({col}, '') AS t, []::VARCHAR[] AS steps FROM {source})"]
    prev = f"{out}_0"
    for i, (name, rule) in enumerate(SQL_STEPS, 1):
        if name == "occitan_punct_fixed" and not is_target:
            continue
        cur = f"{out}_{i}"
        if name in cleaning.ALWAYS_LOGGED:
            parts.append(f"{cur} AS MATERIALIZED (SELECT {key}, raw, {rule('t')} AS t, list_append(steps, '{name}') AS steps FROM {prev})")
        elif name == "very_long_line":
            parts.append(
                f"{cur} AS MATERIALIZED (SELECT {key}, raw, t, CASE WHEN length(t) > 10000 THEN list_append(steps, '{name}') ELSE steps END AS steps FROM {prev})"
            )
        else:
            if name == "punct_collapsed":
                parts.append(f"{cur}_p AS MATERIALIZED (SELECT {key}, {sql_punct('t')} AS u FROM {prev})")
                parts.append(collapse_repeat_ctes(f"{cur}_p", key, "u", f"{cur}_q"))
                parts.append(f"{cur}_r AS MATERIALIZED (SELECT p.*, q.u AS t2 FROM {prev} p JOIN {cur}_q q ON p.{key} = q.{key})")
            else:
                parts.append(f"{cur}_r AS MATERIALIZED (SELECT *, {rule('t')} AS t2 FROM {prev})")
            parts.append(
                f"{cur} AS MATERIALIZED (SELECT {key}, raw, t2 AS t, CASE WHEN t2 <> t THEN list_append(steps, '{name}') ELSE steps END AS steps FROM {cur}_r)"
            )
        prev = cur
    parts.append(
        f"{out} AS (SELECT {key}, raw, t AS clean, array_to_string(CASE WHEN raw IS NULL THEN [] ELSE steps END, '|') AS steps FROM {prev})"
    )
    return ",\n".join(parts)


@query(
    "clean_text",
    f"WITH {inp.NOISY_DOCS}, {chain_ctes('noisy_docs', 'doc_id', 'text', True, 'c')} SELECT doc_id, clean FROM c",
)
def clean_text(spark, sf):
    out = cleaning.clean_text(inp.noisy_docs(spark, sf), "text", is_target=True)
    return out.select("doc_id", F.col("text_clean").alias("clean"))


@query(
    "step_list",
    f"WITH {inp.NOISY_DOCS}, {chain_ctes('noisy_docs', 'doc_id', 'text', False, 'c')} SELECT doc_id, steps FROM c",
)
def step_list(spark, sf):
    out = cleaning.clean_text(inp.noisy_docs(spark, sf), "text")
    return out.select("doc_id", F.array_join("text_steps", "|").alias("steps"))


CLEAN_PAIRS = f"""{inp.NOISY_PAIRS},
{chain_ctes('noisy_pairs', 'pair_id', 'src', False, 's')},
{chain_ctes('noisy_pairs', 'pair_id', 'tgt', True, 't')}"""


@query(
    "clean_pairs",
    f"""WITH {CLEAN_PAIRS}
SELECT s.pair_id, s.raw AS src, s.clean AS src_clean, s.steps AS src_steps, t.raw AS tgt, t.clean AS tgt_clean, t.steps AS tgt_steps,
  s.raw IS DISTINCT FROM s.clean OR t.raw IS DISTINCT FROM t.clean AS any_changes
FROM s JOIN t ON s.pair_id = t.pair_id""",
)
def clean_pairs(spark, sf):
    _, log = cleaning.clean_pairs(inp.noisy_pairs(spark, sf))
    return log.withColumns({c: F.array_join(c, "|") for c in ("src_steps", "tgt_steps")})


@query(
    "change_log_summary",
    f"""WITH {CLEAN_PAIRS},
u AS (SELECT 'src' AS side, unnest(string_split(steps, '|')) AS step FROM s UNION ALL SELECT 'tgt', unnest(string_split(steps, '|')) FROM t)
SELECT side, step, count(*) AS rows_changed FROM u GROUP BY ALL""",
)
def change_log_summary(spark, sf):
    _, log = cleaning.clean_pairs(inp.noisy_pairs(spark, sf))
    return cleaning.change_log_summary(log)


# -- scripts --------------------------------------------------------------------------

ALPHABETS = tuple(  # ten letters of each script, then two that change nothing
    "".join(map(chr, range(first, first + 10)))
    for first in (0x0430, 0x0627, 0x0905, 0x0B66, 0x1000, 0x05D0, ord("a"), ord("a"))
)


def scripts(spark, sf):
    d = inp.widen(inp.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    d = d.withColumn("alphabet", inp.pick(ALPHABETS, F.col("doc_id")))
    return d.select("doc_id", F.col("lang").alias("corpus"), F.expr("translate(text, 'abcdefghij', alphabet)").alias("text"))


def sql_script(x):
    return f"""CASE {' '.join(f"WHEN regexp_matches({x}, '[{chr(a)}-{chr(b)}]') THEN {quote(n)}" for n, a, b in SCRIPT_RANGES)} ELSE '{DEFAULT_SCRIPT}' END"""


SCRIPTS = f"""scripts AS (
  SELECT doc_id, lang AS corpus, translate(text, 'abcdefghij', {inp.sql_pick(ALPHABETS, 'doc_id')}) AS text FROM documents),
detected AS (SELECT *, {sql_script('text')} AS script FROM scripts)"""


@query("detect_script", f"WITH {SCRIPTS} SELECT doc_id, script FROM detected")
def detect_script(spark, sf):
    return catalog.with_script(scripts(spark, sf)).select("doc_id", "script")


MAJORITY = f"""{SCRIPTS},
majority AS (
  SELECT corpus, script FROM (SELECT corpus, script, row_number() OVER (PARTITION BY corpus ORDER BY count(*) DESC, script) AS rn
    FROM detected GROUP BY corpus, script) WHERE rn = 1)"""


@query("majority_script", f"WITH {MAJORITY} SELECT corpus, script FROM majority")
def majority_script(spark, sf):
    return catalog.majority_script(scripts(spark, sf))


@query("filter_script", f"WITH {SCRIPTS} SELECT doc_id, corpus, script FROM detected WHERE script = 'Latin'")
def filter_script(spark, sf):
    return catalog.filter_script(catalog.with_script(scripts(spark, sf))).select("doc_id", "corpus", "script")
