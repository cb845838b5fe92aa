"""Input frames that Spark and SQL derive in the same way from the given tables.

Every input covers all rows and the whole text of its table. Plain documents trigger few
of the rules, so a varying snippet is *appended*; nothing is cut.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsift.operators import langid, routing, scoring
from pairsift.profile import ENGLISH_OCCITAN
from pairsift.session import materialise, scratch_path
from pairsift.sources.corpus import read_table, widen

PAIR_STRIDE = 1 << 32  # more than the number of lines a document can have


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int") + 1)


def sql_pick(values, at: str) -> str:
    return f"({sql_list(values)})[(({at}) % {len(values)} + 1)::INT]"


# -- documents with a snippet that triggers one of the cleaning rules ----------

SNIPPETS = (
    "",
    " see https://a.b/c?d=1 now or www.x.org, and/or C:\\tmp\\x.txt",
    " mail a.b@c.org! or x-y_z@w.co.uk;",
    " caf&eacute; &lt;b&gt; &amp; &#233; x<script>var y</script>z<B>w</B>&foo;",
    "\r\nline\rtwo\ttab\x01\x02 bell\x07",
    " @info text [note] (x} {a [b]] @ title:menu",
    " ‘a’ “b” – — …\u00a0end",
    " x!!!!y ?!?!?! x...y ,,,,, aaaaaaaaaaaaa bbbbbbbbbb ------",
    " l ' ostal d'  aqui / ailà a ' b ' c",
    " hi !you ok ? yes ; no , so : 10 : 30 9 :05 8 h  late",
    " a & # 160 ; b & # 39 ; c & quot ; d & amp;",
    " 1.000 1.000.000 3,5 1,234,5 3.1415 2019 100",
    " use % 1 and & 2 or # 3 and 50 %",
    " « bonjorn » e «  adieu  » CityName flechaThis THISText",
    "\nCity name in Spain\nNAME OF TRANSLATORS x . kgm @ label y Widget name z",
    " e\u0301te\u0301 \ufeffbom \u2126 cafe\u0300 \u00a0\u2003 wide  gap ",
)


def noisy_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = widen(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return d.withColumn("text", F.concat("text", pick(SNIPPETS, F.col("doc_id"))))


NOISY_DOCS = f"noisy_docs AS (SELECT doc_id, text || {sql_pick(SNIPPETS, 'doc_id')} AS text, lang FROM documents)"


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    p = widen(table(spark, sf, "pages"))
    return p.select("page_id", F.concat_ws(" ", "html", "url").alias("text"))


PAGE_TEXTS = "page_texts AS (SELECT page_id, html || ' ' || url AS text FROM pages)"


# -- pairs: a line and the line after it, the last one with the first ----------

def line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = widen(table(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines")))
    following = F.concat(F.slice("lines", 2, F.size("lines")), F.slice("lines", 1, 1))
    both = F.arrays_zip(F.col("lines").alias("src"), following.alias("tgt"))
    return d.select("doc_id", "lang", F.posexplode(both).alias("k", "p")).select(
        (F.col("doc_id") * PAIR_STRIDE + F.col("k")).alias("pair_id"), "p.src", "p.tgt", "lang"
    )


LINE_PAIRS = f"""doc_lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
line_pairs AS (
  SELECT doc_id * {PAIR_STRIDE} + k AS pair_id, lines[k + 1] AS src, lines[(k + 1) % len(lines) + 1] AS tgt, lang
  FROM (SELECT doc_id, lang, lines, unnest(range(len(lines))) AS k FROM doc_lines))"""

# (source line or not, text after it, target line or not, text after it)
PAIR_NOISE = (
    (True, "", True, ""),
    (False, "12345 678 !!", True, ""),
    (False, "a", True, ""),
    (False, "hello", True, ""),
    (True, "", False, "1 2 3 4 5 6 7 8 9 b"),
    (True, " 日本", True, ""),
    (True, " \u00a0nbsp \u00ad", True, ""),
    (True, " — é", True, " ½ €"),
    (False, "abc d", False, "DCB a"),
    (False, "ab cd", False, "xabcdx y"),
    (False, "", True, ""),
    (False, "x y", True, " z"),
    (True, " the and with", True, " THE and with from"),
    (True, " Translators, please", True, " del rei l'ostal qu'ei aqueste"),
    (True, " ok", True, " http:x this string is meta Coptic month"),
    (False, " \t ", True, ""),
    (True, " 3.50 10:30", True, " 3,50 10h30"),
)


EXTRA = 1 << 31  # added to the id of the pair that an extra pair is made of


def noisy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line pair whole, with text after it; where a trigger replaces a side, it is an extra pair beside the whole one."""
    p = line_pairs(spark, sf)
    i = F.col("pair_id")
    whole = pick([n[0] and n[2] for n in PAIR_NOISE], i)

    def side(c: str, keep: int, suffix: int) -> Column:
        kept = pick([n[keep] for n in PAIR_NOISE], i)
        return F.concat(F.when(kept, F.col(c)).otherwise(""), pick([n[suffix] for n in PAIR_NOISE], i))

    made = F.struct((i + F.when(whole, 0).otherwise(EXTRA)).alias("pair_id"), side("src", 0, 1).alias("src"), side("tgt", 2, 3).alias("tgt"))
    return p.select(F.inline(F.when(whole, F.array(made)).otherwise(F.array(F.struct("pair_id", "src", "tgt"), made))))


def _sql_flags(flags) -> str:
    flags = ", ".join(str(x).lower() for x in flags)
    return f"([{flags}])[(pair_id % {len(PAIR_NOISE)} + 1)::INT]"


def _sql_side(c: str, keep: int, suffix: int) -> str:
    return f"(CASE WHEN {_sql_flags(n[keep] for n in PAIR_NOISE)} THEN {c} ELSE '' END) || {sql_pick([x[suffix] for x in PAIR_NOISE], 'pair_id')}"


_WHOLE = _sql_flags(n[0] and n[2] for n in PAIR_NOISE)
NOISY_PAIRS = f"""{LINE_PAIRS},
noisy_pairs AS (
  SELECT CASE WHEN {_WHOLE} THEN pair_id ELSE pair_id + {EXTRA} END AS pair_id, {_sql_side('src', 0, 1)} AS src, {_sql_side('tgt', 2, 3)} AS tgt FROM line_pairs
  UNION ALL SELECT pair_id, src, tgt FROM line_pairs WHERE NOT {_WHOLE})"""


# -- similarities, language labels, names --------------------------------------

def sims(spark: SparkSession, sf: str) -> DataFrame:
    """Vector 2i against 2i+1: one model is the first half of the dimensions, one the second."""
    from pairsift.functions.scores import cosine_similarity

    halves = vector_halves(spark, sf)
    return halves.select(
        "pair_idx",
        cosine_similarity(F.col("src_a"), F.col("tgt_a")).alias("sim_a"),
        cosine_similarity(F.col("src_b"), F.col("tgt_b")).alias("sim_b"),
    )


def vector_halves(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    half = e.select(
        F.floor(F.col("vec_id") / 2).alias("pair_idx"),
        (F.col("vec_id") % 2).alias("odd"),
        F.slice("embedding", 1, 32).alias("a"),
        F.slice("embedding", 33, 32).alias("b"),
    )
    left = half.where("odd = 0").select("pair_idx", F.col("a").alias("src_a"), F.col("b").alias("src_b"))
    right = half.where("odd = 1").select("pair_idx", F.col("a").alias("tgt_a"), F.col("b").alias("tgt_b"))
    return left.join(right, "pair_idx")


SIMS = """sims AS (
  SELECT l.vec_id // 2 AS pair_idx,
    list_cosine_similarity(l.embedding[1:32]::DOUBLE[], r.embedding[1:32]::DOUBLE[]) AS sim_a,
    list_cosine_similarity(l.embedding[33:64]::DOUBLE[], r.embedding[33:64]::DOUBLE[]) AS sim_b
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0)"""


def with_sims(pairs: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Give every pair one similarity row (many pairs share one, so there are ties).

    The similarities are found for the ids alone; the texts are shuffled once, by the id, which later joins by the id reuse.
    """
    s = sims(spark, sf)
    n = s.agg(F.count(F.lit(1)).alias("n")).scalar()
    ids = pairs.select("pair_id").distinct().withColumn("_n", n)  # each once: a repeated id stays as many rows as it is
    keyed = ids.withColumn("pair_idx", F.col("pair_id") % F.col("_n")).drop("_n")
    return pairs.join(keyed.join(s, "pair_idx").drop("pair_idx"), "pair_id")


def langpred(pairs: DataFrame) -> DataFrame:
    """Six labels with probabilities for every pair."""
    weight = ((F.col("pair_id") * 7 + F.col("i") * 13) % 97 + 1).cast("double")
    labels = F.array(*[F.lit(x) for x in LABELS])
    rows = pairs.select("pair_id", F.posexplode(labels).alias("i", "label")).withColumn("w", weight)
    total = sum(((F.col("pair_id") * 7 + i * 13) % 97 + 1 for i in range(1, len(LABELS))), (F.col("pair_id") * 7) % 97 + 1)
    return rows.select("pair_id", "label", (F.col("w") / total).alias("prob"))


LABELS = (
    "__label__oci_Latn", "__label__cat_Latn", "__label__fra_Latn",
    "__label__spa_Latn", "__label__eng_Latn", "__label__xxx_Zzzz",
)
LANG_NAMES = (("oci", "Occitan"), ("cat", "Catalan"), ("fra", "French"), ("spa", "Spanish"), ("eng", "English"))


def langpred_sql(pairs: str) -> str:
    return f"""langw AS (
  SELECT pair_id, i, ({sql_list(LABELS)})[i + 1] AS label, ((pair_id * 7 + i * 13) % 97 + 1)::DOUBLE AS w
  FROM {pairs}, (SELECT unnest(range({len(LABELS)})) AS i)),
langpred AS (SELECT pair_id, label, w / sum(w) OVER (PARTITION BY pair_id) AS prob FROM langw),
lang_names AS (SELECT * FROM (VALUES {", ".join(f"({quote(a)}, {quote(b)})" for a, b in LANG_NAMES)}) v(code, name))"""


# the token model is trained on the documents; its labels and their display names
MODEL_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
TARGET = replace(ENGLISH_OCCITAN, target_name="French")


def identifier(spark: SparkSession, sf: str) -> langid.Identifier:
    """A token model trained on the documents, saved and loaded again."""
    path = scratch_path(spark, "language-model")
    langid.save_model(langid.langid_train(widen(table(spark, sf, "documents")), "text", "lang"), path)
    return langid.Identifier(langid.load_model(spark, path), MODEL_NAMES)


def sql_model() -> str:
    """The token model of ``documents``: counts by label and token, priors, and the room for unseen tokens."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, lang AS label, unnest({sql_tokens('lower(text)')}) AS tok FROM documents),
counts AS MATERIALIZED (SELECT label, tok, count(*) AS n FROM toks GROUP BY ALL),
vocab AS (SELECT count(DISTINCT tok) AS v FROM counts),
label_sizes AS (SELECT label, sum(n) AS n_tokens FROM counts GROUP BY label),
label_docs AS (SELECT lang AS label, count(*) AS n_docs FROM documents GROUP BY lang),
known_labels AS (SELECT label, ln(n_docs / (SELECT count(*) FROM documents)::DOUBLE) AS prior, -ln((n_tokens + v)::DOUBLE) AS unseen
  FROM label_docs JOIN label_sizes USING (label), vocab)"""


def predicted_sql(pairs: str, gated: str) -> str:
    """(pair_id, name, prob) of the targets of ``pairs`` that hold ``gated``, by the token model."""
    names = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in MODEL_NAMES.items())
    return f"""{sql_model()},
asked AS MATERIALIZED (SELECT pair_id, {sql_tokens('lower(tgt)')} AS ts FROM {pairs} WHERE {gated}),
asked_toks AS (SELECT pair_id, unnest(ts) AS tok FROM asked),
asked_gains AS (SELECT t.pair_id, c.label, sum(ln((c.n + 1)::DOUBLE)) AS g FROM asked_toks t JOIN counts c ON c.tok = t.tok GROUP BY ALL),
logs AS (SELECT a.pair_id, l.label, prior + len(ts) * unseen + coalesce(g, 0) AS lp
  FROM asked a CROSS JOIN known_labels l LEFT JOIN asked_gains g ON g.pair_id = a.pair_id AND g.label = l.label),
powers AS (SELECT pair_id, label, exp(lp - max(lp) OVER (PARTITION BY pair_id)) AS e FROM logs),
predicted AS (SELECT pair_id, label, e / sum(e) OVER (PARTITION BY pair_id) AS prob FROM powers),
lang_scores AS (SELECT pair_id, name, prob FROM predicted JOIN (VALUES {names}) v(label, name) USING (label) WHERE prob >= 0.05)"""


def lang_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANG_NAMES), "code string, name string")


# -- usable pairs with everything the scores need -------------------------------

def tgt_prob(key: Column) -> Column:
    return ((key * 7) % 97 + 1) / 98.0


def scored_in(spark: SparkSession, sf: str) -> DataFrame:
    pairs = routing.with_token_counts(routing.with_lengths(line_pairs(spark, sf).drop("lang")))
    usable = pairs.where((F.col("src") != "") & (F.col("tgt") != ""))
    return with_sims(usable.withColumn("tgt_score", tgt_prob(F.col("pair_id"))), spark, sf)


WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def sql_token_count(x: str) -> str:
    return f"len({sql_tokens(x)})"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_solid(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


SCORED_IN = f"""{LINE_PAIRS}, {SIMS},
scored_in AS (
  SELECT p.pair_id, src, tgt, length(src) AS len_src, length(tgt) AS len_tgt,
    {sql_token_count('src')} AS tok_src, {sql_token_count('tgt')} AS tok_tgt,
    ((p.pair_id * 7) % 97 + 1) / 98.0 AS tgt_score, sim_a, sim_b
  FROM line_pairs p JOIN sims s ON s.pair_idx = p.pair_id % (SELECT count(*) FROM sims)
  WHERE src <> '' AND tgt <> '')"""


def scored_once(spark: SparkSession, sf: str) -> DataFrame:
    """Scored pairs for a reader that goes over them once."""
    return scoring.score_pairs(scored_in(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored pairs, written once: most users of it read it more than once."""
    return materialise(scored_once(spark, sf), "scored")


def pct_rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


SCORING_CTES = f"""stats AS (
  SELECT avg(sim_a) AS ma, greatest(stddev_samp(sim_a), 1e-6) AS sa, avg(sim_b) AS mb, greatest(stddev_samp(sim_b), 1e-6) AS sb
  FROM scored_in),
ranked AS (
  SELECT *, {pct_rank_sql('sim_a')} AS sim_a_rank, {pct_rank_sql('sim_b')} AS sim_b_rank,
    {pct_rank_sql('least(sim_a, sim_b)')} AS rmin, {pct_rank_sql('greatest(sim_a, sim_b)')} AS rmax,
    0.6 * (tok_tgt + 1) / (tok_src + 1) + 0.4 * (len_tgt + 1) / (len_src + 1) AS lr,
    least(greatest(tgt_score, 1e-6), 1 - 1e-6) AS p, 1 - exp(-tok_tgt / 12.0) AS w
  FROM scored_in),
parts AS (
  SELECT ranked.*, (sim_a_rank + sim_b_rank) / 2 AS combined_rank, 0.7 * rmin + 0.3 * rmax AS sim_rank,
    (1 - w) * 0.5 + w * (1 / (1 + exp(-(ln(p / (1 - p)) / 0.8)))) AS lang_prob_score,
    exp(-1.5 * abs(ln(lr))) AS length_score,
    least(1 / (1 + exp(-((sim_a - ma) / sa))), 1 / (1 + exp(-((sim_b - mb) / sb)))) AS min_embedding_score
  FROM ranked, stats),
scored AS (
  SELECT *, 0.35 * lang_prob_score + 0.30 * length_score + 0.25 * sim_rank + 0.10 * min_embedding_score AS score,
    (lr < 0.40 OR lr > 2.00) AND min_embedding_score < 0.75 AS veto
  FROM parts)"""
SCORED = f"{SCORED_IN},\n{SCORING_CTES}"


# -- generations and logits ------------------------------------------------------

PROMPT_HEAD, PROMPT_TAIL = "Translate English to Occitan: ", " -> "


def generations(spark: SparkSession, sf: str) -> DataFrame:
    p = line_pairs(spark, sf).drop("lang")
    i = F.col("pair_id")
    extra = F.concat(
        F.when(i % 20 == 10, " Monday").otherwise(""),
        F.when(i % 10 == 7, " 24").otherwise(""),
        F.when(i % 30 == 4, " inkjet season 10:30").otherwise(""),
    )
    p = p.withColumn("src", F.concat("src", extra)).withColumn("gold", F.col("tgt")).drop("tgt")
    g, r = F.col("gold"), i % 10
    raw = (
        F.when(r == 0, g)
        .when(r == 1, F.concat(F.lit(PROMPT_HEAD), "src", F.lit(PROMPT_TAIL), g))
        .when(r == 2, "")
        .when(r == 3, F.col("src"))
        .when(r == 4, F.concat(g, F.lit(" laser jornada 11h30\nextra line")))
        .when(r == 5, "!!! ??")
        .when(r == 6, F.concat(g, F.lit(" 😀")))
        .when(r == 7, F.concat(g, F.lit(" 42")))
        .when(r == 8, F.concat(F.lit("  "), g, F.lit(" .,;:")))
        .otherwise(F.substring(g, F.lit(1), F.floor(F.length(g) / 2).cast("int")))
    )
    return p.withColumn("raw", raw).withColumn("system", (i % 3).cast("int"))


GENERATIONS = f"""{LINE_PAIRS},
gen_src AS (
  SELECT pair_id, tgt AS gold, src
    || CASE WHEN pair_id % 20 = 10 THEN ' Monday' ELSE '' END
    || CASE WHEN pair_id % 10 = 7 THEN ' 24' ELSE '' END
    || CASE WHEN pair_id % 30 = 4 THEN ' inkjet season 10:30' ELSE '' END AS src
  FROM line_pairs),
generations AS (
  SELECT pair_id, src, gold, CASE pair_id % 10 WHEN 0 THEN gold WHEN 1 THEN '{PROMPT_HEAD}' || src || '{PROMPT_TAIL}' || gold
    WHEN 2 THEN '' WHEN 3 THEN src WHEN 4 THEN gold || ' laser jornada 11h30' || chr(10) || 'extra line' WHEN 5 THEN '!!! ??'
    WHEN 6 THEN gold || ' 😀' WHEN 7 THEN gold || ' 42' WHEN 8 THEN '  ' || gold || ' .,;:'
    ELSE substr(gold, 1, length(gold) // 2) END AS raw, (pair_id % 3)::INT AS system
  FROM gen_src)"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pos = (F.col("vec_id") % 8).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 8).alias("sent_id"),
        pos.alias("pos"),
        F.transform("embedding", lambda v: v.cast("double") * 10).alias("logits"),
        F.when(pos < 2, -100).otherwise(F.col("label")).alias("gold"),
    )


LOGITS = """logits AS (
  SELECT vec_id // 8 AS sent_id, (vec_id % 8)::INT AS pos, list_transform(embedding, lambda v: v::DOUBLE * 10) AS logits,
    CASE WHEN vec_id % 8 < 2 THEN -100 ELSE label END AS gold
  FROM embeddings)"""
