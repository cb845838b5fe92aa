"""Sources, sinks, alignment, catalogue, and training-example tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsift.functions import examples as ex
from pairsift.operators import aligning, catalog, cleaning, distill, examples, ordering, select
from pairsift.plans import curate
from pairsift.profile import ENGLISH_OCCITAN as P
from pairsift.registry import inputs as inp
from pairsift.registry.core import query
from pairsift.registry.cleaning import ALPHABETS, chain_ctes, sql_script
from pairsift.registry.pairs import GATE, ROUTED, sql_anagram, sql_indicators, stage_c_ctes
from pairsift.registry.scoring import PARTS, r6, sql_r6
from pairsift.session import scratch_path
from pairsift.sources import corpus
from pairsift.streaming import clean_stream as cs

LP = inp.LINE_PAIRS
PAIRS = f"WITH {LP} SELECT pair_id, src, tgt FROM line_pairs"


def as_struct(df):
    return df.select("pair_id", F.struct(F.col("src").alias("en"), F.col("tgt").alias("oc")).alias("translation"))


@query("load_pairs", PAIRS)
def load_pairs(spark, sf):
    """Writes the pairs in the corpus layout and loads them back."""
    path = scratch_path(spark, "split")
    as_struct(inp.line_pairs(spark, sf)).write.parquet(path)
    return corpus.load_pairs(spark, path)


@query("from_struct", PAIRS)
def from_struct(spark, sf):
    return corpus.from_struct(as_struct(inp.line_pairs(spark, sf)), "en", "oc")


@query("from_records", f"WITH {LP} SELECT pair_id, src, tgt, 'en-' || lang AS config FROM line_pairs")
def from_records(spark, sf):
    """All pairs with their corpus, by a table of one row for each language that is made of local records (the operator is for small local data)."""
    langs = [r["lang"] for r in inp.table(spark, sf, "documents").select("lang").where("lang IS NOT NULL").distinct().collect()]
    known = corpus.from_records(spark, [{"lang": x, "config": f"en-{x}"} for x in langs], "lang string, config string")
    return inp.line_pairs(spark, sf).join(known, "lang", "left").select("pair_id", "src", "tgt", "config")


@query("sink_scored", f"WITH {inp.SCORED} SELECT pair_id, src, tgt, {sql_r6(*PARTS)}, veto FROM scored")
def sink_scored(spark, sf):
    path = scratch_path(spark, "scored")
    corpus.sink_scored(inp.scored_once(spark, sf), path, compression="zstd")  # beside the shuffled texts that it is written from
    return corpus.read_table(spark, path).select("pair_id", "src", "tgt", *r6(*PARTS), "veto")


@query("sink_clean_log", PAIRS)
def sink_clean_log(spark, sf):
    """Writes both tables and reads the originals back from the log."""
    cleaned, log = cleaning.clean_pairs(inp.line_pairs(spark, sf).drop("lang"))
    paths = scratch_path(spark, "cleaned"), scratch_path(spark, "log")
    corpus.sink_clean_log(cleaned, log, *paths)
    both = corpus.read_table(spark, paths[1]).join(corpus.read_table(spark, paths[0]).select("pair_id"), "pair_id")
    return both.select("pair_id", "src", "tgt")


# -- alignment ---------------------------------------------------------------------

ZIPPED = """mono AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sent_id FROM documents),
zipped AS (SELECT e.sent_id, e.text AS src, f.text AS tgt FROM mono e JOIN mono f ON f.sent_id = e.sent_id AND e.lang = 'en' AND f.lang = 'fr')"""


@query("zip_parallel", f"WITH {ZIPPED} SELECT sent_id, src, tgt FROM zipped")
def zip_parallel(spark, sf):
    d = inp.table(spark, sf, "documents").select("doc_id", "text", "lang")
    sides = [d.where(F.col("lang") == c).drop("lang") for c in ("en", "fr")]
    return aligning.zip_parallel(*sides, order_by=["doc_id"])


@query("load_monolingual_pair", f"WITH {ZIPPED} SELECT sent_id, src, tgt FROM zipped")
def load_monolingual_pair(spark, sf):
    """Writes the texts of two languages in order, without ids, and pairs them by their place in the files."""
    d, paths = inp.table(spark, sf, "documents"), [scratch_path(spark, f"mono-{c}") for c in ("en", "fr")]
    for c, path in zip(("en", "fr"), paths, strict=True):
        d.where(F.col("lang") == c).select("doc_id", "text").orderBy("doc_id").drop("doc_id").write.parquet(path)
    return corpus.load_monolingual_pair(spark, *paths, sent_id=None)


@query(
    "zip_hyp_ref",
    f"WITH {inp.GENERATIONS} SELECT pair_id, src, gold, raw FROM generations",
)
def zip_hyp_ref(spark, sf):
    g = inp.generations(spark, sf)
    return aligning.zip_hyp_ref(g.select("pair_id", "src"), g.select("pair_id", "gold"), g.select("pair_id", "raw"))


@query("unmatched_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_ids(spark, sf):
    return aligning.unmatched(inp.table(spark, sf, "documents"), inp.table(spark, sf, "labels"), "doc_id")


@query("lookup_language_name", f"""WITH {LP}, {inp.langpred_sql('line_pairs')},
codes AS (SELECT pair_id, regexp_extract(label, '__label__([^_]*)', 1) AS code FROM langpred)
SELECT pair_id, c.code, coalesce(n.name, c.code) AS name FROM codes c LEFT JOIN lang_names n ON n.code = c.code""")
def lookup_language_name(spark, sf):
    from pairsift.operators.langid import bare_code

    preds = inp.langpred(inp.line_pairs(spark, sf)).select("pair_id", bare_code(F.col("label")).alias("code"))
    return aligning.lookup_language_name(preds, inp.lang_names(spark))


# -- catalogue ------------------------------------------------------------------------

CATALOG = """cat_rows AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'de' ELSE 'en' END || '-' || lang AS config FROM documents),
cat_names AS (SELECT * FROM (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German')) v(code, name)),
catalog AS (SELECT config, num_examples, coalesce(s.name, split_part(config, '-', 1)) AS source, coalesce(t.name, split_part(config, '-', 2)) AS target
  FROM (SELECT config, count(*) AS num_examples FROM cat_rows WHERE config LIKE 'en%' GROUP BY config HAVING count(*) < {limit}) c
  LEFT JOIN cat_names s ON s.code = split_part(config, '-', 1) LEFT JOIN cat_names t ON t.code = split_part(config, '-', 2))"""
CATALOG_NAMES = [("en", "English"), ("fr", "French"), ("de", "German")]


def _catalog(spark, sf, limit):
    config = F.concat(F.when(F.col("doc_id") % 5 == 0, "de").otherwise("en"), F.lit("-"), "lang")
    names = spark.createDataFrame(CATALOG_NAMES, "code string, name string")
    return catalog.corpus_catalog(inp.table(spark, sf, "documents").select(config.alias("config")), names, limit)


@query("corpus_catalog", f"WITH {CATALOG.format(limit=100000)} SELECT * FROM catalog")
def corpus_catalog(spark, sf):
    return _catalog(spark, sf, catalog.FEWER_THAN)


@query("order_catalog", f"WITH {CATALOG.format(limit=100000)} SELECT * FROM catalog ORDER BY num_examples DESC, config")
def order_catalog(spark, sf):
    return _catalog(spark, sf, catalog.FEWER_THAN)


# twelve corpora for each language, two thirds of their rows in one alphabet; all documents
MANY_CORPORA = f"""many AS (SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN 'de' ELSE 'en' END || '-' || lang || '-' || doc_id % 12 AS config,
  CASE WHEN doc_id // 12 % 3 = 0 THEN text ELSE translate(text, 'abcdefghij', {inp.sql_pick(ALPHABETS, 'doc_id % 12')}) END AS text FROM documents)"""
CANDIDATES = f"""{MANY_CORPORA},
heads AS (SELECT * FROM many QUALIFY row_number() OVER (PARTITION BY config ORDER BY doc_id) <= 10),
named AS (SELECT config, {sql_script('text')} AS script FROM heads),
majority AS (SELECT config, script FROM (SELECT config, script, row_number() OVER (PARTITION BY config ORDER BY count(*) DESC, script) AS rn FROM named GROUP BY config, script) WHERE rn = 1),
sizes AS (SELECT config, count(*) AS num_examples FROM many WHERE config LIKE 'en%' GROUP BY config HAVING count(*) < 100000),
cat_names AS (SELECT * FROM (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German')) v(code, name))"""


@query(
    "candidate_corpora",
    f"""WITH {CANDIDATES} SELECT config, num_examples, coalesce(s.name, split_part(config, '-', 1)) AS source, coalesce(t.name, split_part(config, '-', 2)) AS target, script
FROM sizes JOIN majority USING (config) LEFT JOIN cat_names s ON s.code = split_part(config, '-', 1) LEFT JOIN cat_names t ON t.code = split_part(config, '-', 2)
WHERE script = 'Latin' ORDER BY num_examples DESC, config""",
)
def candidate_corpora(spark, sf):
    d = inp.table(spark, sf, "documents").select("doc_id", "lang", "text").withColumn("region", F.col("doc_id") % 12)
    d = d.withColumn("alphabet", inp.pick(ALPHABETS, F.col("region")))
    config = F.concat(F.when(F.col("region") == 5, "de").otherwise("en"), F.lit("-"), "lang", F.lit("-"), "region")
    text = F.when(F.floor(F.col("doc_id") / 12) % 3 == 0, F.col("text")).otherwise(F.expr("translate(text, 'abcdefghij', alphabet)"))
    names = spark.createDataFrame(CATALOG_NAMES, "code string, name string")
    return catalog.candidate_corpora(d.select("doc_id", config.alias("config"), text.alias("text")), names, ["doc_id"])


# -- splits ------------------------------------------------------------------------------

SPLIT = "CASE pair_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END"


@query("union_splits", f"WITH {LP} SELECT {SPLIT} AS split, pair_id, src, tgt FROM line_pairs")
def union_splits(spark, sf):
    p, r = inp.line_pairs(spark, sf).drop("lang"), F.col("pair_id") % 10
    return select.union_splits(train=p.where(r < 8), validation=p.where(r == 8), test=p.where(r == 9))


@query(
    "build_distill_eval_sets",
    f"""WITH {LP}, dev AS (SELECT * FROM line_pairs WHERE lang <> 'en'),
devtest AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS rn FROM line_pairs WHERE lang = 'en')
SELECT 'distill dev' AS part, pair_id, src, tgt FROM dev UNION ALL
SELECT 'distill devtest', pair_id, src, tgt FROM devtest WHERE rn <= 503 UNION ALL
SELECT 'eval', pair_id, src, tgt FROM devtest WHERE rn > 503 AND rn <= 1003""",
)
def build_distill_eval_sets(spark, sf):
    p = inp.line_pairs(spark, sf)
    dev, devtest = p.where("lang <> 'en'").drop("lang"), p.where("lang = 'en'").drop("lang")
    distill_set, eval_set = select.build_distill_eval_sets(dev, devtest, "pair_id")
    a = distill_set.select(F.concat(F.lit("distill "), "split").alias("part"), "pair_id", "src", "tgt")
    return a.unionByName(eval_set.select(F.lit("eval").alias("part"), "pair_id", "src", "tgt"))


# -- training examples ---------------------------------------------------------------------

def sql_ids(x):
    return f"list_transform(string_split({x}, ''), lambda c: unicode(c))"


FULL = f"""{LP},
ex AS (SELECT pair_id, '{inp.PROMPT_HEAD}' || src || '{inp.PROMPT_TAIL}' AS prompt,
  '{inp.PROMPT_HEAD}' || src || '{inp.PROMPT_TAIL}' || tgt || '{P.end_marker}' AS full_text FROM line_pairs)"""
IDS = f"""{FULL},
ids AS (SELECT pair_id, {sql_ids('full_text')}[1:256] AS input_ids, length(prompt) AS n_prompt FROM ex),
labelled AS (SELECT *, CASE WHEN n_prompt > 256 THEN list_transform(input_ids, lambda x: -100)
  ELSE list_concat(list_transform(range(least(n_prompt, len(input_ids))), lambda x: -100), input_ids[n_prompt + 1:]) END AS labels FROM ids)"""


def joined(*cols):
    return [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in cols]


def sql_joined(*cols):
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in cols)


@query("build_prompt", f"WITH {FULL} SELECT pair_id, prompt, '>>oci<< ' || src AS prompt_seq2seq FROM ex JOIN line_pairs USING (pair_id)")
def build_prompt(spark, sf):
    from pairsift.functions.generation import build_prompt as build

    return inp.line_pairs(spark, sf).select(
        "pair_id", build(F.col("src"), P.causal_prompt).alias("prompt"), build(F.col("src"), P.seq2seq_prompt).alias("prompt_seq2seq")
    )


@query("build_examples", f"WITH {FULL} SELECT pair_id, prompt, full_text FROM ex")
def build_examples(spark, sf):
    return examples.build_examples(inp.line_pairs(spark, sf)).select("pair_id", "prompt", F.col("full").alias("full_text"))


@query("tokenize_column", f"WITH {IDS} SELECT pair_id, {sql_joined('input_ids')} FROM ids")
def tokenize_column(spark, sf):
    return examples.tokenize_pairs(inp.line_pairs(spark, sf)).select("pair_id", *joined("input_ids"))


@query("mask_labels", f"WITH {IDS} SELECT pair_id, {sql_joined('labels')} FROM labelled")
def mask_labels(spark, sf):
    return examples.tokenize_pairs(inp.line_pairs(spark, sf)).select("pair_id", *joined("labels"))


@query(
    "tokenize_two_ways",
    f"""WITH {IDS}, idx AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS idx FROM line_pairs),
bytes AS (SELECT pair_id, list_transform(regexp_extract_all(hex(encode(full_text)), '..'), lambda h: ('0x' || h)::INT)[1:256] AS student_ids FROM ex)
SELECT idx, array_to_string(input_ids, ',') AS teacher_ids, array_to_string(student_ids, ',') AS student_ids
FROM idx JOIN ids USING (pair_id) JOIN bytes USING (pair_id)""",
)
def tokenize_two_ways(spark, sf):
    teacher, student = examples.tokenize_two_ways(inp.line_pairs(spark, sf).drop("lang"), ["pair_id"])
    t = teacher.select("idx", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("teacher_ids"))
    return t.join(student.select("idx", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("student_ids")), "idx")


@query(
    "pad_batches",
    f"""WITH {IDS}, n AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS idx FROM labelled),
b AS (SELECT *, idx // 8 AS batch_id, (ceil(max(len(input_ids)) OVER (PARTITION BY idx // 8) / 8.0) * 8)::INT AS width FROM n)
SELECT idx, batch_id, width,
  array_to_string(list_concat(list_transform(range(width - len(input_ids)), lambda x: 0), input_ids), ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(width - len(input_ids)), lambda x: 0), list_transform(input_ids, lambda x: 1)), ',') AS attention_mask,
  array_to_string(list_concat(list_transform(range(width - len(labels)), lambda x: -100), labels), ',') AS labels FROM b""",
)
def pad_batches(spark, sf):
    indexed = ordering.add_row_index(inp.line_pairs(spark, sf).drop("lang"), ["pair_id"])
    out = examples.pad_batches(examples.tokenize_pairs(indexed))
    return out.select("idx", "batch_id", "width", *joined("input_ids", "attention_mask", "labels"))


# -- distillation weights ------------------------------------------------------------------

LOG_PROB = f"""{inp.LOGITS},
z AS (SELECT sent_id, pos, gold, list_transform(logits, lambda v: v / 2.0) AS z, logits FROM logits),
lp AS (SELECT sent_id, pos, CASE WHEN gold <> -100 THEN greatest(
    z[gold + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))), ln(1e-8)) END AS log_prob,
  CASE WHEN gold <> -100 THEN -(logits[gold + 1] - list_max(logits) - ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))))) END AS ce FROM z),
conf AS (SELECT sent_id, least(greatest(1 / (1 + exp(-(coalesce(sum(log_prob), 0) / greatest(count(log_prob), 1)))), 0.2), 1.0) AS sent_weight FROM lp GROUP BY sent_id)"""


@query("token_log_prob", f"WITH {LOG_PROB} SELECT sent_id, pos, {sql_r6('log_prob')} FROM lp")
def token_log_prob(spark, sf):
    return distill.token_log_prob(inp.logits(spark, sf)).select("sent_id", "pos", *r6("log_prob"))


@query(
    "shift_gold",
    f"WITH {inp.LOGITS} SELECT a.sent_id, a.pos, b.gold FROM logits a JOIN logits b ON a.sent_id = b.sent_id AND b.pos = a.pos + 1",
)
def shift_gold(spark, sf):
    table = inp.logits(spark, sf).withColumnRenamed("gold", "label")
    return distill.shift_gold(table).select("sent_id", "pos", "gold")


def _weights(spark, sf):
    return distill.teacher_confidence(distill.token_log_prob(inp.logits(spark, sf)))


@query("teacher_confidence", f"WITH {LOG_PROB} SELECT sent_id, {sql_r6('sent_weight')} FROM conf")
def teacher_confidence(spark, sf):
    return _weights(spark, sf).select("sent_id", *r6("sent_weight"))


@query(
    "weighted_ce_loss",
    f"""WITH {LOG_PROB}, s AS (SELECT sent_id, coalesce(sum(ce), 0) / greatest(count(ce), 1) AS loss FROM lp GROUP BY sent_id)
SELECT round(avg(loss * sent_weight), 6) AS loss FROM s JOIN conf USING (sent_id)""",
)
def weighted_ce_loss(spark, sf):
    ce = distill.token_cross_entropy(inp.logits(spark, sf))
    return distill.weighted_ce_loss(ce, _weights(spark, sf)).select(*r6("loss"))


@query(
    "attach_weights",
    f"WITH {LOG_PROB} SELECT vec_id // 8 AS idx, vec_id, round(sent_weight, 6) AS sent_weight FROM embeddings JOIN conf ON sent_id = vec_id // 8",
)
def attach_weights(spark, sf):
    rows = inp.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("idx"), "vec_id")
    out = aligning.attach_weights(rows, _weights(spark, sf).withColumnRenamed("sent_id", "idx"))
    return out.select("idx", "vec_id", *r6("sent_weight"))


@query("combine_weights", f"WITH {LOG_PROB} SELECT sent_id, round(least(greatest(sent_weight * ((sent_id % 10) / 10.0), 0.05), 1.0), 6) AS combined_weight FROM conf")
def combine_weights(spark, sf):
    w = _weights(spark, sf).withColumn("ensemble_weight", (F.col("sent_id") % 10) / 10.0)
    return distill.combine_weights(w).select("sent_id", *r6("combined_weight"))


# -- streaming -----------------------------------------------------------------------------

def _stream_input(spark, sf):
    """The noisy pairs as a folder of files with an arrival time."""
    path = scratch_path(spark, "arrivals")
    stamped = inp.noisy_pairs(spark, sf).withColumn("arrived", F.timestamp_seconds(F.col("pair_id") % 1000 + 1_700_000_000))
    stamped.write.parquet(path)
    return spark.readStream.schema(stamped.schema).parquet(path)


USABLE = f"""{ROUTED},
main_rows AS MATERIALIZED (SELECT pair_id, src, tgt FROM routed WHERE NOT is_discarded AND NOT is_single),
{chain_ctes('main_rows', 'pair_id', 'src', False, 's')},
{chain_ctes('main_rows', 'pair_id', 'tgt', True, 't')},
cleaned AS MATERIALIZED (SELECT s.pair_id, s.clean AS src, t.clean AS tgt FROM s JOIN t ON s.pair_id = t.pair_id),
{stage_c_ctes('cleaned', 'usable')}"""
USABLE_SQL = f"WITH {USABLE} SELECT pair_id, src, tgt, len_src, len_tgt, tok_src, tok_tgt FROM usable"


@query("usable_pairs", USABLE_SQL)
def usable_pairs(spark, sf):
    return curate.usable_pairs(inp.noisy_pairs(spark, sf))


CURATED = f"""{USABLE},
uniq AS MATERIALIZED (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pair_id) = 1),
{inp.predicted_sql('uniq', GATE)},
final AS MATERIALIZED (SELECT u.*, s.prob AS tgt_score FROM uniq u JOIN lang_scores s ON s.pair_id = u.pair_id AND s.name = {inp.quote(inp.TARGET.target_name)}
  WHERE {GATE} AND NOT ({sql_anagram()}) AND {sql_indicators('tgt')} < 2),
{inp.SIMS},
scored_in AS (SELECT p.*, sim_a, sim_b FROM final p JOIN sims s ON s.pair_idx = p.pair_id % (SELECT count(*) FROM sims)),
{inp.SCORING_CTES}"""


@query("curate", f"WITH {CURATED} SELECT pair_id, src, tgt, {sql_r6(*PARTS)}, veto FROM scored")
def curated(spark, sf):
    """The whole curation: route, clean, filter, dedup, language, similarity, score."""
    pairs = inp.noisy_pairs(spark, sf)
    sims = inp.with_sims(pairs.select("pair_id"), spark, sf)
    return curate.curate(pairs, inp.identifier(spark, sf), sims, inp.TARGET).select("pair_id", "src", "tgt", *r6(*PARTS), "veto")


@query(
    "clean_stream",
    f"""WITH {USABLE} SELECT pair_id, src, tgt, len_src, len_tgt, tok_src, tok_tgt FROM usable
QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pair_id, src) = 1""",
)
def clean_stream(spark, sf):
    """All pairs arrive within the delay, in one micro-batch: the first of each target text is the one with the least id."""
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    cs.run_available(cs.clean_stream(_stream_input(spark, sf), "arrived"), out, checkpoint)
    return spark.read.parquet(out).drop("arrived")


@query("dedup_stream", f"WITH {inp.NOISY_PAIRS} SELECT DISTINCT tgt FROM noisy_pairs")
def dedup_stream(spark, sf):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    cs.run_available(cs.dedup_stream(_stream_input(spark, sf), "arrived"), out, checkpoint)
    return spark.read.parquet(out).select("tgt")
