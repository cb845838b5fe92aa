"""Corpus BLEU and chrF for any number of systems in one job.

The n-grams of a row are counted where it is; only the sums per system are shuffled, combined on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsift.functions import flags as fl
from pairsift.functions import text as tx
from pairsift.functions.char_ngrams import char_overlap, word_overlap
from pairsift.operators.fence import where_computed

BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2
SUMS = ("hyp", "hyp_with_ref", "ref", "match")


def tokenize_13a(x: Column) -> Column:
    """Public mteval-v13a tokenisation, as an array of tokens."""
    y = tx.strip(x)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        y = F.replace(y, F.lit(old), F.lit(new))
    y = F.concat(F.lit(" "), y, F.lit(" "))
    y = F.regexp_replace(y, r"([\{-~\[-` -&\(-\+:-@/])", " $1 ")
    y = F.regexp_replace(y, r"([^0-9])([.,])", "$1 $2 ")
    y = F.regexp_replace(y, r"([.,])([^0-9])", " $1 $2")
    y = F.regexp_replace(y, r"([0-9])(-)", "$1 $2 ")
    return tx.tokens(y)


def _overlap_sums(counts: str, order: int) -> list[Column]:
    """Corpus sums of an array of (hyp, ref, match) per order; n-grams of a hypothesis whose reference has none
    of that order are also given separately."""
    sums = []
    for n in range(1, order + 1):
        h, r, m = (F.get(counts, F.lit(3 * (n - 1) + k)) for k in range(3))
        with_ref = F.sum(F.when(r > 0, h).otherwise(0))
        for name, total in zip(SUMS, (F.sum(h), with_ref, F.sum(r), F.sum(m)), strict=True):
            sums.append(F.coalesce(total, F.lit(0)).alias(f"{name}{n}"))
    return sums


def _counted(df: DataFrame, system: str | None, **counts: Column) -> DataFrame:
    return df.select(*([system] if system else []), *[c.alias(k) for k, c in counts.items()])


def _penalty() -> Column:
    return F.when(F.col("hyp1") > 0, F.least(F.lit(1.0), F.exp(1.0 - F.try_divide("ref1", "hyp1")))).otherwise(0.0)


def _bleu(order: int) -> Column:
    """Exponential smoothing of zero counts, brevity penalty, times 100."""
    logs, zeros = [], F.lit(0)
    for n in range(1, order + 1):
        match, total = F.col(f"match{n}").cast("double"), F.col(f"hyp{n}")
        zeros = zeros + (match == 0).cast("int")
        shown = F.when(match > 0, match).otherwise(F.pow(F.lit(2.0), -zeros))
        logs.append(F.ln(F.try_divide(shown, total)))
    any_match = reduce(lambda a, b: a | b, [F.col(f"match{n}") > 0 for n in range(1, order + 1)])
    every_order = F.col(f"hyp{order}") > 0
    mean = reduce(lambda a, b: a + b, logs) / order
    return F.when(any_match & every_order, 100.0 * _penalty() * F.exp(mean)).otherwise(0.0)


def _words(hyp: str, ref: str, tokenizer) -> Column:
    return word_overlap(tokenizer(F.col(hyp)), tokenizer(F.col(ref)), BLEU_ORDER)


def corpus_bleu(df: DataFrame, system: str | None = None, hyp: str = "hyp", ref: str = "gold", tokenizer=tokenize_13a) -> DataFrame:
    """Every row is a sentence, whatever its id; null texts are empty."""
    groups = [system] if system else []
    row = _counted(df, system, w=_words(hyp, ref, tokenizer)).groupBy(*groups).agg(*_overlap_sums("w", BLEU_ORDER))
    return row.select(*groups, _bleu(BLEU_ORDER).alias("bleu"))


def _chrf(order: int, beta: int) -> Column:
    """Mean precision and recall over the orders both sides have, then F-beta, times 100."""
    orders = range(1, order + 1)
    usable = [(F.col(f"hyp_with_ref{n}") > 0) & (F.col(f"ref{n}") > 0) for n in orders]
    n_usable = reduce(lambda a, b: a + b, [u.cast("int") for u in usable])

    def mean(of: str) -> Column:
        parts = [
            F.when(u, F.col(f"match{n}") / F.nullif(F.col(f"{of}{n}"), F.lit(0))).otherwise(0.0) for n, u in zip(orders, usable)
        ]
        return F.try_divide(reduce(lambda a, b: a + b, parts), n_usable)

    p, r, b2 = mean("hyp_with_ref"), mean("ref"), beta * beta
    return F.coalesce(100.0 * F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))


def corpus_chrf(df: DataFrame, system: str | None = None, hyp: str = "hyp", ref: str = "gold") -> DataFrame:
    groups = [system] if system else []
    counted = _counted(df, system, c=char_overlap(F.col(hyp), F.col(ref), CHRF_ORDER))
    return counted.groupBy(*groups).agg(*_overlap_sums("c", CHRF_ORDER)).select(*groups, _chrf(CHRF_ORDER, CHRF_BETA).alias("chrf"))


def score_systems(df: DataFrame, system: str = "system", hyp: str = "hyp", ref: str = "gold", tokenizer=tokenize_13a) -> DataFrame:
    """BLEU and chrF of every system in one pass, with BLEU's components: precisions in percent, penalty, lengths."""
    return _system_scores(_system_sums(df, [F.col(system).alias(system)], hyp, ref, tokenizer), system)


def score_variants(df: DataFrame, system: str = "system", hyp: str = "hyp", ref: str = "gold", tokenizer=tokenize_13a, label: str = "label") -> DataFrame:
    """``score_systems`` of every system as generated, with degenerate output blanked, and without it, as ``label``.

    The n-grams of a row are counted once. A blanked output has no n-grams and leaves those of its reference, so the three variants
    are made of the sums of the degenerate and of the other rows.
    """
    parts = _system_sums(df, [F.col(system).alias("system"), fl.is_degenerate(F.col(hyp)).alias("degenerate")], hyp, ref, tokenizer)

    def blanked(sums: str, order: int) -> Column:
        names = [f"{name}{n}" for n in range(1, order + 1) for name in SUMS]
        of = F.col(sums)
        return F.struct(*[(of[x] if x.startswith("ref") else F.when(F.col("degenerate"), F.lit(0)).otherwise(of[x])).cast("long").alias(x) for x in names])

    made = [
        F.struct(F.lit("as generated").alias("variant"), "w", "c"),
        F.struct(F.lit("degenerate blanked").alias("variant"), blanked("w", BLEU_ORDER).alias("w"), blanked("c", CHRF_ORDER).alias("c")),
        F.when(~F.col("degenerate"), F.struct(F.lit("degenerate removed").alias("variant"), "w", "c")),
    ]
    variants = parts.select("system", F.explode(F.array(*made)).alias("v")).where("v IS NOT NULL").select("system", "v.*")
    labelled = variants.select(F.concat_ws(" / ", F.col("system").cast("string"), "variant").alias(label), "w", "c")

    def total(sums: str, order: int) -> Column:
        return F.struct(*[F.sum(F.col(sums)[f"{name}{n}"]).alias(f"{name}{n}") for n in range(1, order + 1) for name in SUMS]).alias(sums)

    return _system_scores(labelled.groupBy(label).agg(total("w", BLEU_ORDER), total("c", CHRF_ORDER)), label)


def _system_sums(df: DataFrame, groups: list[Column], hyp: str, ref: str, tokenizer) -> DataFrame:
    counted = df.select(*groups, _words(hyp, ref, tokenizer).alias("w"), char_overlap(F.col(hyp), F.col(ref), CHRF_ORDER).alias("c"))
    keys = counted.columns[:-2]
    return counted.groupBy(*keys).agg(F.struct(*_overlap_sums("w", BLEU_ORDER)).alias("w"), F.struct(*_overlap_sums("c", CHRF_ORDER)).alias("c"))


def _system_scores(sums: DataFrame, system: str) -> DataFrame:
    precisions = F.array(*[F.coalesce(100.0 * F.try_divide(f"match{n}", f"hyp{n}"), F.lit(0.0)) for n in range(1, BLEU_ORDER + 1)])
    bleu = sums.select(system, "c", "w.*").select(
        system,
        "c",
        _bleu(BLEU_ORDER).alias("bleu"),
        precisions.alias("precisions"),
        _penalty().alias("brevity_penalty"),
        F.col("hyp1").alias("hyp_len"),
        F.col("ref1").alias("ref_len"),
    )
    shown = ("bleu", "precisions", "brevity_penalty", "hyp_len", "ref_len")
    chrf = bleu.select(system, *shown, "c.*").select(system, *shown, _chrf(CHRF_ORDER, CHRF_BETA).alias("chrf"))
    return chrf.select(system, "bleu", "chrf", *shown[1:])


# -- degenerate output --------------------------------------------------------

def count_degenerate(df: DataFrame, system: str = "system", hyp: str = "hyp") -> DataFrame:
    return df.groupBy(system).agg(F.count_if(fl.is_degenerate(F.col(hyp))).alias("n_degenerate"))


def blank_degenerate(df: DataFrame, hyp: str = "hyp") -> DataFrame:
    return df.withColumn(hyp, F.when(fl.is_degenerate(F.col(hyp)), "").otherwise(F.col(hyp)))


def filter_degenerate(df: DataFrame, hyp: str = "hyp") -> DataFrame:
    return where_computed(df, ~fl.is_degenerate(F.col(hyp)))


def truncate_degenerate(df: DataFrame, **kw) -> DataFrame:
    return score_systems(filter_degenerate(df), **kw)
