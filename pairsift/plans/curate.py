"""End-to-end plans: curation of a corpus, the early-stop set, evaluation of generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.functions import scores as sc
from pairsift.operators import cleaning, dedup, langid, metrics, qc, routing, scoring, select
from pairsift.operators.stats import describe_scores, histogram50
from pairsift.profile import ENGLISH_OCCITAN, LangProfile
from pairsift.session import materialise


def usable_pairs(pairs: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    """Route, clean, filter: one pass over the input without a shuffle."""
    _, _, main = routing.route_three_way(pairs, profile)
    cleaned, _ = cleaning.clean_pairs(main, profile)
    return routing.stage_c(cleaned, profile)


def pre_similarity_clean(
    usable: DataFrame, languages: DataFrame | langid.Identifier, profile: LangProfile = ENGLISH_OCCITAN, key: str = "pair_id"
) -> DataFrame:
    """Dedup by target text, drop anagrams, keep the target language, drop source-language leaks.

    ``languages`` is a trained identifier or a table of label scores made elsewhere (``langid.langid_scores``). An identifier
    reads the targets of the survivors only; they are written once, as both its tokens and the result come from them.
    """
    unique = routing.filter_anagram(dedup.dedup_keep_first(usable, "tgt", key))
    if isinstance(languages, langid.Identifier):
        survivors = materialise(routing.filter_indicator_count(unique, profile), "survivors")
        return langid.filter_langid(langid.identify(survivors, languages, profile, key))
    identified = langid.attach_langid(unique, languages, profile, key)
    return routing.filter_indicator_count(langid.filter_langid(identified), profile)


def pair_similarity(pairs: DataFrame, vectors: DataFrame, key: str = "pair_id") -> DataFrame:
    """Attach the cosine of both models; ``vectors`` has key, src_a, tgt_a, src_b, tgt_b."""
    sims = vectors.select(
        key,
        sc.cosine_similarity(F.col("src_a"), F.col("tgt_a")).alias("sim_a"),
        sc.cosine_similarity(F.col("src_b"), F.col("tgt_b")).alias("sim_b"),
    )
    return pairs.join(sims, key)


def curate(
    pairs: DataFrame,
    languages: DataFrame | langid.Identifier,
    sims: DataFrame,
    profile: LangProfile = ENGLISH_OCCITAN,
    key: str = "pair_id",
) -> DataFrame:
    """Raw pairs to scored pairs. ``sims`` has key, sim_a and sim_b; ``languages`` as in ``pre_similarity_clean``.

    The cleaned table is written once; the scoring reads it several times.
    """
    final = pre_similarity_clean(usable_pairs(pairs, profile), languages, profile, key)
    return scoring.score_pairs(materialise(final.join(sims, key), "final"), key)


def early_stop_set(scored: DataFrame, key: str = "pair_id", n: int = select.EARLY_STOP_ROWS) -> DataFrame:
    return select.select_topk_by_score(scored, "score", key, n).select(key, "src", "tgt")


def evaluate_systems(generations: DataFrame, profile: LangProfile = ENGLISH_OCCITAN) -> DataFrame:
    """Metrics of every system as generated, with degenerate output blanked, and without it."""
    return metrics.score_variants(qc.postprocess_causal(generations, profile))


def gold_vs_synthetic_similarity(vectors: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(similarity per row, histogram, description) for ``gold_vec`` against ``hyp_vec``."""
    sims = vectors.select(key, sc.cosine_similarity(F.col("gold_vec"), F.col("hyp_vec")).alias("sim"))
    return sims, histogram50(sims, "sim"), describe_scores(sims, "sim")

