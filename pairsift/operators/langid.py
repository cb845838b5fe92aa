"""Language identification: a token model made by Spark, and the use of label tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsift.functions import text as tx
from pairsift.operators.aligning import lookup_language_name
from pairsift.profile import ENGLISH_OCCITAN, LangProfile
from pairsift.session import materialise

UNDETERMINED = "und"
MIN_PROB = 0.05
TOP_LABELS = 5


# a broadcast table of gains holds at most so many numbers (tokens times labels); other tokens are looked up by a shuffle
BROADCAST_GAINS = 4_000_000


@dataclass(frozen=True)
class TokenModel:
    """``names``: the labels in order, null last; ``priors`` and ``unseen``: one number for each.

    ``gains``: one row per token, (tok, n, gain), where ``gain`` is an array in label order: the log-probability gain over an
    unseen token, 0 where the label lacks it, and ``n`` how often the token was seen. ``least``: tokens seen so often or
    oftener are few enough to be broadcast (None: all are).
    """

    names: tuple[str | None, ...]
    priors: tuple[float, ...]
    unseen: tuple[float, ...]
    gains: DataFrame
    least: int | None = None

    def rows(self) -> DataFrame:
        """(label, tok, log_prob) of every token that a label has."""
        each = F.posexplode("gain").alias("at", "gain")
        seen = self.gains.select("tok", each).where("gain > 0")
        return seen.select(_at(self.names, "at").alias("label"), "tok", (F.col("gain") + _at(self.unseen, "at")).alias("log_prob"))


def _at(values: tuple, place: str) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.col(place)]


def _exploded(df: DataFrame, text: str, *keep: str, outer: bool = False) -> DataFrame:
    """One row per token; blanks are dropped after the explode, inside generated code (with ``outer`` they stay)."""
    explode = F.explode_outer if outer else F.explode
    toks = df.select(*keep, explode(tx.split_blank(F.lower(text))).alias("tok"))
    return toks if outer else toks.where("tok <> ''")


def langid_train(df: DataFrame, text: str = "text", label: str = "label", broadcast_gains: int = BROADCAST_GAINS) -> TokenModel:
    """Per-language token log-probabilities with add-one smoothing.

    Counting combines on the map side, so neither a hot token nor a hot language matters. The counts are written once; the rest
    of the model is derived from them. Only one row per language and a histogram of token counts (at most 64 rows)
    reach the driver. Languages without any token are left out, as they have no room for an unseen one.
    """
    counts = materialise(
        _exploded(df, text, label).groupBy(label, "tok").agg(F.count(F.lit(1)).alias("n")), "token-counts"
    )
    sizes = {r[0]: r[1] for r in counts.groupBy(label).agg(F.sum("n")).collect()}  # one row per language
    docs = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    names = tuple(sorted(sizes, key=lambda x: (x is None, x or "")))
    seen = [F.coalesce(F.sum(F.when(F.col(label).eqNullSafe(F.lit(x)), F.col("n"))), F.lit(0)) for x in names]
    made = counts.groupBy("tok").agg(F.sum("n").alias("n"), F.array(*[F.ln(x + 1) for x in seen]).alias("gain")) if names else None
    gains = materialise(made if names else counts.selectExpr("tok", "n", "array(0D) AS gain"), "token-gains")
    steps = {r["step"]: r["k"] for r in gains.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}
    vocabulary, room = sum(steps.values()), broadcast_gains // max(1, len(names))
    least, kept = None, 0
    for step in sorted(steps, reverse=True):
        kept += steps[step]
        if kept > room:
            least = 2 << step
            break
    total = sum(docs.values())
    priors = tuple(math.log(docs[x] / total) for x in names)
    return TokenModel(names, priors, tuple(-math.log(sizes[x] + vocabulary) for x in names), gains, least)


def _posterior(logs: Column) -> Column:
    """Softmax of an array of logarithms."""
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def langid_probs(df: DataFrame, model: TokenModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, probs): the naive-Bayes posterior as an array in the order of ``model.names``; one row per key of ``df``.

    A token is a row only until it meets its gains: frequent tokens meet a broadcast table of checked size in the task that
    split the text, and the sums per key are combined there, so one short row per text is shuffled. Tokens outside that table, where a
    model has any, are counted per text first and joined by token. Keys are taken to be unique.
    """
    span = range(len(model.names))
    sums = [F.sum(F.col("gain")[i]).alias(f"s{i}") for i in span]
    toks = _exploded(df, text, key, outer=True)
    here = model.gains if model.least is None else model.gains.where(F.col("n") >= model.least)
    n_toks = F.sum(F.when(F.col("tok") != "", 1).otherwise(0)).alias("n")
    per_key = toks.join(F.broadcast(here.select("tok", "gain")), "tok", "left").groupBy(key).agg(n_toks, *sums)
    if model.least is not None:
        rare = model.gains.where(F.col("n") < model.least).select("tok", "gain")
        asked = toks.join(F.broadcast(here.select("tok")), "tok", "left_anti").where("tok <> ''").groupBy(key, "tok").agg(F.count(F.lit(1)).alias("times"))
        found = asked.join(rare, "tok").groupBy(key).agg(*[F.sum(F.col("gain")[i] * F.col("times")).alias(f"r{i}") for i in span])
        per_key = per_key.join(found, key, "left")
    zero = F.lit(0.0)
    rest = [F.coalesce(f"r{i}", zero) if model.least is not None else zero for i in span]
    logs = F.array(*[model.priors[i] + F.col("n") * model.unseen[i] + F.coalesce(f"s{i}", zero) + rest[i] for i in span])
    return per_key.select(key, logs.alias("_logs")).select(key, _posterior(F.col("_logs")).alias("probs"))


def langid_predict(df: DataFrame, model: TokenModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, prob) for every language of the model; see ``langid_probs``."""
    each = langid_probs(df, model, key, text).select(key, F.posexplode("probs").alias("at", "prob"))
    return each.select(key, _at(model.names, "at").alias("label"), "prob")


def save_model(model: TokenModel, path: str) -> None:
    """Write the model below ``path``, in any folder that Spark can write."""
    spark = model.gains.sparkSession
    rows = [(i, *x, model.least) for i, x in enumerate(zip(model.names, model.priors, model.unseen, strict=True))]
    spark.createDataFrame(rows, "at int, label string, prior double, unseen double, least long").write.parquet(f"{path}/labels")
    model.gains.write.parquet(f"{path}/gains")


def load_model(spark: SparkSession, path: str) -> TokenModel:
    rows = sorted(spark.read.parquet(f"{path}/labels").collect())  # one row per language
    names, priors, unseen = (tuple(r[k] for r in rows) for k in ("label", "prior", "unseen"))
    return TokenModel(names, priors, unseen, spark.read.parquet(f"{path}/gains"), rows[0]["least"] if rows else None)


@dataclass(frozen=True)
class Identifier:
    """A token model and the display names of its labels (a label without one keeps its own)."""

    model: TokenModel
    display: dict[str, str]


def _named_scores(probs: Column, who: Identifier) -> Column:
    """Display name -> probability from an array in model order, by the rules of ``langid_scores``."""
    names = F.array(*[F.lit(who.display.get(x, x)) for x in who.model.names])
    labels = F.array(*[F.lit(x) for x in who.model.names])
    entries = F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), labels[i].alias("label"), names[i].alias("name")))
    best = F.slice(F.array_sort(entries), 1, TOP_LABELS)
    placed = F.transform(best, lambda e, i: F.struct(e["name"].alias("name"), (-e["minus"]).alias("prob"), i.alias("place")))
    kept = F.filter(placed, lambda e: (e["prob"] >= MIN_PROB) & e["name"].isNotNull())
    last = F.filter(kept, lambda e: ~F.exists(kept, lambda f: (f["name"] == e["name"]) & (f["place"] > e["place"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"].alias("key"), e["prob"].alias("value"))))


def identify(pairs: DataFrame, who: Identifier, profile: LangProfile = ENGLISH_OCCITAN, key: str = "pair_id", text: str = "tgt") -> DataFrame:
    """The pairs whose ``text`` is long enough to be judged, with ``langs`` and ``tgt_score`` predicted from it.

    ``pairs`` is read twice (once for its tokens, once for the join), so it should be a written table; keys are unique.
    """
    judged = pairs.where(gate(F.col(text)))
    probs = langid_probs(judged, who.model, key, text).select(key, _named_scores(F.col("probs"), who).alias("langs"))
    return judged.join(probs, key).withColumn("tgt_score", target_lang_score(F.col("langs"), profile))


def gate(text: Column, min_chars: int = 15, min_tokens: int = 3) -> Column:
    """Is the text long enough to be judged?"""
    return (F.length(text) > min_chars) & (tx.token_count(text) >= min_tokens)


def bare_code(label: Column) -> Column:
    """``__label__oci_Latn`` -> ``oci``."""
    return F.regexp_extract(label, r"__label__([^_]*)", 1)


def langid_top_k(preds: DataFrame, key: str = "pair_id", k: int = TOP_LABELS) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("prob"), "label")
    return preds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def langid_scores(preds: DataFrame, names: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, langs): display name -> probability, from the five best labels.

    Of two labels with one display name the less probable one wins; then entries under the
    floor go.
    """
    best = langid_top_k(preds, key).withColumn("code", bare_code(F.col("label")))
    named = lookup_language_name(best, names, "code", "name")
    entries = F.collect_list(F.when(F.col("prob") >= MIN_PROB, F.struct("name", "prob", "place")))
    per_key = named.groupBy(key).agg(entries.alias("es"))  # partitioned by key already
    last_of_name = F.filter(
        "es",
        lambda e: ~F.exists("es", lambda f: (f["name"] == e["name"]) & (f["place"] > e["place"])),
    )
    pairs = F.transform(last_of_name, lambda e: F.struct(e["name"].alias("key"), e["prob"].alias("value")))
    return per_key.select(key, F.map_from_entries(pairs).alias("langs"))


def attach_langid(pairs: DataFrame, scores: DataFrame, profile: LangProfile = ENGLISH_OCCITAN, key: str = "pair_id") -> DataFrame:
    """Add ``langs`` (gated) and ``tgt_score``."""
    und = F.create_map(F.lit(UNDETERMINED), F.lit(0.0))
    joined = pairs.join(scores, key, "left")
    gated = joined.withColumn("langs", F.when(gate(F.col("tgt")), F.col("langs")).otherwise(und))
    return gated.withColumn("tgt_score", target_lang_score(F.col("langs"), profile))


def target_lang_score(langs: Column, profile: LangProfile = ENGLISH_OCCITAN) -> Column:
    return F.coalesce(F.try_element_at(langs, F.lit(profile.target_name)), F.lit(0.0))


def filter_langid(df: DataFrame) -> DataFrame:
    return df.where(F.col("tgt_score") > 0)
