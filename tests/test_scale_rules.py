"""Rules that got a cheap test before the dear one: the same results on odd texts, and the dear work is done once."""

import random
import re

from pyspark.sql import functions as F

from pairsift.functions import examples as ex
from pairsift.functions import flags as fl
from pairsift.functions import text as tx
from pairsift.functions.char_ngrams import _char_overlap, _codes, _word_overlap
from pairsift.operators import metrics, ordering, routing
from pairsift.plans import curate
from pairsift.profile import ENGLISH_OCCITAN as P
from pairsift.registry import QUERIES
from pairsift.registry import inputs as inp

TEXTS = [
    None, "", " ", "a", " a ", "　é ", "a b", "a b", "\x1ca\x1d", "12 !?", "x . KGM y", "Cİty name here", "Region/ ſtate of", "CITY NAME", "see TRANSLATORſ, x",
    "@ınfo", "@  label", "no @ but label", "city  name", "Widget name", "hi !you", "1.000 ١,٢", "­soft", "日本 x", "😀 ok", "☂ ok", "é" * 30, "\n\t", "a\u0000b",
]


def plain_may_match(spark, df, patterns):
    return df.select(F.col("t").rlike("(?iUd)" + "|".join(f"(?:{p})" for p in patterns)).alias("o"))


def test_the_literal_parts_of_a_pattern_are_looked_for_first(spark):
    assert tx.needed_literals(r"\.\s*kgm\b") == [".", "kgm"]
    assert tx.needed_literals(r"Translators[,]?") == ["translators"]
    assert all(tx.needed_literals(p) is None for p in (r"a|b", r"(a)", r"a{2}", r"a\\.b", "ä", r"x*?y", r"\x41b"))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for patterns in (P.metadata_patterns, P.garbage_patterns, (r"a|b", "x")):
        got = df.select(tx.may_match(F.col("t"), patterns).alias("o")).collect()
        assert got == plain_may_match(spark, df, patterns).collect()


def test_flags_by_their_plain_definitions(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    x = F.col("t")
    solid = tx.remove_whitespace(x)
    plain = {
        "len_1": F.length(tx.strip(x)) <= 1,
        "token_1": tx.token_count(x) <= 1,
        "ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(solid, r"\p{L}+", "")), F.length(solid)), F.lit(1.0)),
        "emoji": x.rlike(f"[{tx.java_class(fl.EMOJI_RANGES)}]"),
        "outside": tx.has_non_ascii(x) & x.rlike(f"[^{tx.java_class(P.allowed_ranges)}]"),
        "spaced": F.regexp_replace(F.regexp_replace(x, r"(?U)\s+([!?;,:])", "$1"), rf"([!?])([{tx.LETTER}])", "$1 $2"),
    }
    quick = {
        "len_1": fl.len_le_1(x), "token_1": fl.token_le_1(x), "ratio": fl.non_letter_ratio(x), "emoji": fl.contains_emoji(x),
        "outside": tx.has_non_ascii(x) & fl.disallowed_char(x, P) & ~x.rlike(r"[\p{C}\p{Z}&&[^ \t\n\r]]") | (tx.has_non_ascii(x) & x.rlike(f"[^{tx.java_class(P.allowed_ranges)}]")),
        "spaced": tx.fix_punct_spacing(x),
    }
    for name in plain:
        assert df.select(quick[name].alias("o")).collect() == df.select(plain[name].alias("o")).collect(), name


def test_anagrams_with_nulls_and_odd_blanks(spark):
    rows = [("Ab c", "c BA"), ("ae", "ea"), ("ae", "aa"), (None, "a"), ("a", None), ("", ""), ("İa", "aİ")]
    got = spark.createDataFrame(rows, "a string, b string").select(routing.not_anagram(F.col("a"), F.col("b")).alias("o")).collect()
    assert [r.o for r in got] == [False, False, True, True, True, False, False]


def plain_counts(pairs, order):
    out = []
    for h, r in pairs:
        row = []
        for n in range(1, order + 1):
            a, b = ([tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (h, r))
            row.append([len(a), len(b), sum(min(a.count(g), b.count(g)) for g in set(a))])
        out.append(row)
    return out


def test_ngrams_are_counted_alike_with_and_without_renumbering():
    rnd = random.Random(5)
    for letters in ("ab", "abcdefgh日😀é", "".join(map(chr, range(0x4E00, 0x5E00)))):
        pairs = [tuple("".join(rnd.choices(letters, k=rnd.randrange(0, 3000 if len(letters) > 99 else 40))) for _ in range(2)) for _ in range(9)]
        pairs = [(h, h[: len(h) // 2] + r) for h, r in pairs] + [("", "")]
        coded = [(_codes(h), _codes(r)) for h, r in pairs]
        if len(letters) < 99:
            assert _char_overlap(coded, 6).tolist() == plain_counts(pairs, 6)
        assert _char_overlap(coded, 3)[:, 0, :2].tolist() == [[len(h), len(r)] for h, r in pairs]
    words = [(["a", "b", "a"], ["b", "a"]), ([], ["x"]), ([], [])]
    assert _word_overlap(words, 4).tolist() == plain_counts(words, 4)
    long = [([str(rnd.randrange(70000)) for _ in range(90000)], ["1"])]  # numbers of 17 bits: four of them do not fit beside the row
    long[0] = (long[0][0], long[0][0][500:700])
    assert _word_overlap(long, 4)[0, 3].tolist() == [89997, 197, 197]


def test_the_three_variants_are_made_of_one_count(spark):
    rows = [(1, "lo gat", "lo gat negre"), (1, "!!", "tres gats"), (2, "", "ren"), (2, "😀", "x y z"), (None, "bon jorn", "bon jorn"), (3, None, "abc")]
    df = spark.createDataFrame(rows, "system int, hyp string, gold string")
    got = metrics.score_variants(df)
    parts = {"as generated": df, "degenerate blanked": metrics.blank_degenerate(df), "degenerate removed": metrics.filter_degenerate(df)}
    expected = set()
    for name, part in parts.items():
        label = F.concat_ws(" / ", F.col("system").cast("string"), F.lit(name))
        expected |= {tuple(map(str, r)) for r in metrics.score_systems(part.withColumn("label", label), system="label").collect()}
    assert {tuple(map(str, r)) for r in got.collect()} == expected
    made = df.withColumns({"src": F.lit("s"), "raw": F.col("hyp")}).drop("hyp")
    plan = curate.evaluate_systems(made)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) <= 2


def test_ids_of_odd_texts_come_once_from_arrow(spark):
    df = spark.createDataFrame([("",), (None,), ("é😀a",)], "t string")
    got = df.select(ex.code_points(F.col("t")).alias("a"), ex.byte_ids(F.col("t")).alias("b"))
    assert [r.a for r in got.collect()] == [[0], None, [0xE9, 0x1F600, 97]]
    assert [r.b for r in got.collect()] == [[], None, list("é😀a".encode())]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_from_records_gives_every_pair(spark, tmp_path):
    rows = [(1, "a\nb\nc", "en"), (2, "x", None), (3, "y\nz", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["from_records"](spark, str(tmp_path)).collect()
    assert sorted((r.src, r.tgt, str(r.config)) for r in got) == [
        ("a", "b", "en-en"), ("b", "c", "en-en"), ("c", "a", "en-en"), ("x", "x", "None"), ("y", "z", "en-fr"), ("z", "y", "en-fr"),
    ]


def test_buckets_by_binary_search_over_borders_from_a_hash_aggregate(spark):
    rows = [(k % 7, k // 3 if k % 11 else None, "ab"[k % 2]) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, g string")
    keys = df.select(F.struct("a", "b").alias("k"))
    cuts = ordering.cut_points(keys, "k", 9)
    placed = ordering.place(df, F.struct("a", "b"), cuts, 9)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.replace("SortAggregate(key=[], ", "") and "lambda" not in placed.select("bucket").where("bucket > 0")._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")[0]
    order = lambda key: tuple((v is not None, v) if v is not None else (False, 0) for v in key)
    borders = [order(c) for c in spark.range(1).select(cuts.alias("c")).first().c]
    assert 5 <= len(borders) <= 9
    assert all(r.bucket == sum(b <= order((r.a, r.b)) for b in borders) for r in placed.collect())
    got = ordering.number_rows(df, ["a", "b"], within=["g"], buckets=9).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(250)) and [order((r.a, r.b)) for r in mine] == sorted(order((r.a, r.b)) for r in mine)


def text_shuffles(df):
    """Exchanges by a hash whose rows hold a text."""
    plan = df._jdf.queryExecution().executedPlan()
    found, nodes = 0, [plan.initialPlan()]
    while nodes:
        node = nodes.pop()
        held = node.output().mkString(" ")
        found += node.nodeName() == "Exchange" and "hashpartitioning" in node.simpleString(99) and ("src#" in held or "tgt#" in held)
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def scoring_tables(spark, folder):
    """Documents with a repeated id and a null id, and vectors one of which is there twice."""
    docs = [(1, "a b\nc\n\nd e"), (2, "x\ny z"), (2, "x\ny w"), (None, "p\nq"), (3, None), (40, "one\ntwo three\nfour")]
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    rnd = random.Random(2)
    vectors = [(k, [rnd.gauss(0, 1) for _ in range(64)]) for k in (0, 1, 2, 3, 4, 5, 3)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_similarities_by_the_id_alone_give_the_rows_of_a_plain_join(spark, tmp_path):
    sf = scoring_tables(spark, tmp_path)
    pairs = inp.line_pairs(spark, sf).drop("lang").where("src <> '' AND tgt <> ''")
    s = inp.sims(spark, sf)
    plain = pairs.withColumn("pair_idx", F.col("pair_id") % s.count()).join(s, "pair_idx").drop("pair_idx")
    got = inp.with_sims(pairs, spark, sf)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_scoring_shuffles_the_texts_once_and_keeps_no_copy(spark, tmp_path, monkeypatch):
    sf = scoring_tables(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(inp, "materialise", lambda df, name: 1 / 0)
    try:
        assert text_shuffles(inp.with_sims(inp.line_pairs(spark, sf), spark, sf)) == 1
        scored = QUERIES["score_pairs"](spark, sf)
        assert text_shuffles(scored) == 1
        sunk = QUERIES["sink_scored"](spark, sf)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert scored.count() and sorted(map(str, scored.collect())) == sorted(map(str, sunk.collect()))
