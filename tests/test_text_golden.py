"""Hand-written edge rows for every text rule."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from pairsift.functions import flags as fl
from pairsift.functions import generation as gen
from pairsift.functions import text as tx
from pairsift.functions import unicode as uc
from pairsift.operators import alternates as alt
from pairsift.operators import cleaning
from pairsift.profile import CONTRACTIONS
from pairsift.profile import ENGLISH_OCCITAN as P

TEXT_CASES = [
    ("line_endings", tx.normalize_line_endings, "a\r\nb\rc", "a\nb\nc"),
    ("control", tx.remove_control_chars, "a\x01b\tc", "ab\tc"),
    ("unescape", uc.html_unescape, "caf&eacute; &lt;b&gt;", "café <b>"),
    ("tags", tx.remove_html_tags, "x<script>y</script>z<b>w</b>&foo;", "xzw"),
    ("tags_case", tx.remove_html_tags, "x<STYLE a>\ny</Style>z", "xz"),
    ("url", tx.remove_urls_emails_paths, "see https://a.b/c now", "see  now"),
    ("mail", tx.remove_urls_emails_paths, "mail a.b@c.org!", "mail !"),
    ("path", tx.remove_urls_emails_paths, "and/or", "and"),
    ("markup", tx.strip_markup_tokens, "@info text [note] (x}", " text  "),
    ("typography", lambda x: tx.replace_typography(x, P), "‘a’ “b” – — … ", "'a' \"b\" - - ... "),
    ("punct", tx.collapse_punct, "x!!!!y", "x!y"),
    ("punct_dots", tx.collapse_punct, "x...y", "x...y"),
    ("punct_mixed", tx.collapse_punct, "?!?!", "?"),
    ("repeat_11", tx.collapse_repeat_char, "a" * 11, "aaa"),
    ("repeat_10", tx.collapse_repeat_char, "a" * 10, "a" * 10),
    ("spaces", tx.collapse_whitespace, " a\t b\n", "a b"),
    ("run_on", tx.fix_run_on_text, "flechaThis THISText", "flecha This THIS Text"),
    ("apostrophe", tx.apostrophe_fix, "l ' a", "l'a"),
    ("apostrophe_overlap", tx.apostrophe_fix, "a ' b ' c", "a'b ' c"),
    ("slash", tx.slash_fix, "a / b", "a/b"),
    ("punct_spacing", tx.fix_punct_spacing, "hi !you", "hi! you"),
    ("spaced_entities", tx.remove_spaced_entities, "a & # 160 ; b", "a  b"),
    ("guillemets", tx.fix_guillemets, "« a »", "«a»"),
    ("thousands", tx.normalise_number_separators, "1.000", "1000"),
    ("millions", tx.normalise_number_separators, "1.000.000", "1000.000"),
    ("decimal", tx.normalise_number_separators, "3,5", "3.5"),
    ("both", tx.normalise_number_separators, "1,234,5", "1234.5"),
    ("pi", tx.normalise_number_separators, "3.1415", "31415"),
    ("neighbours", tx.normalise_number_separators, "2019 100", "2019100"),
    ("newline_number", tx.normalise_number_separators, "12\n345.678", "12\n345.678"),
    ("time", tx.normalise_time_units, "10 : 30", "10:30"),
    ("placeholder", tx.fix_placeholder_spacing, "use % 1", "use%1"),
    ("metadata", lambda x: tx.remove_corpus_metadata(x, P), "CITY NAME in Spain\nkeep x. kgm", "\nkeep x"),
    ("garbage", lambda x: tx.cut_at_garbage(x, P), "Hello there. Translators, please", "Hello there."),
    ("garbage_end", lambda x: tx.cut_at_garbage(x, P), "the File Name", "the File"),
    ("garbage_twice", lambda x: tx.cut_at_garbage(x, P), " a Name  this string is b", "a"),
    ("no_garbage", lambda x: tx.cut_at_garbage(x, P), " named ", " named "),
    ("contraction", lambda x: tx.expand_contractions(x, P), "l'ostal del rei", "lo ostal de el rei"),
    ("contraction_inside", lambda x: tx.expand_contractions(x, P), "modelar", "mode elar"),
    ("mojibake", tx.repair_mojibake, "cafÃ©", "café"),
    ("no_mojibake", tx.repair_mojibake, "café", "café"),
    ("mojibake_quotes", tx.repair_mojibake, "â€œcafÃ©â€\x9d cÅ“ur â‚¬", "“café” cœur €"),
    ("mojibake_twice", tx.repair_mojibake, "cafÃƒÂ© cÃ…â€œur", "café cœur"),
    ("no_mojibake_windows", tx.repair_mojibake, "“café” âge €", "“café” âge €"),
    ("mojibake_other", tx.repair_mojibake, "cafÃ© 日", "cafÃ© 日"),
    ("nfc", cleaning.normalize_unicode, "é﻿", "é"),
    ("null", cleaning.normalize_unicode, None, ""),
]


@pytest.fixture(scope="module")
def text_results(spark):
    rows = spark.createDataFrame([(t,) for _, _, t, _ in TEXT_CASES], "t string").coalesce(1)
    picked = []
    for i, (_, rule, text, _) in enumerate(TEXT_CASES):
        one = spark.createDataFrame([(i, text)], "i int, t string").select("i", rule(F.col("t")).alias("o"))
        picked.append(one)
    assert rows.count() == len(TEXT_CASES)
    out = picked[0]
    for df in picked[1:]:
        out = out.union(df)
    return {r.i: r.o for r in out.collect()}


@pytest.mark.parametrize("i", range(len(TEXT_CASES)), ids=[c[0] for c in TEXT_CASES])
def test_text_rule(text_results, i):
    assert text_results[i] == TEXT_CASES[i][3]


def one(spark, text, **columns):
    """Evaluate expressions of column t on one text."""
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_flags_match_plain_python(spark):
    texts = ["", " ", "a", " a ", "a1!", "  ", "a b", "12 3", "é b", "日本 x", "a b", "a—b", "a­b", "x\ty\nz", "ª", "\x07a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    out = df.select(
        "t",
        fl.no_letters(t).alias("no_letters"),
        fl.len_le_1(t).alias("short"),
        tx.token_count(t).alias("n"),
        fl.non_letter_ratio(t).alias("ratio"),
        fl.disallowed_char(t, P).alias("bad"),
    )
    for r in out.collect():
        solid = "".join(r.t.split())
        assert r.no_letters == (not any(c.isalpha() for c in r.t))
        assert r.short == (len(r.t.strip()) <= 1)
        assert r.n == len(r.t.split())
        expected = sum(not c.isalpha() for c in solid) / len(solid) if solid else 1.0
        assert abs(r.ratio - expected) < 1e-12
        allowed = all(
            (c.isprintable() or c in " \t\n\r") and any(a <= ord(c) <= b for a, b in P.allowed_ranges) for c in r.t
        )
        assert r.bad == (not allowed), repr(r.t)


def test_patterns_with_alternatives_are_found(spark):
    rows = spark.createDataFrame([("x Foo y",), ("a BC",), ("abc d",), ("none",)], "t string")
    got = [r["m"] for r in rows.select(tx.may_match(F.col("t"), (r"foo|bar", r"(?:a|b)c")).alias("m")).collect()]
    assert got == [True, True, True, False]
    assert len(CONTRACTIONS) == 25


def test_indicator_count_is_per_distinct_word(spark):
    r = one(spark, "The the THE and sand with, l'is", n=tx.indicator_count(F.col("t"), P))
    assert r.n == 4  # the, and, with, is


def test_clean_text_steps(spark):
    df = spark.createDataFrame([(1, None), (2, "abc"), (3, "a  b !!!!!")], "id int, text string")
    rows = {r.id: (r.text_clean, r.text_steps) for r in cleaning.clean_text(df).collect()}
    assert rows[1] == ("", [])
    assert rows[2] == ("abc", ["unicode_norm", "line_endings_norm"])
    assert rows[3] == (
        "a b!",
        ["unicode_norm", "line_endings_norm", "punct_collapsed", "whitespace_collapsed", "universal_punct_fixed"],
    )


def test_run_on_option_applies_to_the_target_only(spark):
    df = spark.createDataFrame([("aB cD",)], "text string")
    on = cleaning.clean_text(df, is_target=True, split_run_on=True).first()
    off = cleaning.clean_text(df, is_target=True).first()
    assert (on.text_clean, off.text_clean) == ("a B c D", "aB cD")


def test_nfc_guard_never_skips_a_needed_row(spark):
    texts = [chr(c) + "́" for c in range(0x41, 0x7B)] + ["Ω", "Å", "가", "क़", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", uc.nfc(F.col("t")).alias("o")).collect():
        assert r.o == unicodedata.normalize("NFC", r.t)


def test_generation_rules(spark):
    src, hyp = F.lit("On Monday in 2019."), F.col("t")
    assert one(spark, "lo diluns", r=gen.check_day_names(src, hyp, P)).r is None
    assert one(spark, "dimars", r=gen.check_day_names(src, hyp, P)).r == "Day of Week Mismatch"
    assert one(spark, "en 2019", r=gen.check_numbers(src, hyp)).r == "Number Mismatch"
    assert one(spark, "en 2019", r=gen.check_numbers(src, hyp, True)).r is None
    assert one(spark, "en", r=gen.check_numbers(src, hyp)).r is None
    assert one(spark, "oc: hi", r=gen.reject_empty_or_leak(F.lit("Hi"), hyp)).r == "empty/source leak"
    assert one(spark, "a las 10h45", r=gen.check_time_numbers(F.lit("at 10:30"), hyp)).r == "Time Mismatch"
    assert one(spark, "a las 10h30", r=gen.check_time_numbers(F.lit("at 1030 hours"), hyp)).r is None
    both = lambda text, hyp_text: one(spark, hyp_text, r=gen.critical_error(F.lit(text), hyp, P, check_times=True)).r
    assert both("at 10:30 with 3 men", "a 10h30 amb 3") is None
    assert both("at 10:30 with 3 men", "a 10h30 amb 4") == "Number Mismatch"
    assert both("at 10:30 with 3 men", "a 10h45 amb 3") == "Time Mismatch"
    assert both("0930 hours, 7 men", "09:30, 7") is None and both("at 10:30", "30") is None
    prompt = F.lit("P: x -> ")
    assert one(spark, "P: x ->  Adieu, mond.\nextra", r=gen.strip_prompt(hyp, prompt)).r == "Adieu, mond"
    for text, expected in (("", True), ("a", True), ("12 3a", True), ("ok", False), ("日本", True), ("é é", False)):
        assert one(spark, text, r=fl.is_degenerate(hyp)).r is expected


def test_number_words(spark):
    r = one(spark, "twenty one and three", n=alt.alt_number_words_src(F.col("t")))
    assert r.n == [21, 1, 3, 20]
    r = one(spark, "cinquanta un e dos cent, 17", n=alt.alt_number_words_tgt(F.col("t")))
    assert r.n == [253, 17]  # 50 + 1 + 2 + 2 * 100


def test_long_runs_of_target_number_words(spark):
    """Runs far longer than the matcher's stack; a run ends at the last word border."""
    def numbers(word, n, tail=""):
        t = F.concat(F.repeat(F.lit(word), F.lit(n)), F.lit(tail))
        return spark.range(2).repartition(2).select(alt.alt_number_words_tgt(t).alias("n")).first().n

    assert numbers("un ", 20_000, "7") == [20_000, 7]
    assert numbers("vint-e-", 20_000, "un") == [400_001]
    assert numbers("un", 20_000) == [] and numbers("un", 20_000, " mil") == [1000]
    assert numbers("nonanta mil ", 24_000) == [24_000 * 90_090]  # more than an int holds
    for text, found in (("undosx tres", [3]), ("un dosx", [1]), ("un e dètz-e-sètx", [11]), ("dètz-e-sèt", [17]), ("un  -  dos", [3])):
        assert numbers(text, 1) == found, text
