"""Column -> Column text rules (normalisation and deterministic clean-up).

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII-only by default, so every pattern that uses
one of them carries ``(?U)``. Most rules sit behind a cheap ``contains`` test: on clean
text the regular expression is then never run.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsift.profile import WINDOWS_1252, WINDOWS_1252_UNASSIGNED, LangProfile

SPACE = r"[\s\x1c-\x1f]"
LETTER = "a-zA-ZÀ-ÿ"
LONG_LINE = 10000


def java_class(ranges) -> str:
    """The inside of a Java character class for (first, last) code-point ranges."""
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)


def any_of(x: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(n) for n in needles])


def only_if(test: Column, changed: Column, x: Column) -> Column:
    return F.when(test, changed).otherwise(x)


def has_non_ascii(x: Column) -> Column:
    """Byte length against character length: far cheaper than a regular expression."""
    return F.octet_length(x) != F.length(x)


# characters that a case-insensitive pattern takes for an ASCII letter, but that ``lower`` does not make one
FOLDED_TO_ASCII = ("\u0130", "\u0131", "\u017f", "\u212a")


def needed_literals(pattern: str) -> list[str] | None:
    """ASCII texts, in lower case, that every match of ``pattern`` holds; None if the pattern is not a plain sequence."""
    if re.search(r"[|(){]|[*+?][+?]|\\[\\xucQENkpP0-9]|[^\x00-\x7f]", pattern):
        return None
    parts = re.sub(r"(?:\\.|\[[^\]]*\]|.)[*?]", "\0", pattern)  # what may be missing
    parts = re.sub(r"\\\w|\[[^\]]*\]|(?<!\\)[.^$+]", "\0", parts)
    return [part for part in parts.replace("\\", "").lower().split("\0") if part] or None


def may_match(x: Column, patterns) -> Column:
    """Whether any of several case-insensitive patterns occurs: all of them as one alternation.

    An alternation is tried at every character, so a text first has to hold the literal parts of one of the patterns.
    """
    found = x.rlike("(?iUd)" + "|".join(f"(?:{p})" for p in patterns))
    literals = [needed_literals(p) for p in patterns]
    if None in literals:
        return found
    lowered = F.lower(x)
    held = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [lowered.contains(part) for part in parts]) for parts in literals])
    return (held | (has_non_ascii(x) & any_of(x, *FOLDED_TO_ASCII))) & found


def fold_patterns(x: Column, patterns) -> Column:
    """Delete the patterns one after another.

    A fold over an array keeps the generated code small: sixteen nested replacements in
    two columns would push a stage over the size limit of a method. The patterns are
    compiled per row here, so this belongs behind a cheap test.
    """
    return F.aggregate(F.array(*[F.lit(p) for p in patterns]), x, lambda acc, p: F.regexp_replace(acc, p, F.lit("")))


# -- whitespace and tokens ----------------------------------------------------

def null_to_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Trim any Unicode whitespace; the regex runs only where an edge needs it."""
    edge = rf"(?U)^{SPACE}+|{SPACE}+\z"
    return only_if(x.rlike(rf"(?U)^{SPACE}|{SPACE}\z"), F.regexp_replace(x, edge, ""), x)


def remove_whitespace(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){SPACE}+", "")


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def preprocess_for_embedding(x: Column) -> Column:
    return collapse_whitespace(null_to_empty(x))


def split_blank(x: Column) -> Column:
    """Split at whitespace; an edge blank leaves an empty string."""
    return F.split(x, rf"(?U){SPACE}+")


def tokens(x: Column) -> Column:
    """Whitespace tokens, without empty strings."""
    return F.filter(split_blank(x), lambda t: t != "")


def token_count(x: Column) -> Column:
    """Only the two edge pieces can be empty, so no scan of the tokens is needed."""
    return F.size(F.array_remove(split_blank(x), ""))


def char_count(x: Column) -> Column:
    return F.length(x)


# -- stage A: structure -------------------------------------------------------

def as_latin_1(x: Column) -> Column:
    """The characters that Windows-1252 has at the bytes 0x80 to 0x9F as U+0080 to U+009F."""
    controls = "".join(chr(b) for b in range(0x80, 0xA0) if b not in WINDOWS_1252_UNASSIGNED)
    return F.translate(x, WINDOWS_1252, controls)


def _undo_one_round(x: Column) -> Column:
    narrow = as_latin_1(x)
    suspect = narrow.rlike(r"^[\x00-\xFF]*(?:[ÃÂÅ][\x80-\xBF]|â[\x80-\xBF]{2})[\x00-\xFF]*\z")
    repaired = F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))
    return F.when(suspect, F.coalesce(repaired, x)).otherwise(x)


def repair_mojibake(x: Column, rounds: int = 2) -> Column:
    """Undo up to ``rounds`` rounds of UTF-8 read as Latin-1 or Windows-1252.

    Only strings whose characters all are single bytes there and that hold the damaged form of an accented letter, a ligature or a
    punctuation mark are tried, and a repair is kept only when the bytes are valid UTF-8; so a further round
    on a repaired string changes nothing unless it was damaged twice. A string of which only a part is damaged stays.
    """
    undone = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, lambda text, _: _undo_one_round(text))
    return only_if(any_of(x, "Ã", "Â", "Å", "â€", "â\x80", "â‚", "â\x82"), undone, x)


def remove_bom(x: Column) -> Column:
    return F.replace(x, F.lit("\ufeff"), F.lit(""))


def normalize_line_endings(x: Column) -> Column:
    crlf = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    return only_if(x.contains("\r"), F.translate(crlf, "\r", "\n"), x)


def remove_control_chars(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{Cc}&&[^\n\t]]+", "")


def remove_html_tags(x: Column) -> Column:
    blocks = F.regexp_replace(x, r"(?iU)<(?:script|style)[\s\S]*?</(?:script|style)>", "")
    tags = F.regexp_replace(blocks, r"<[^>]+>", "")
    entities = F.regexp_replace(tags, r"&[A-Za-z0-9#]+;", "")
    return only_if(any_of(x, "<", "&"), entities, x)


def remove_urls_emails_paths(x: Column) -> Column:
    urls = F.regexp_replace(x, r"(?U)https?://\S+|www\.\S+", "")
    mails = F.regexp_replace(urls, r"(?U)[\w.-]+@[\w.-]+\.\w{2,}", "")
    paths = F.regexp_replace(mails, r"(?U)(?:[A-Za-z]:\\|/)[\w./\\-]+", "")
    return only_if(any_of(x, "/", "\\", "@", "www."), paths, x)


def strip_markup_tokens(x: Column) -> Column:
    at = F.regexp_replace(x, r"(?U)@\s*\w[\w:-]*", "")
    spans = F.regexp_replace(at, r"[\[{(][^\])}]{0,200}[\])}]", "")
    return only_if(any_of(x, "@", "[", "{", "("), spans, x)


# -- stage B: typography, punctuation, spacing --------------------------------

def replace_typography(x: Column, profile: LangProfile) -> Column:
    single = [(a, b) for a, b in profile.typography if len(b) == 1]
    y = F.translate(x, "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in profile.typography:
        if len(b) != 1:
            y = F.replace(y, F.lit(a), F.lit(b))
    return only_if(has_non_ascii(x), y, x)


def collapse_punct(x: Column) -> Column:
    return F.regexp_replace(x, r"([!?.,:;\x{2014}\x{2013}-])[!?.,:;\x{2014}\x{2013}-]{3,}", "$1")


def collapse_repeat_char(x: Column) -> Column:
    return F.regexp_replace(x, r"([^\n])\1{10,}", "$1$1$1")


def flag_very_long(x: Column) -> Column:
    return F.length(x) > LONG_LINE


def fix_run_on_text(x: Column) -> Column:
    """Optional; off in the default chain."""
    y = F.regexp_replace(x, "([a-zà-ÿ])([A-Z])", "$1 $2")
    return F.regexp_replace(y, "([A-ZÀ-Ÿ])([A-ZÀ-Ÿ][a-z])", "$1 $2")


def apostrophe_fix(x: Column) -> Column:
    y = F.regexp_replace(x, rf"(?U)([{LETTER}])\s*'\s*([{LETTER}])", "$1'$2")
    return only_if(x.contains("'"), y, x)


def slash_fix(x: Column) -> Column:
    return only_if(x.contains("/"), F.regexp_replace(x, r"(?U)\s*/\s*", "/"), x)


def fix_punct_spacing(x: Column) -> Column:
    y = only_if(x.rlike(r"(?U)[!?;,:](?<=\s[!?;,:])"), F.regexp_replace(x, r"(?U)\s+([!?;,:])", "$1"), x)
    return only_if(any_of(x, "!", "?"), F.regexp_replace(y, rf"([!?])([{LETTER}])", "$1 $2"), y)


def remove_spaced_entities(x: Column) -> Column:
    y = F.regexp_replace(x, r"(?U)\s*&\s*#\s*160\s*;", " ")
    y = F.regexp_replace(y, r"(?U)&\s*#\s*\d+\s*;", "")
    y = F.regexp_replace(y, r"(?U)&\s*(?:amp|quot|lt|gt|nbsp)\s*;", "")
    return only_if(x.contains("&"), y, x)


def remove_corpus_metadata(x: Column, profile: LangProfile) -> Column:
    """Delete boilerplate; a cheap probe keeps clean rows out of the 16 replacements."""
    y = fold_patterns(x, [f"(?iUd){p}" for p in profile.metadata_patterns])
    return only_if(may_match(x, profile.metadata_patterns), y, x)


def fix_guillemets(x: Column) -> Column:
    y = F.regexp_replace(F.regexp_replace(x, r"(?U)«\s+", "«"), r"(?U)\s+»", "»")
    return only_if(any_of(x, "«", "»"), y, x)


def normalise_number_separators(x: Column) -> Column:
    thousands = F.regexp_replace(x, r"(?U)(\d+)(?:[,. ]|(\s))(\d{3})", "$1$2$3")
    points = F.regexp_replace(thousands, r"(?U)(\d+),(\d+)", "$1.$2")
    return only_if(x.rlike(r"(?U)\d"), points, x)


def normalise_time_units(x: Column) -> Column:
    clock = F.regexp_replace(x, r"(?U)(\d{1,2}) *: *(\d{2})", "$1:$2")
    hours = F.regexp_replace(clock, r"(?U)(\d{1,2}) *([hH]) {2,}", "$1$2")
    return only_if(any_of(x, ":", "  "), hours, x)


def fix_placeholder_spacing(x: Column) -> Column:
    y = x
    for sign in "%&#":
        y = F.regexp_replace(y, rf"(?U)\s*{sign}\s*(\d+)", f"{sign}$1")
    return only_if(any_of(x, "%", "&", "#"), y, x)


# -- stage C ------------------------------------------------------------------

def cut_at_garbage(x: Column, profile: LangProfile) -> Column:
    """Keep what stands before the first hit of each indicator, in order.

    Each indicator sees the text left by the one before it. Leading blanks are trimmed once
    at the end; blanks before a hit go with the hit, so a later indicator that is anchored
    at the end sees trimmed text.
    """
    cut = fold_patterns(x, [rf"(?iUsd)\s*(?:{p}).*" for p in profile.garbage_patterns])
    return F.when(may_match(x, profile.garbage_patterns), strip(cut)).otherwise(x)


def expand_contractions(x: Column, profile: LangProfile) -> Column:
    shorts = [a for a, _ in profile.contractions]
    folded = reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), profile.contractions, x)
    first = [a for a in shorts if not any(b != a and b in a for b in shorts)]  # one of these is in every text that changes
    return collapse_whitespace(only_if(any_of(x, *first), folded, x))


def sorted_chars(x: Column) -> Column:
    return F.array_sort(F.split(remove_whitespace(F.lower(x)), ""))


def count_of(x: Column, c: str) -> Column:
    """How often the single character ``c`` occurs."""
    return F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))


def contains_word(x: Column, word: str) -> Column:
    quoted = "".join(c if c.isalnum() or c == "_" or c.isspace() else f"\\{c}" for c in word)
    return x.rlike(rf"(?iU)\b{quoted}\b")


def detect_script(x: Column, ranges, default: str) -> Column:
    out = None
    for name, first, last in ranges:
        hit = x.rlike(f"[{java_class([(first, last)])}]")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def extract_numbers(x: Column, strip_trailing_dot: bool = False) -> Column:
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)(\d+\.?\d*)"), 1))
    if strip_trailing_dot:
        found = F.array_distinct(F.transform(found, lambda n: F.rtrim(n, F.lit("."))))
    return found


def indicator_count(x: Column, profile: LangProfile) -> Column:
    """How many different source-language stop words occur in the text, found in one pass."""
    words = "|".join(profile.source_stop_words)
    found = F.regexp_extract_all(x, F.lit(rf"(?iU)\b({words})\b"), 1)
    return F.size(F.array_distinct(F.transform(found, lambda w: F.translate(F.lower(w), "\u017f", "s"))))
