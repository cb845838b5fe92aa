"""Everything language-specific that the operators need, as one immutable parameter object."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. Word lists, character ranges, patterns and formats in this
# block decide which rows survive, so they are given literally and in the
# order in which they apply. Patterns are written for Java regular expressions.
# ---------------------------------------------------------------------------

ALLOWED_RANGES = (
    (0x0000, 0x007F),  # Basic Latin
    (0x0080, 0x00FF),  # Latin-1 Supplement
    (0x0100, 0x024F),  # Latin Extended-A and -B
    (0x0300, 0x036F),  # Combining Diacritical Marks
    (0x1AB0, 0x1AFF),  # Combining Diacritical Marks Extended
    (0x1DC0, 0x1DFF),  # Combining Diacritical Marks Supplement
    (0x2000, 0x206F),  # General Punctuation
    (0x2E00, 0x2E7F),  # Supplemental Punctuation
    (0x2150, 0x218F),  # Number Forms
    (0x20A0, 0x20CF),  # Currency Symbols
    (0x2100, 0x214F),  # Letterlike Symbols
    (0x2200, 0x22FF),  # Mathematical Operators
    (0x2500, 0x257F),  # Box Drawing
    (0x2580, 0x259F),  # Block Elements
)

# what Windows-1252 has at the bytes 0x80 to 0x9F, in their order; five of them are unassigned
WINDOWS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_1252_UNASSIGNED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)

SCRIPT_RANGES = (
    ("Cyrillic", 0x0400, 0x04FF),
    ("Arabic", 0x0600, 0x06FF),
    ("Devanagari", 0x0900, 0x097F),
    ("Telugu", 0x0B5C, 0x0B73),
    ("Myanmar", 0x1000, 0x109F),
    ("Hebrew", 0x0590, 0x05FF),
)
DEFAULT_SCRIPT = "Latin"

TYPOGRAPHY = (
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", "-"),
    ("…", "..."),
    ("\u00a0", " "),
)

METADATA_PATTERNS = (
    r"City name.*",
    r"Country name.*",
    r"NAME OF TRANSLATORS",
    r"EMAIL OF TRANSLATORS",
    r"\.\s*kgm\b",
    r"Region/\s*state.*",
    r"Translate this.*",
    r"You are about to translate.*",
    r"@\s*info.",
    r"@\s*label.",
    r"@\s*option.",
    r"@\s*action.",
    r"@\s*item.",
    r"@\s*title.",
    r"City in.*",
    r"Widget name.*",
)

GARBAGE_PATTERNS = (
    r"http:[^/]",
    r"this string is",
    r"the text may not be too wide",
    r"please use some",
    r"Name$",
    r"These are weekly readings",
    r"Indian National month",
    r"Translators[,]?",
    r"Please do NOT modify",
    r"Coptic month",
    r"Ethiopian month",
    r"Advanced URLs",
    r"Automatically move",
)

CONTRACTIONS = (
    ("qu'ei", "que ei"),
    ("qu'es", "que es"),
    ("qu'èra", "que era"),
    ("qu'èran", "que eran"),
    ("qu'èrem", "que erem"),
    ("qu'èretz", "que eretz"),
    ("n'", "ne "),
    ("s'", "se "),
    ("l'", "lo "),
    ("d'", "de "),
    ("m'", "me "),
    ("t'", "te "),
    ("'n", " ne"),
    ("'s", " se"),
    ("'l", " lo"),
    ("'d", " de"),
    ("deth", "de eth"),
    ("del", "de el"),
    ("dels", "de els"),
    ("pel", "per el"),
    ("pels", "per els"),
    ("aqueth", "aque eth"),
    ("aqueste", "aque este"),
    ("aquer", "aque er"),
    ("aquera", "aque era"),
)

SOURCE_STOP_WORDS = (
    "the", "and", "is", "are", "was", "were",
    "this", "that", "with", "which", "what",
    "when", "where", "why", "how", "from", "has",
    "have", "had", "can", "could", "will", "would",
    "for", "new", "did", "not",
)

WEEKDAYS = (
    ("Monday", "Diluns"),
    ("Tuesday", "Dimars"),
    ("Wednesday", "Dimècres"),
    ("Thursday", "Dijòus"),
    ("Friday", "Divendres"),
    ("Saturday", "Dissabte"),
    ("Sunday", "Dimenge"),
)

# (pattern in the source, pattern in the output, reason)
TERM_CONFLICTS = (
    ("inkjet", "laser", "Factual Error: Inkjet vs Laser"),
    (r"\bseasons?\b", r"\bjornadas?\b", "Factual Error: Season vs Jornadas"),
)

REASON_EMPTY_OR_LEAK = "empty/source leak"
REASON_WEEKDAY = "Day of Week Mismatch"
REASON_TIME = "Time Mismatch"
REASON_NUMBER = "Number Mismatch"

EMOJI_RANGES = (
    (0x1F1E0, 0x1F1FF),  # flags
    (0x1F300, 0x1F5FF),  # symbols and pictographs
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F680, 0x1F6FF),  # transport and map symbols
    (0x1F700, 0x1F77F),  # alchemical symbols
    (0x1F780, 0x1F7FF),  # geometric shapes extended
    (0x1F800, 0x1F8FF),  # supplemental arrows
    (0x1F900, 0x1F9FF),  # supplemental symbols and pictographs
    (0x1FA00, 0x1FA6F),  # chess symbols
    (0x1FA70, 0x1FAFF),  # symbols and pictographs extended
    (0x2702, 0x27B0),    # dingbats
    (0x24C2, 0x1F251),   # enclosed characters
)

# hints used only by the optional alternative scorer
TARGET_HINTS = (" nh", " lh", " òc", " dins ", " ont ", " qu’es ")
COUNTER_HINTS = (" ny", " ll", " tion", " cion", " el ", " els ")

SOURCE_NUMBER_WORDS = (
    ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5),
    ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10),
    ("eleven", 11), ("twelve", 12), ("thirteen", 13), ("fourteen", 14), ("fifteen", 15),
    ("sixteen", 16), ("seventeen", 17), ("eighteen", 18), ("nineteen", 19), ("twenty", 20),
    ("thirty", 30), ("forty", 40), ("fifty", 50), ("sixty", 60), ("seventy", 70),
    ("eighty", 80), ("ninety", 90), ("hundred", 100), ("thousand", 1000),
)

TARGET_NUMBER_WORDS = (
    ("zero", 0), ("un", 1), ("dos", 2), ("tres", 3), ("quatre", 4), ("cinc", 5),
    ("sièis", 6), ("sèt", 7), ("uèch", 8), ("nòu", 9), ("dètz", 10),
    ("onze", 11), ("dotze", 12), ("tretze", 13), ("catòrze", 14), ("quinze", 15),
    ("setze", 16), ("dètz-e-sèt", 17), ("dètz-e-uèch", 18), ("dètz-e-nòu", 19),
    ("vint", 20), ("trenta", 30), ("quaranta", 40), ("cinquanta", 50), ("seissanta", 60),
    ("setanta", 70), ("ochanta", 80), ("nonanta", 90), ("cent", 100), ("mil", 1000),
)

CAUSAL_PROMPT = "Translate English to Occitan: {src} -> "
SEQ2SEQ_PROMPT = ">>oci<< {src}"
END_MARKER = "</s>"

# ------------------------------ end of fixed values ------------------------


@dataclass(frozen=True)
class LangProfile:
    """Rules of one language direction; swap the fields to curate another pair."""

    source: str = "en"
    target: str = "oc"
    target_name: str = "Occitan"
    allowed_ranges: tuple = ALLOWED_RANGES
    typography: tuple = TYPOGRAPHY
    metadata_patterns: tuple = METADATA_PATTERNS
    garbage_patterns: tuple = GARBAGE_PATTERNS
    contractions: tuple = CONTRACTIONS
    source_stop_words: tuple = SOURCE_STOP_WORDS
    weekdays: tuple = WEEKDAYS
    term_conflicts: tuple = TERM_CONFLICTS
    source_number_words: tuple = SOURCE_NUMBER_WORDS
    target_number_words: tuple = TARGET_NUMBER_WORDS
    causal_prompt: str = CAUSAL_PROMPT
    seq2seq_prompt: str = SEQ2SEQ_PROMPT
    end_marker: str = END_MARKER
    guillemets: bool = True


ENGLISH_OCCITAN = LangProfile()
