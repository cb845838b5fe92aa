"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores by its context, the names of the elements around it (tag names and
words of class, id and role); a tag scores a little below zero. The best contiguous region is found by one
linear scan. Blocks inside it whose context is never content (an advert between paragraphs) are left out.

The weights of context names are log-odds learnt from labelled pages: pages that mark their text by an ``article`` or
``main`` element, at most ``sample`` of them (those with the least hash of their id). ``HINTS`` are counted as
prior observations, so that names which no labelled page shows still weigh.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsift.llm.common import least_hashed

SAMPLE = 1_000
TAG_SCORE = -0.05
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"[^\S]+")

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_END = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
# names that tell content from the rest on the open web, and names of parts that are never content
HINTS = {
    "in": "article main content post entry story body text prose paragraph".split(),
    "out": "nav menu navbar breadcrumb breadcrumbs header masthead footer aside sidebar rail widget banner notice alert cookie consent gdpr ad ads advert adverts advertisement sponsor sponsored promo promotion form search login signup subscribe newsletter comment comments commentlist commentform reply replies discussion disqus related recommended share social toolbar pagination copyright legal hidden modal popup overlay navigation complementary contentinfo dialog".split(),
}
OUT = frozenset(HINTS["out"])
GENERIC = INLINE | frozenset("html body div section ul ol li table tbody thead tfoot tr td th".split())  # used for anything
MODIFIERS = frozenset("has no not with without is js hide show free".split())  # "has-sidebar" names what a part has, not what it is
LAYOUT = frozenset("nav menu navbar header masthead footer aside sidebar rail banner search toolbar".split())  # may name a page's layout
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption pre dd".split())
VETO = "!"  # among an element's names: never content
LINK_SCORE = -0.5
OUT_SCORE = -0.5  # of a whole stretch of text, which is left out anyway: it may lie between two paragraphs
NEVER = RAW | {"head", "form", "nav", "aside", "footer", "button", "menu", "dialog", "select"}
_PRIOR = 5.0


def context_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, the words of its class, id and role, and ``VETO`` if one of these says that it is never content.

    A class token with a word of ``MODIFIERS`` says nothing. A word of ``LAYOUT`` counts as the first or last word of a token, and
    only where no whole token of the element says content ("content sidebar-left").
    """
    names, out = [tag], False
    tokens = [t for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role") for t in value.strip("\"'").split()]
    content = any(t.lower() in HINTS["in"] for t in tokens)
    for token in tokens:
        words = _WORD.findall(_CAMEL.sub(" ", token).lower())
        if MODIFIERS & set(words):
            continue
        words = [w for k, w in enumerate(words) if w not in LAYOUT or k in (0, len(words) - 1) and not content]
        names += words
        out = out or any(w in OUT and w != "header" for w in words)
    if out and tag not in ("html", "body"):
        names.append(VETO)
    return tuple(dict.fromkeys(names))


def page_tokens(page: str) -> Iterator[tuple[str, str, tuple[tuple[str, ...], ...]]]:
    """('text', decoded text, context) and ('tag', name, context) in page order; context: names of the open elements."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    context: tuple[tuple[str, ...], ...] = ()
    at = 0
    while at <= len(page):
        if stack and stack[-1][0] in RAW:  # to its own end tag, whatever comes
            end = re.compile(rf"</{re.escape(stack[-1][0])}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page) + 1
            stack.pop()
            context = tuple(names for _, names in stack)
            continue
        m = _TOKEN.search(page, at)
        if text := page[at : m.start() if m else len(page)]:
            yield "text", html.unescape(text), context
        if not m:
            return
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not any(t == "p" for t, _ in stack):
                yield "tag", tag, context
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag in ENDS_P and any(t == "p" for t, _ in stack):
                k = max(k for k, (t, _) in enumerate(stack) if t == "p")
                if all(t in INLINE or t == "p" for t, _ in stack[k:]):
                    del stack[k:]
            if tag in SELF_END:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            if tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
                stack.append((tag, context_names(tag, m[3] or "")))
        context = tuple(names for _, names in stack)
        yield "tag", tag, context
        if at >= len(page):
            return


def _flat(context: tuple[tuple[str, ...], ...]) -> set[str]:
    return {n for names in context for n in names} - {VETO}


def is_vetoed(context: tuple[tuple[str, ...], ...]) -> bool:
    """Whether text in this context is never content: by an element, or by names from the outermost ``article`` or ``main`` on."""
    tags = {names[0] for names in context}
    marked = tags & {"article", "main"}
    if tags & NEVER or "header" in tags and not marked:
        return True
    outer = min((k for k, names in enumerate(context) if names[0] in marked), default=0)
    return any(VETO in names for names in context[outer:])


def is_labelled(page: str) -> bool:
    return bool(re.search(r"<(article|main)[\s>]", page, re.I))


def count_names(page: str, inside: Counter, outside: Counter) -> None:
    """Count the words of a labelled page under each context name, inside and outside its marked text."""
    for kind, text, context in page_tokens(page):
        if kind == "text" and (n := len(text.split())):
            names = _flat(context)
            marked = any(c[0] in ("article", "main") for c in context) and not is_vetoed(context)
            (inside if marked else outside).update(dict.fromkeys(names, n))
            (inside if marked else outside)[""] += n


def learn_weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log-odds that a word under a name is content, against all words, with the hints as prior counts."""
    total_in, total_out = inside[""] + 100.0, outside[""] + 100.0
    weights = {}
    for name in {*inside, *outside, *HINTS["in"], *HINTS["out"]} - {""}:
        a = inside[name] / total_in + (_PRIOR / 100 if name in HINTS["in"] else 0.002)
        b = outside[name] / total_out + (_PRIOR / 100 if name in OUT else 0.002)
        weights[name] = max(-4.0, min(4.0, log(a / b)))
        if name in OUT:
            weights[name] = min(weights[name], -2.0)
    return weights


def word_score(context: tuple[tuple[str, ...], ...], weights: dict[str, float]) -> tuple[float, bool]:
    """Score of a word by the names around it, and whether it may be part of the text at all.

    Elements that are used for anything say nothing.
    """
    if is_vetoed(context):
        return 0.0, False
    total = 0.25 + sum(weights.get(n, 0.0) for names in context for k, n in enumerate(names) if k or n not in GENERIC)
    return max(-1.0, min(1.0, total)), True


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its best region's blocks, each with single blanks, joined by a blank.

    A block that is nothing but links scores a little below zero, so that a list of links isn't taken for text; links in
    sentences and linked paragraphs and headings score as the words around them.
    """
    if not page:
        return ""
    tokens = list(page_tokens(page))
    block, blocks, plain = 0, [], set()  # the block of each token; blocks with words outside links
    for kind, text, context in tokens:
        if kind == "tag" and text not in INLINE:
            block += 1
        blocks.append(block)
        if kind == "text" and any(c.isalnum() for c in text):
            near = next((names[0] for names in reversed(context) if names[0] not in INLINE), "")
            if near in PROSE or all(names[0] != "a" for names in context):
                plain.add(block)
    scores: dict[tuple, tuple[float, bool]] = {}
    best, total, first, region = 0.0, 0.0, 0, (0, 0)
    for k, (kind, text, context) in enumerate(tokens):
        gain = TAG_SCORE
        if kind == "text":
            if context not in scores:
                scores[context] = word_score(context, weights)
            own, stays = scores[context]
            linked = blocks[k] not in plain and any(names[0] == "a" for names in context)
            gain = (min(own, LINK_SCORE) if linked else own) * len(text.split()) if stays else OUT_SCORE
        if total <= 0:
            total, first = 0.0, k
        total += gain
        if total > best:
            best, region = total, (first, k + 1)
    parts = []
    for kind, text, context in tokens[region[0] : region[1]]:
        if kind == "tag":
            if text not in INLINE:
                parts.append(" ")
        elif scores[context][1]:
            parts.append(text)
    return " ".join("".join(parts).split())


def _name_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            count_names(page, inside, outside)
    names = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], ["name", "inside", "outside"])


def train_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` labelled pages; without any, the hints alone."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = least_hashed(labelled, F.xxhash64("page_id", "html"), sample)
    counts = chosen.select("html").mapInArrow(_name_rows, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(10_000).collect()
    return learn_weights(Counter({r["name"]: r["inside"] for r in top}), Counter({r["name"]: r["outside"] for r in top}))


def _text_rows(weights: dict[str, float]):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows


def extract_main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    ``text`` is empty for a null or empty page and where nothing scores above zero. Character references are decoded
    once; white space is what Python calls white space. Repeated rows and null ids stay.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_text_rows(train_weights(rows, sample)), "page_id long, url string, text string, n_chars long")
