"""HTML main text by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive, tags negative, and one linear scan finds the contiguous stretch with
the highest sum: menus and footers are many tags for few words, an article is the other way round. The weights come from
labelled pages, those with exactly one <article> or <main> element: a tag's weight is the log-odds of standing inside it, a word's that of
words directly inside the same tag, kept between the bounds below so that words stay positive and tags negative.

Elements that are never main text (scripts, forms, menus, …, by name, role or class) are left out of the stretch's text wherever
they stand; their words score nothing and their tags next to nothing, so an advert inside an article doesn't cut it in two.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.frames import table, text_batches

#: About so many labelled pages, whole, teach the weights; chosen by a hash of the id.
SAMPLE_PAGES = 1_000
#: Weights are kept for so many different tags at most, the most frequent ones; others get UNSEEN_TAG and UNSEEN_WORD.
MOST_TAGS = 2_000
TAG_BOUNDS = (-6.0, -0.1)
WORD_BOUNDS = (0.3, 2.0)
UNSEEN_TAG, UNSEEN_WORD = -2.0, 0.7

# Element names and words in class or id that mark what isn't main text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "input", "option", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
         "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "side",
         "widget", "widgets", "share", "sharing", "social", "related", "recommended", "footer", "copyright", "disclaimer", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "toolbar", "masthead", "search"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = ("article", "main")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>%s)\b[^>]*+>(?:.*?</(?P=raw)\s*+[^>]*+(?:>|\Z)|.*\Z)
    |<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*+)(?P<rest2>[^>]*+)(?:>|\Z)
    |<[!?][^>]*+(?:>|\Z)""" % "|".join(sorted(RAW)), re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""", re.I)
NAME_PART = re.compile(r"[a-z]+|\d+")


def _is_outside(name: str, rest: str, in_main: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_main:
        return True
    if "=" not in rest and "hidden" not in rest.lower():
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", *MAIN):
            if any(word in MARKS or word == "header" and not in_main and name[0] != "h" for word in NAME_PART.findall(value)):
                return True
    return False


def pieces(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """The page in order: (tag or "", text, the tag that the piece stands in, left out, inside <article> or <main>)."""
    stack: list[tuple[str, bool]] = []  # open elements, and whether each began a part that is left out
    out = main = at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "", page[at:m.start()], stack[-1][0] if stack else "", out > 0, main > 0
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m["raw"]:
                yield m["raw"].lower(), "", "", True, main > 0
            continue
        rest = m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            left = out > 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    out -= sum(o for _, o in stack[k:])
                    main -= sum(n in MAIN for n, _ in stack[k:])
                    del stack[k:]
                    break
            yield "/" + name, "", stack[-1][0] if stack else "", left, main > 0
            continue
        if stack and stack[-1][0] == name and name in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):
            out -= stack.pop()[1]  # closed by its like
        if name not in VOID and not rest.endswith("/"):
            left = _is_outside(name, rest, main > 0)
            stack.append((name, left))
            out += left
            main += name in MAIN
        yield name, "", stack[-1][0] if stack else "", out > 0, main > 0
    if at < len(page):
        yield "", page[at:], stack[-1][0] if stack else "", out > 0, main > 0


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the page's best stretch. weights: of tags by name (a closing one with / before it), of words by "in " and the tag."""
    items = []
    best, best_from, best_to, run, run_from = 0.0, 0, 0, 0.0, 0
    for tag, text, parent, left, _ in pieces(page):
        if tag:
            value = TAG_BOUNDS[1] if left else weights.get(tag, UNSEEN_TAG)
        elif left:
            value = 0.0
        else:
            value = len(text.split()) * weights.get("in " + parent, UNSEEN_WORD)
        if run <= 0:
            run, run_from = 0.0, len(items)
        items.append((tag, "" if left else text))
        run += value
        if run > best:
            best, best_from, best_to = run, run_from, len(items)
    parts = []
    for tag, text in items[best_from:best_to]:
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
        elif tag.lstrip("/") not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            found = list(pieces(page.as_py()))
            for tag, text, parent, left, main in found:
                if tag:
                    counts[tag, main] += not left
                elif not left:
                    counts["in " + parent, main] += len(text.split())
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([m for _, m in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["token", "main", "n"])


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from pages (page_id, html) with one <article> or <main>; without any, none: every tag and word then counts as unseen."""
    text = F.col("html").cast("string")
    labelled = pages.filter(text.isNotNull()).select(F.xxhash64("page_id").alias("h"), text.alias("html")) \
        .filter(F.size(F.split("html", r"(?i)<(?:article|main)\b")) == 2)
    n = labelled.count()
    chosen = labelled.filter(F.shiftrightunsigned("h", 34) < min(1.0, sample / max(n, 1)) * 2**30).select("html").mapInArrow(_label_rows, "token string, main boolean, n long")
    counted = chosen.groupBy("token").agg(F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "token").limit(MOST_TAGS).collect()
    out = {}
    for r in counted:
        low, high = WORD_BOUNDS if r.token.startswith("in ") else TAG_BOUNDS
        out[r.token] = min(high, max(low, log((r.inside + 1) / (r.n - r.inside + 1))))
    return out


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars (code points). A null or empty html, or one without words, gives an empty text.

    Character references are decoded once, white space within and between blocks becomes one space; inline tags put no space
    between what they touch. Repeated rows each give a row. Other columns are ignored.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(page.as_py(), weights) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))


QUERIES = {"op5_html_text": op5_html_text}
#: A parser and fitted weights; tests hold it against marked texts and the sum over all stretches.
ORACLES: dict[str, str] = {}
