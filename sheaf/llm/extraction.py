"""Main text of web pages by tag-path ratios.

A page's runs of text are grouped by their tag path, the elements from the root down to the
block that holds them.  For each path the length of its text and its punctuation are added up
and divided by how often the path occurs; links do not count as text.  A run takes both ratios
of its path; each series is smoothed over the page by a Gaussian, the two are fused to one
score, and paths whose runs score above a share of the page's spread are content.  The smallest
element that holds most of their text is the article, and its other blocks (headings, short
paragraphs, lists, captions, tables) are taken with it.

What names itself as something else never counts: elements of menus, forms, scripts, page
headers and footers, and blocks whose role, class or id says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.markup import HEADINGS, Element, Page, parse
from sheaf.llm.common import modest, trimmed

#: Runs to either side that smoothing looks at, and the width of its bell.
REACH, WIDTH = 2, 1.0
#: A path is content if its score is above this share of the standard deviation of all scores.
SHARE = 0.5
#: The article is the smallest element with this share of the content paths' text.
MOST = 0.6
#: A path of which links are this share of the text, in several runs, is a menu.
LINKS, LEAST_LINKS = 0.9, 3

HIDDEN = frozenset("script style noscript template button select option optgroup textarea svg canvas iframe object audio video datalist".split())
NEVER = frozenset("nav footer aside menu dialog head title form search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of classes and ids that say what a block is.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion banner sidebar aside nav navbar navigation menu submenu breadcrumb breadcrumbs topbar toolbar masthead header footer copyright "
    "cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget widgets skip disclaimer".split()
)
#: Words that say that a block is of readers' comments.
REPLIES = frozenset("comment comments commentlist disqus replies reply respond".split())
ARTICLES = ("article", "main")
#: Elements whose id says what they are; elsewhere ids are names of sections.
NAMED_BY_ID = frozenset("div ul ol table".split())
#: Blocks that belong to the text around them, however short.
BODY = frozenset("p li dd dt td th blockquote pre figcaption caption summary legend".split()) | HEADINGS
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


def names(written: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(written)}


def said(element: Element) -> set[str]:
    """The words of an element's class, and of its id where that says what it is."""
    if not element.written:
        return set()
    a = element.attributes
    found = names(a.get("class", "")) | (names(a.get("id", "")) if element.tag in NAMED_BY_ID else set())
    return found - {"related"} if found & {"work", "works"} else found


def kinds(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: whether it or one above is no part of an article, and whether it is an article or ``main`` or lies in one."""
    elements, words = page.elements, [said(e) for e in page.elements]
    # articles that are called comments are, beside one that is not or has the headline
    articles = [n for n, e in enumerate(elements) if e.tag == "article"]
    headed = {above for n, e in enumerate(elements) if e.tag == "h1" for above in page.above(n)}
    own = [n for n in articles if not words[n] & REPLIES] or [n for n in articles if n in headed] or articles
    # what encloses the page's article or headline is no sidebar, whatever its class says
    whole: set[int] = set()
    for number in [*own, *(n for n, e in enumerate(elements) if e.tag in ("main", "h1"))]:
        for above in page.above(number):
            if above in whole:
                break
            whole.add(above)
    whole.difference_update(n for n in articles if n not in own)
    outside, inside = [False] * len(elements), [False] * len(elements)
    for number, e in enumerate(elements[1:], 1):
        above = e.parent
        inside[number] = inside[above] or e.tag in ARTICLES
        outside[number] = outside[above]
        if outside[number] or e.tag in ("html", "body"):
            continue
        if e.tag in NEVER:
            outside[number] = e.tag != "form" or number not in whole
        elif e.tag == "header" and not inside[above]:
            outside[number] = number not in whole
        if e.written and not outside[number]:
            a = e.attributes
            unseen = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            called = words[number] & (NAMES | REPLIES) or a.get("role", "").lower() in ROLES
            outside[number] = unseen or bool(called) and number not in whole
    return outside, inside


def paths(page: Page) -> list[int]:
    """A number for each element's tag path; equal tags and classes down from the root, equal numbers."""
    known: dict[tuple, int] = {}
    out: list[int] = []
    for e in page.elements:
        label = f"{e.tag} {e.attributes.get('class', '')}" if "class" in e.written.lower() else e.tag
        out.append(known.setdefault((out[e.parent] if e.parent >= 0 else -1, re.sub(r"\d+", "", label)), len(known)))
    return out


def smoothed(series: np.ndarray) -> np.ndarray:
    """Each value's mean with its neighbours, weighted by a bell; nothing lies beyond the ends."""
    bell = np.array([exp(-(k * k) / (2 * WIDTH * WIDTH)) for k in range(-REACH, REACH + 1)])
    return np.convolve(series, bell, "full")[REACH : REACH + len(series)] / np.convolve(np.ones(len(series)), bell, "full")[REACH : REACH + len(series)]


def scores(of: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, float]:
    """The fused score of each path, and the page's threshold.  ``of``: the path of each run."""
    often = np.maximum(np.bincount(of), 1)
    length, marked = np.bincount(of, chars) / often, np.bincount(of, marks) / often
    # a run without a mark still counts, at a tenth of one with one
    series = np.sqrt(smoothed(length[of]) * smoothed(marked[of] + 0.1))
    # the smoothed series is fused with the run's own path, so that no menu rises beside a long text
    own = np.sqrt(length[of] * (marked[of] + 0.1))
    fused = np.sqrt(series * own)
    return np.bincount(of, fused) / often, SHARE * float(fused.std()) if len(set(of.tolist())) > 1 else 0.0


def content(page: Page) -> list[str]:
    """The blocks of the page's article, in page order."""
    outside, inside = kinds(page)
    runs = [r for r in page.runs if not outside[r.owner]]
    if not runs:
        return []
    number = paths(page)
    _, of = np.unique([number[r.owner] for r in runs], return_inverse=True)
    size = np.array([len(r.text) for r in runs], float)
    linked = np.array([min(r.linked, len(r.text)) for r in runs], float)
    marks = np.array([len(_PUNCTUATION.findall(r.text)) for r in runs], float)
    score, least = scores(of, size - linked, marks)
    chosen = (score > 0) & (score >= least)
    often = np.bincount(of)
    menu = (np.bincount(of, linked) >= LINKS * np.bincount(of, size)) & (often >= LEAST_LINKS)
    chosen &= ~menu
    seeds = [i for i in range(len(runs)) if chosen[of[i]]]
    if not seeds:
        # no text but links or single words: an article that says so is taken as it is
        return [r.text for i, r in enumerate(runs) if inside[r.owner] and not menu[of[i]]]
    root = article(page, [runs[i].owner for i in seeds], (size - linked)[seeds], inside)
    within = [root in page.above(r.owner) for r in runs]
    seeds = [i for i in seeds if within[i]]
    first, last = seeds[0], seeds[-1]
    holders = {page.elements[runs[i].owner].parent for i in seeds} | {runs[i].owner for i in seeds}
    whole = page.elements[root].tag in ARTICLES
    taken = []
    for i, r in enumerate(runs):
        tag = page.elements[r.owner].tag
        if not within[i] or menu[of[i]]:
            continue
        near = tag in BODY and (first <= i <= last or page.elements[r.owner].parent in holders) or tag in HEADINGS and i < last
        if whole or chosen[of[i]] or near or first < i < last:
            taken.append(i)
    # the headline may stand right before the article
    if not any(page.elements[runs[i].owner].tag == "h1" for i in taken):
        before = [i for i in range(first) if page.elements[runs[i].owner].tag == "h1" and i not in taken]
        taken = sorted(taken + before[-1:])
    return [runs[i].text for i in taken]


def article(page: Page, owners: list[int], weight: np.ndarray, inside: list[bool]) -> int:
    """The smallest element with most of the content paths' text; the outermost ``article``, else the ``main``, that it lies in."""
    total = float(weight.sum())
    held: dict[int, float] = {}
    for owner, w in zip(owners, weight.tolist(), strict=True):
        for above in page.above(owner):
            held[above] = held.get(above, 0.0) + w
    # children have larger numbers than their parents
    root = max(e for e, w in held.items() if w >= MOST * total)
    if inside[root]:
        named = [e for e in page.above(root) if page.elements[e].tag in ARTICLES]
        return next((e for e in reversed(named) if page.elements[e].tag == "article"), named[0])
    # a block with most of the text is one of several in its parent
    if all(owner == root for owner in owners if root in page.above(owner)) and page.elements[root].parent >= 0:
        root = page.elements[root].parent
    return root


def main_text(html: str | None) -> str:
    return "\n".join(content(parse(html, HIDDEN)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, its blocks joined by line feeds.

    A null or empty html, and a page without any text of its own, give the empty text; markup
    that is broken or ends anywhere is no error.  Repeated rows, null ids and null urls are kept
    as they are, other columns are left out, and a page of any length is read whole.  A line
    break inside a block is white space.  An empty table gives no rows.
    """
    modest(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(regexp_replace(body, '</?b>', '', 'g'), '</?(?:h1|p)>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), chr(1), '&'), chr(160), ' '), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(parts, chr(10)), '')) AS BIGINT) AS n_chars FROM c
"""
