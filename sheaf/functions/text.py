"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accented() -> dict[str, str]:
    """Latin letters with accents and their bases a to z, by the rule of canonical decomposition."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and whole[0].isascii() and whole[0].isalpha():
            out[chr(code)] = whole[0]
    return out


# Marks that are dropped, in a term or after it; other marks end a term.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
# Letters that are folded with others, beyond lower case; the two accented ones stay.
VARIANTS, FOLDED, KEPT = "µſςϐϑϕϖϰϱϵ", "μsσβθφπκρε", "ǠǡǢǣ"
_ACCENTED = {k: v for k, v in _accented().items() if k not in KEPT}
_FROM, _TO = "".join(_ACCENTED) + VARIANTS + MARKS, "".join(_ACCENTED.values()) + FOLDED

# Headings that make a section a bibliography.
BIBLIOGRAPHY_HEADINGS = ("references", "bibliography", "works cited", "literature cited")

# Second halves that keep their hyphen.
COMPOUND_CONTINUATIONS = ("based", "dependent", "driven", "related", "aware", "specific", "level", "term", "scale", "state", "time", "free", "less", "like", "wise", "pressure", "speed", "resolution", "dimensional", "linear", "linearized", "end")
# Suffixes that continue a word.
CONTINUATION_SUFFIXES = ("ability", "ation", "ations", "ibility", "ically", "ication", "ications", "ified", "ification", "ifications", "ifying", "ing", "ities", "ity", "ization", "izations", "ized", "izing", "ment", "ments", "ness", "sion", "sions", "tion", "tions")
# Prefixes that a word continues.
SPLIT_PREFIXES = ("fore", "inter", "intra", "macro", "micro", "multi", "semi")

# A word broken at a line end, its first half at the end of an item, its second at the start of the next.
BREAK = r"([A-Za-z]+(?:-[A-Za-z]+)*)-[ \t]*\r?\n(?:[ \t]*\r?\n)?[ \t]*([a-z][A-Za-z]*)"
FIRST_HALF, SECOND_HALF = r"([A-Za-z]+(?:-[A-Za-z]+)*)-$", r"^\s*([a-z][A-Za-z]*)"
# Where a second numbered heading begins, and a numbered heading as a whole.
HEADING_CUT, NUMBERED_HEADING = r"\s+(?=(?:\d+\.){1,3}\s+[A-Z])", r"^(?:\d+\.){1,3}\s+\S.*$"
# Page counters before a text, as a whole text, and at the end of a table cell.
COUNTER_BEFORE, COUNTER, COUNTER_LEFT = r"(?i)^\s*(?:page\s*)?\d+\s+of\s+\d+\s+", r"(?i)^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$", r"(?i)\s+\d+\s+of\s*$"
# A formula's closing tag, its number, and the mark of a caption.
FORMULA_END, FORMULA_NUMBER, CAPTION_MARK = r"</?formula.*$", r"(?s)(\\quad\s*\(\s*(?:\d\s*)+\)).*$", r"(?i)^((?:figure|table)\s*\d+\.)"

SPACE = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(squeeze(text)) > 0, text)


def fold(text: Column) -> Column:
    """Lower-cased, accents stripped, whether they are part of a letter or marks of their own."""
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(text: Column) -> Column:
    """Index terms: maximal runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space, at least 1."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(1), F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))))


def section_path(headings: Column) -> Column:
    """``a > b`` from an array of headings, blank ones left out; null if none is left."""
    kept = F.filter(F.transform(headings, squeeze), lambda h: h != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " > "))


def section_leaf(section: Column) -> Column:
    """The last heading of a path, lower-cased, numbering and colon dropped, spaced letters joined."""
    leaf = squeeze(F.element_at(F.split(section, ">"), -1))
    joined = F.when(leaf.rlike(r"^(?:\p{L} )+\p{L}$"), F.regexp_replace(leaf, " ", "")).otherwise(leaf)
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(joined), r"^(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)]?\s+", ""), ":+$", ""))


def is_bibliography(section: Column) -> Column:
    return F.coalesce(section_leaf(section).isin(*BIBLIOGRAPHY_HEADINGS), F.lit(False))


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    """What is embedded: title, section and text, with stand-ins where the first two are missing."""
    return F.concat(F.lit("Title: "), F.coalesce(blank_to_null(title), F.lit("Unknown")), F.lit("\nSection: "), F.coalesce(blank_to_null(section), F.lit("Unknown")), F.lit("\nContent: "), text)


def passage(title: Column, section: Column, text: Column) -> Column:
    """What a reranker reads: lines for title and section only where there are such."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), blank_to_null(title)), F.concat(F.lit("Section: "), blank_to_null(section)), text)


def key(text: Column) -> Column:
    """Label key: only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def slug(name: Column) -> Column:
    """File-safe name: 60 characters and ten hex digits of the name's digest."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(safe, 1, 60), F.lit("-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 10))


def word_join(left: Column, right: Column) -> Column:
    """How two halves around a line-end hyphen belong together; the first rule that applies wins.

    A half that usually ends a compound keeps the hyphen; a compound of two whose last part is
    long enough, before a short half, is one broken word; longer compounds keep it; known
    prefixes and suffixes join; anything else keeps it.
    """
    low = F.lower(right)
    parts = F.split(left, "-")
    last = F.lower(F.element_at(parts, -1))
    kept, joined = F.concat(left, F.lit("-"), right), F.concat(left, right)
    suffixed = low.rlike("^(?:" + "|".join(CONTINUATION_SUFFIXES) + ")")
    return (
        F.when(low.isin(*COMPOUND_CONTINUATIONS), kept)
        .when((F.size(parts) == 2) & (F.length(last) >= 3) & (F.length(right) <= 4), joined)
        .when(F.size(parts) > 2, kept)
        .when(last.isin(*SPLIT_PREFIXES), joined)
        .when(suffixed, joined)
        .otherwise(kept)
    )


def repair_hyphens(text: Column) -> Column:
    """Soft hyphens removed, and words broken at a line end put together again.

    The text is cut at the breaks; gaps and repaired words are joined in turn.
    """
    clean = F.regexp_replace(text, "­\\s*", "")
    lefts, rights = (F.regexp_extract_all(clean, F.lit(BREAK), F.lit(g)) for g in (1, 2))
    words = F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda p: word_join(p["l"], p["r"]))
    gaps = F.split(clean, BREAK, -1)
    woven = F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    return F.when(F.size(words) > 0, F.array_join(woven, "")).otherwise(clean)


def join_across(text: Column, following: Column) -> tuple[Column, Column]:
    """Texts of two neighbours after a word broken between them is put into the first."""
    left = F.regexp_extract(text, FIRST_HALF, 1)
    right = F.regexp_extract(following, SECOND_HALF, 1)
    broken = (left != "") & (right != "")
    first = F.concat(F.regexp_replace(text, FIRST_HALF, ""), word_join(left, right))
    return F.when(broken, first).otherwise(text), F.when(broken, F.ltrim(F.regexp_replace(following, SECOND_HALF, ""))).otherwise(following)


def merge_spaced_capitals(text: Column) -> Column:
    """``A R T I C L E  I N F O`` to ``ARTICLE INFO``: a single space between capitals goes."""
    inner = F.regexp_replace(text, r"(?<=(?<![A-Za-z])[A-Z]) (?=[A-Z](?![A-Za-z]))", "")
    return F.trim(F.regexp_replace(inner, r"\s{2,}", " "))


def split_numbered_heading(text: Column) -> Column:
    """Two numbered headings run together, as an array of two; otherwise the text alone."""
    parts = F.split(text, HEADING_CUT, -1)
    return F.when((F.size(parts) == 2) & F.forall(parts, lambda p: F.trim(p).rlike(NUMBERED_HEADING)), F.transform(parts, lambda p: F.trim(p))).otherwise(F.array(text))


def strip_page_counter(text: Column) -> Column:
    return F.regexp_replace(text, COUNTER_BEFORE, "")


def is_page_counter(text: Column) -> Column:
    return F.trim(text).rlike(COUNTER)


def strip_dangling_counter(text: Column) -> Column:
    """Table cells: what is left of a page counter at the end goes."""
    return F.regexp_replace(text, COUNTER_LEFT, "")


def clean_formula(text: Column) -> Column:
    """Closing tags go, and so does any text after a formula's number."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, FORMULA_END, ""), FORMULA_NUMBER, "$1"))


def page_label(first: Column, last: Column) -> Column:
    """One page, a range of pages, or ``unknown`` without a first page."""
    return F.when(first.isNull(), "unknown").when(F.coalesce(last, first) == first, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def signal_count(text: Column, signals: tuple[str, ...]) -> Column:
    """How many different signals occur as substrings."""
    total = F.lit(0)
    for s in signals:
        total = total + F.contains(text, F.lit(s)).cast("int")
    return total


# What counts as a number in a text.
NUMBER = r"\d+(?:\.\d+)?%?"


def numeric_density(text: Column) -> Column:
    clean = squeeze(text)
    words = F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(NUMBER)) / F.greatest(words, F.lit(1)))


def citation_labels(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([ER]\d+)\]"), F.lit(1)))


def first_seen(values: Column) -> Column:
    """Trimmed, blanks dropped, first occurrences kept in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def first_seen_folded(values: Column) -> Column:
    """As first_seen, but letters' case makes no difference, whether or not a letter's other case is one letter."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    # capitals, since sharp s has two and its lower case is itself; only a dotless i is no i
    folded = lambda v: F.upper(F.translate(v, "\u0131", "\ue000"))
    keys = F.transform(kept, folded)
    return F.filter(kept, lambda v, i: F.array_position(keys, folded(v)) == i + 1)


def caption_repeat(text: Column) -> tuple[Column, Column]:
    """The two halves of a caption whose number mark occurs twice (empty without a second one)."""
    mark = F.regexp_extract(text, CAPTION_MARK, 1)
    bare = F.lower(F.regexp_replace(mark, r"\s+", ""))
    again = F.when(mark != "", F.regexp_instr(F.lower(F.substring(text, F.length(mark) + 1, F.length(text))), F.concat(F.regexp_extract(bare, "^([a-z]+)", 1), F.lit(r"\s*"), F.regexp_extract(bare, r"(\d+)", 1), F.lit(r"\."))))
    at = F.when(again > 0, again + F.length(mark))
    return F.coalesce(F.trim(F.substring(text, F.lit(1), at - 1)), F.lit("")), F.coalesce(F.trim(F.substring(text, at, F.length(text))), F.lit(""))
