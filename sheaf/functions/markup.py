"""HTML as a stack machine: a page's tag stream folded into elements and runs of text.

``parse`` reads one page and never fails on malformed markup: unclosed paragraphs, items and
cells end where a browser ends them, stray end tags are passed over, and a page may stop
anywhere.  Scripts and styles are left out; all other text is kept, each run with the element
that it stands in.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements nested deeper than this are children of the last one that is not, as in browsers.
DEEPEST = 512

# HTML's elements without content, and those that begin and end a block of text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
# For a start tag the open elements that it ends, and those that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "tr": ({"td", "th", "tr", "caption"}, {"thead", "tbody", "tfoot"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, set()),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, set()),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, set()),
}
# Elements beyond which no start or end tag reaches.
SCOPE = frozenset("html table td th caption template object".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())

# Quotes matter after an equals sign only; possessive, so no tag is read twice.
_TAG = re.compile(r"<!--(?:-?>|.*?-->|.*)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}


@dataclass(slots=True)
class Element:
    tag: str
    #: Number of the parent element; -1 for the page itself.
    parent: int
    written: str = ""
    _attributes: dict[str, str] | None = None

    @property
    def attributes(self) -> dict[str, str]:
        """Attributes by lower-case name; of repeated ones the first."""
        if self._attributes is None:
            self._attributes = {}
            for m in _ATTRIBUTE.finditer(self.written):
                self._attributes.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        return self._attributes


@dataclass(slots=True)
class Run:
    """Text between two block boundaries, white space squeezed."""

    #: Number of the innermost block element around it.
    owner: int
    text: str
    #: How many of its characters stand in links.
    linked: int = 0


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)

    def above(self, number: int):
        """An element's number, then its parent's, and so on."""
        while number >= 0:
            yield number
            number = self.elements[number].parent


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Machine:
    def __init__(self, source: str, without: frozenset[str]):
        self.source, self.without = source, without
        self.page = Page([Element("#page", -1)])
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked = self.hidden = 0

    def owner(self) -> int:
        elements = self.page.elements
        for number in reversed(self.stack):
            if elements[number].tag in BLOCK:
                return number
        return 0

    def flush(self) -> None:
        if self.pieces:
            text = squeeze("".join(self.pieces))
            if text:
                self.page.runs.append(Run(self.owner(), text, self.linked))
            self.pieces.clear()
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            plain = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(plain)
            if self.open["a"]:
                self.linked += len(squeeze(plain))

    def push(self, tag: str, written: str) -> None:
        self.page.elements.append(Element(tag, self.stack[-1], written))
        if tag not in VOID and len(self.stack) < DEEPEST:
            self.stack.append(len(self.page.elements) - 1)
            self.open[tag] += 1
            self.hidden += tag in self.without

    def pop_to(self, at: int) -> None:
        for number in self.stack[at:]:
            tag = self.page.elements[number].tag
            self.open[tag] -= 1
            self.hidden -= tag in self.without
        del self.stack[at:]

    def find(self, wanted, barrier) -> int:
        """Place in the stack of the innermost open element with a wanted tag before a barrier; 0 if none."""
        if not any(self.open[t] for t in wanted):
            return 0
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.page.elements[self.stack[at]].tag
            if tag in wanted:
                return at
            if tag in barrier:
                return 0
        return 0

    def start(self, tag: str, written: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in BLOCK:
            self.flush()
        if self.open["head"] and tag not in IN_HEAD and (at := self.find(("head",), ("template",))):
            self.flush()
            self.pop_to(at)
        if tag in ENDS_PARAGRAPH and (at := self.find(("p",), SCOPE | {"button"})):
            self.pop_to(at)
        if tag in HEADINGS and self.page.elements[self.stack[-1]].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            barrier = barrier | {"table"} if tag in TABLE_PARTS else barrier | SCOPE
            while at := self.find(ended, barrier):
                self.pop_to(at)
        if tag == "a" and (at := self.find(("a",), BLOCK)):
            self.pop_to(at)
        self.push(tag, written)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in BLOCK:
            self.flush()
            wanted = HEADINGS if tag in HEADINGS else (tag,)
            barrier = {"table"} if tag in TABLE_PARTS else SCOPE if tag not in ("html", "body") else ()
            if at := self.find(wanted, set(barrier) - {tag}):
                self.pop_to(at)
        elif at := self.find((tag,), BLOCK):
            self.pop_to(at)
        elif tag == "a" and self.open["a"] and (at := self.find((tag,), SCOPE)):
            self.pop_to(at)

    def run(self) -> Page:
        source, at = self.source, 0
        while found := _TAG.search(source, at):
            self.text(source[at : found.start()])
            at = found.end()
            name = found[1]
            if name is None:
                continue
            tag = name.lower()
            if source[found.start() + 1] == "/":
                self.end(tag)
                continue
            self.start(tag, found[2])
            if tag in _RAW and not self.open["svg"]:
                close = _RAW[tag].search(source, at)
                until = close.start() if close else len(source)
                if tag in ("textarea", "title"):
                    self.text(source[at:until])
                at = until
        self.text(source[at:])
        self.flush()
        return self.page


def parse(source: str | None, without: frozenset[str] = frozenset()) -> Page:
    """The elements and runs of text of one page; a null page is empty.

    Text inside the elements ``without`` is left out and does not part the text around it.
    """
    return _Machine(source or "", without).run()
