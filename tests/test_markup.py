"""The stack machine over tags: what ends what, what is left out, and that no text is lost."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.functions.markup import parse


def shown(source, without=frozenset()):
    page = parse(source, without)
    return [("/".join(page.elements[n].tag for n in reversed(list(page.above(r.owner))[:-1])), r.text) for r in page.runs]


@pytest.mark.parametrize(
    ("source", "runs"),
    [
        (None, []),
        ("", []),
        ("<", [("", "<")]),
        ("a<b", [("", "a")]),
        ("a < b &amp; c &#233; &eacute; &amp", [("", "a < b & c é é &")]),
        ("<div>one</div><div><span>t</span>wo</div><p>three", [("div", "one"), ("div", "two"), ("p", "three")]),
        ("<p><b>One.<br><p>Two<br>lines", [("p", "One."), ("p", "Two lines")]),
        ("<p>a<div>b</div>c</p>d", [("p", "a"), ("div", "b"), ("", "c"), ("", "d")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", [("ul/li", "a"), ("ul/li", "b"), ("ul/li/ul/li", "c"), ("ul/li", "d"), ("", "e")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dl/dt", "a"), ("dl/dd", "b"), ("dl/dt", "c")]),
        ("<table><tr><td>a<th>b<tr><td>c<table><tr><td>in</table>d</table>e", [("table/tr/td", "a"), ("table/tr/th", "b"), ("table/tr/td", "c"), ("table/tr/td/table/tr/td", "in"), ("table/tr/td", "d"), ("", "e")]),
        ("<table><tr><td><ul><li>x</table>y", [("table/tr/td/ul/li", "x"), ("", "y")]),
        ("<h1>a<h2>b</h1>c", [("h1", "a"), ("h2", "b"), ("", "c")]),
        ('<script>var a="</p>";if(a<b){}</script><style>p{}</style>x<!-- <p>y</p> -->z<!-->u<!--->v', [("", "xzuv")]),
        ("<script>never ends <p>x", []),
        ("<html><head><title>t</title><meta x><p>a<body>b", [("html/head/title", "t"), ("html/p", "a"), ("html/p/body", "b")]),
        ("<title>T &lt;p&gt; <b></title><textarea><p>x</textarea>", [("title", "T <p> <b>"), ("textarea", "<p>x")]),
        ('<p title="a > b" class=\'c>\'>x</p>', [("p", "x")]),
        ("<P CLASS=x>a</P></div></td></b>b", [("p", "a"), ("", "b")]),
    ],
)
def test_runs(source, runs):
    assert shown(source) == runs


def test_elements_that_are_left_out_do_not_part_the_text_around_them():
    assert shown("<p>a <button>share<i>!</i></button> b<noscript>no</noscript></p>", frozenset({"button", "noscript"})) == [("p", "a b")]


def test_attributes_and_links():
    page = parse('<div CLASS="A b" id=x hidden data-x="1" class=second>t <a href=/u>link</a></div>')
    assert page.elements[1].attributes == {"class": "A b", "id": "x", "hidden": "", "data-x": "1"}
    assert [(r.text, r.linked) for r in page.runs] == [("t link", 4)]


def test_nesting_is_bounded_and_nothing_is_lost():
    page = parse("<div>" * 5000 + "x" + "</div>" * 5000 + "y")
    assert [r.text for r in page.runs] == ["x", "y"] and max(len(list(page.above(r.owner))) for r in page.runs) <= 513


TAGS = st.sampled_from("p b div li ul td tr table a h1 section br span dl dd em".split())
PIECES = st.one_of(st.text("abc &;<", max_size=6).map(lambda t: t.replace("<", "< ")), TAGS.map(lambda t: f"<{t}>"), TAGS.map(lambda t: f"</{t}>"), TAGS.map(lambda t: f'<{t} class="x>y">'))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_every_character_outside_tags_is_kept_in_order(pieces):
    source = "".join(pieces)
    plain = re.sub(r'</?[a-z][a-z0-9]*(?: class="x>y")?>', "", source)
    assert re.sub(r"\s", "", "".join(r.text for r in parse(source).runs)) == re.sub(r"\s", "", plain)
