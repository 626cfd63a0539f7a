"""Operator 11 against a plain reading of the fixture's pages, and pages of other makes."""

import html as entities
import re

import pytest

from sheaf.llm import extraction, queries
from tests.llm.fixtures import table

SAYS = "The quick brown fox, as ever, jumped over the lazy dog. It was a fine day; nobody minded."


def by_the_book(page):
    """The fixture's articles, by their own tags alone."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", body.replace("<br>", " "))
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_query_equals_the_articles_of_the_fixture(spark, sf):
    want = {r["page_id"]: (r["url"], by_the_book(r["html"])) for r in table(spark, sf, "pages").collect()}
    got = queries.QUERIES["op11_main_text"](spark, sf).collect()
    assert len(got) == len(want) and all((r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def blocks(*ks):
    return [" ".join([SAYS] * k) + f" End {k}." for k in ks]


PARAGRAPHS = "".join(f"<p>{b}</p>" for b in blocks(3, 1, 4, 2))
WANTED = ["Title here", *blocks(3, 1, 4, 2)]
MENU = "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Sports</a></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><header><h2>Site</h2></header><nav>{MENU}</nav><article><h1>Title here</h1>{PARAGRAPHS}</article><aside><p>{SAYS}</p></aside><footer>&copy; x</footer>",
        f"<body><div id=top><div class=logo>Site name</div>{MENU}</div><div id=content><h1>Title here</h1>{PARAGRAPHS}</div><div id=sidebar><h3>Side</h3><p>{SAYS}</p></div><div id=footer>Copyright 2020 all rights.</div>",
        f"<body><div>Site name</div><div><a href=a>Home</a> <a href=b>News</a></div><div><h1>Title here</h1>{PARAGRAPHS.replace('<p>', '<div>').replace('</p>', '</div>')}</div><div>Copyright 2020.</div>",
        f"<body><main><article class='post comments-open'><h1>Title here</h1>{PARAGRAPHS}</article><section class=comments><h2>2 comments</h2><article class=comment><p>{SAYS * 2}</p></article><article class=comment><p>{SAYS * 9}</p></article></section></main>",
        f"<body><div class=post><h1>Title here</h1><div class=entry-content>{PARAGRAPHS}</div></div><div id=comments><ol class=commentlist><li>{SAYS * 20}</ol></div>",
        f"<body><form id=aspnet><div class=nav><a href=x>x</a></div><div class=main><h1>Title here</h1>{PARAGRAPHS}</div></form>",
        f"<body><div class='cookie-banner'><p>{SAYS} cookies</p><button>OK</button></div><div class=wrap><h1>Title here</h1>{PARAGRAPHS}<form><p>{SAYS}</p><input></form></div><div role=contentinfo>foot</div>",
        f"<table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h1>Title here</h1>{PARAGRAPHS}</td><td>Ads by x</td></tr></table>",
        f"<body><div class=head><h1>Title here</h1></div><div class=c>{PARAGRAPHS}</div>",
        f"<html><head><title>t</title><h1>Title here</h1>{PARAGRAPHS}",
        f"<article><h1>Title here</h1>{PARAGRAPHS}<div class='ad-slot'>{SAYS} buy</div><div class='share-buttons'><a href=x>Post</a></div><div hidden>{SAYS}</div><p style='display: none'>{SAYS}</p><section class=comments><p>{SAYS * 9}</p></section><script>x('<p>{SAYS}</p>')</script><!-- <p>{SAYS}</p> --></article>",
        f"<article><h1>Title&nbsp;here</h1>{PARAGRAPHS.replace('<p>', '<p><b>').replace('</p>', '<br>')}",
    ],
    ids=["tags", "ids", "divs", "comments", "comment list", "form", "cookies", "table", "headline apart", "head not closed", "inside", "broken"],
)
def test_pages_of_other_makes(page):
    assert extraction.main_text(page).split("\n") == WANTED


def test_everything_of_the_article_is_kept():
    page = f"<body>{MENU}<div id=x><h1>Title</h1><p>{SAYS}</p><h2>Section</h2><ol><li>{SAYS}<li>b</ol><table><caption>C</caption><tr><td>1<td>2</table><pre>code  here</pre><p>Ok.</p><blockquote>{SAYS}</blockquote></div>"
    assert extraction.main_text(page).split("\n") == ["Title", SAYS, "Section", SAYS, "b", "C", "1", "2", "code here", "Ok.", SAYS]
    science = f"<article><h1>T</h1><section id=related-work><h2 id=related-work>Related work</h2><p>{SAYS}</p></section><section id=comments-on-method><p>{SAYS}</p></section></article>"
    assert extraction.main_text(science).split("\n") == ["T", "Related work", SAYS, SAYS]


def test_paths_are_smoothed_and_fused():
    import numpy as np

    assert np.allclose(extraction.smoothed(np.ones(7)), 1) and extraction.smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2
    # long text with marks, a menu of short entries, one path each
    score, least = extraction.scores(np.array([0, 0, 0, 1, 1, 1]), np.array([5, 6, 4, 300, 200, 400.0]), np.array([0, 0, 0, 4, 3, 5.0]))
    assert score[1] > least > score[0]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    long = f"<article><h1>T</h1>{'<p>' + SAYS + '</p>'}" * 20_000
    given = [(1, "u", None), (2, None, ""), (None, "u", "<p>only"), (4, "u", "<nav>menu</nav>"), (4, "u", "<nav>menu</nav>"), (5, "u", "<"), (6, "u", "plain & simple"), (7, "u", long), (8, "u", "<div>" * 3000 + "deep"), (9, "u", "<article><p>a😀</p></article>".encode("utf-16", "surrogatepass").decode("utf-16"))]
    rows = spark.createDataFrame(given, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    out = extraction.extract(rows)
    got = {(r["page_id"], r["url"]): r["text"] for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(given)
    assert got[1, "u"] == got[2, None] == got[4, "u"] == "" and got[None, "u"] == "only" and got[5, "u"] == "<" and got[6, "u"] == "plain & simple" and got[8, "u"] == "deep" and got[9, "u"] == "a\U0001f600"
    assert got[7, "u"].count(SAYS) == 20_000
    assert extraction.extract(rows.limit(0)).count() == 0
