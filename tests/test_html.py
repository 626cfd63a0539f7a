"""Pages as trees: headings, lists, tables and furniture; every character is kept."""

import re

import pytest
from pyspark.sql import functions as F

from sheaf.operators import layout
from sheaf.sources import html


def tree(spark, *pages):
    return html.nodes(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string"))


def rows(spark, page, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in tree(spark, page).orderBy("pos").collect()]


def test_div_is_transparent_and_regions_are_furniture(spark):
    page = "<title>T</title><header><div>Site</div></header><nav><ul><li>Home</ul></nav><div>The main text of this page stands in a div.</div><div><span>More text</span></div><p>Para<div role=complementary>side</div><article><header><h1>Head</h1>by me</header><p>x</p><footer>notes</footer></article><aside>a</aside><footer>f</footer><div role=contentinfo>g</div>"
    assert rows(spark, page, "label", "text") == [
        ("TITLE", "T"), ("PAGE_HEADER", "Site"), ("LIST", ""), ("PAGE_HEADER", "Home"), ("TEXT", "The main text of this page stands in a div."), ("TEXT", "More text"), ("TEXT", "Para"), ("PAGE_HEADER", "side"),
        ("SECTION_HEADER", "Head"), ("TEXT", "by me"), ("TEXT", "x"), ("TEXT", "notes"), ("PAGE_HEADER", "a"), ("PAGE_FOOTER", "f"), ("PAGE_FOOTER", "g"),
    ]


def test_a_header_with_the_headline_is_no_furniture(spark):
    assert rows(spark, "<header><h1>Head</h1>by</header><p>x", "label") == ["SECTION_HEADER", "TEXT", "TEXT"]


def test_heading_paths_and_levels(spark):
    page = "<p>a<h1>A</h1><p>b<h3>B</h3><p>c<h2>C</h2><p>d<h1>D</h1><p>e"
    got = {text: (level, headings) for text, level, headings in rows(spark, page, "text", "level", "headings")}
    assert got["a"] == (None, []) and got["b"] == (None, ["A"]) and got["c"] == (None, ["A", "B"]) and got["d"] == (None, ["A", "C"]) and got["e"] == (None, ["D"]) and got["B"] == (3, ["A"])


def test_lists_nest_and_point_to_their_parents(spark):
    page = "<ul><li>a<ol><li>b<li><p>c</ol><li>d</ul><p>e"
    got = rows(spark, page, "pos", "parent_pos", "label", "text", "depth")
    assert got == [(0, None, "LIST", "", 1), (1, 0, "LIST_ITEM", "a", 1), (2, 0, "LIST", "", 2), (3, 2, "LIST_ITEM", "b", 2), (4, 2, "LIST_ITEM", "c", 2), (5, 0, "LIST_ITEM", "d", 1), (6, None, "TEXT", "e", 0)]
    flat = {r["pos"]: (r["root_pos"], r["depth"]) for r in layout.flattened(tree(spark, page).select("paper_id", F.col("pos").cast("long").alias("pos"), F.col("parent_pos").cast("long").alias("parent_pos"))).collect()}
    assert flat == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 2), 4: (0, 2), 5: (0, 1), 6: (6, 0)}


def grid(spark, page):
    found = html.tables(tree(spark, page)).collect()
    return [(t["captions"], [[c["text"] for c in row] for row in t["grid"]]) for t in found]


def test_tables_are_grids(spark):
    page = "<p>x<table><caption>Cap</caption><thead><tr><th>A<th>B</thead><tr><td rowspan=2>1<td>2<tr><td>3 <b>bold</b><tr><td colspan=2><ul><li>p<li>q</ul></table>y"
    assert grid(spark, page) == [(["Cap"], [["A", "B"], ["1", "2"], ["1", "3 bold"], ["p q", "p q"]])]
    assert rows(spark, page, "label", "text") == [("TEXT", "x"), ("TABLE", ""), ("CAPTION", "Cap"), ("LIST", ""), ("TEXT", "y")]
    texts = [r["text"] for r in html.items(tree(spark, page)).orderBy("pos").collect()]
    assert texts == ["x", "A | B\n1 | 2\n1 | 3 bold\np q", "Cap", "y"]


def test_tables_that_arrange_a_page_are_none(spark):
    assert grid(spark, "<table><tr><td><h1>H</h1><p>x<td>y</table>") == [] and grid(spark, "<table><tr><td>only</table>") == [] and grid(spark, "<table role=presentation><tr><td>a<td>b</table>") == []
    inner = "<table><tr><td>menu<td><table><tr><td>1<td>2</table></table>"
    assert grid(spark, inner) == [([], [["1", "2"]])] and [t for t in rows(spark, inner, "text") if t] == ["menu"]


def test_spans_are_bounded(spark):
    assert grid(spark, "<table><tr><td rowspan=99999 colspan=2>a<td>b<tr><td>c</table>") == [([], [["a", "a", "b"], ["a", "a", "c"]])]
    assert len(grid(spark, "<table><tr><td colspan=999999999999>a<td>b</table>")[0][1][0]) == 1001


def test_equation_tables_and_page_counters_from_pages(spark):
    made = tree(spark, "<table><tr><td>a = b<td>(1)<tr><td>c = d<td>(2)</table>", "<table><tr><td>x<td>values 8 of<tr><td>y<td>7 of 11 samples</table>")
    found = html.tables(made)
    assert [(r["paper_id"], r["text"]) for r in layout.formula_rows(found).orderBy("row").collect()] == [("0", "a = b \\quad (1)"), ("0", "c = d \\quad (2)")]
    assert [[c["text"] for c in row] for r in layout.table_fragments(found).where("paper_id = '1'").collect() for row in r["grid"]] == [["x", "values"], ["y", "7 of 11 samples"]]
    done = layout.clean(html.items(made), found, trace=True)
    assert sorted((r["paper_id"], r["label"], r["text"]) for r in done.items.collect()) == [("0", "FORMULA", "a = b \\quad (1)"), ("0", "FORMULA", "c = d \\quad (2)"), ("1", "TABLE", "x | values\ny | 7 of 11 samples")]
    assert {(r["paper_id"], r["name"]): r["n"] for r in done.diagnostics.collect()}["1", "table_fragments"] == 1


def test_no_character_is_lost(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["paper_id"]: r["t"] for r in html.items(html.nodes(pages)).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("t")).collect()}
    import html as entities

    for r in pages.collect():
        plain = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r["html"])
        plain = entities.unescape(re.sub(r"<[^>]*>", "", plain))
        assert re.sub(r"\s", "", got[str(r["page_id"])]) == re.sub(r"\s", "", plain)


@pytest.mark.parametrize("page", [None, "", "<", "<table>", "<ul>", "<li>x", "<table><tr></table>", "<td>x", "<table><tr><td>a<td></table>"])
def test_awkward_pages(spark, page):
    got = "".join(r["text"] for r in html.items(tree(spark, page)).collect())
    assert got == re.sub(r"<[a-z/][^>]*>?", "", page or "")
