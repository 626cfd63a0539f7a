"""Queries: pages as items, clean-up passes, titles, front matter, store changes and extensions.

Items with the layouts that the passes are about are made from benchmark texts by rules; the
SQL states what each rule must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf import catalog, workspace
from sheaf.functions import text as X
from sheaf.operators import fusion, layout
from sheaf.plans import fixtures as fx
from sheaf.plans.fixtures import with_chunks
from sheaf.plans.retrieval import FUSED_SQL, _fused
from sheaf.sources import html, readers

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


# the fixture's pages, read by their own tags alone: lists stand in ``nav`` only
ITEMS_SQL = r"""
clean AS (
  SELECT page_id::VARCHAR AS paper_id, replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '</?(?:b|a)(?: [^>]*)?>', '', 'g'), '<br>', ' ') AS h FROM pages),
raw AS (
  SELECT paper_id, unnest(regexp_extract_all(h, '<(/?[a-zA-Z0-9!]+)[^>]*>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(h, '<(/?[a-zA-Z0-9!]+)[^>]*>([^<]*)', 2)) AS t,
         unnest(range(0, len(regexp_extract_all(h, '<(/?[a-zA-Z0-9!]+)[^>]*>([^<]*)', 1)))) AS n FROM clean),
plain AS (
  SELECT paper_id, n, tag, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g')) AS text FROM raw),
nodes AS (
  SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY n) - 1 AS INTEGER) AS pos, text,
         CASE tag WHEN 'ul' THEN 'LIST' WHEN 'title' THEN 'TITLE' WHEN 'h1' THEN 'SECTION_HEADER' WHEN 'li' THEN 'PAGE_HEADER' WHEN 'footer' THEN 'PAGE_FOOTER' ELSE 'TEXT' END AS label
  FROM plain WHERE text <> '' OR tag = 'ul'),
items AS (SELECT * FROM nodes WHERE text <> '')
"""
# what the ordered passes leave of pages: all text but that of ``nav`` and ``footer``, and no bare counters
CLEAN_SQL = ITEMS_SQL.replace("coalesce(html, '')", "regexp_replace(coalesce(html, ''), '(?s)<nav>.*?</nav>|<footer>.*?(?:</footer>|$)', '', 'g')") + """,
kept AS (SELECT paper_id, pos, label, text FROM items WHERE NOT regexp_matches(text, '(?i)^(?:page\\s*)?\\d+(?:\\s*(?:of|/)\\s*\\d+)?$'))
"""


@query("html_items", "WITH " + ITEMS_SQL + "SELECT paper_id, pos, label, text FROM items")
def html_items(spark, d):
    return readers.html_items(fx.table(spark, d, "pages")).select("paper_id", "pos", "label", "text")


@query("html_tree", "WITH " + ITEMS_SQL + """
SELECT n.paper_id, n.pos, n.label, n.text, CASE WHEN n.label = 'PAGE_HEADER' THEN l.pos END AS parent_pos, CAST(coalesce(CASE WHEN n.label = 'PAGE_HEADER' THEN l.pos END, n.pos) AS BIGINT) AS root_pos,
       CAST(CASE WHEN n.label IN ('LIST', 'PAGE_HEADER') THEN 1 ELSE 0 END AS INTEGER) AS lists, CASE WHEN n.label = 'SECTION_HEADER' THEN CAST(1 AS INTEGER) END AS level,
       CASE WHEN n.pos > h.pos AND n.label = 'TEXT' THEN h.text ELSE '' END AS section
FROM nodes n LEFT JOIN nodes l ON l.paper_id = n.paper_id AND l.label = 'LIST' LEFT JOIN nodes h ON h.paper_id = n.paper_id AND h.label = 'SECTION_HEADER'""")
def html_tree(spark, d):
    """The tree of every page, with the root that each node hangs below."""
    tree = html.nodes(fx.table(spark, d, "pages"))
    rows = tree.select("paper_id", F.col("pos").cast("long").alias("pos"), F.col("parent_pos").cast("long").alias("parent_pos"))
    roots = layout.flattened(rows).select("paper_id", F.col("pos").cast("int").alias("pos"), "root_pos")
    return tree.join(roots, ["paper_id", "pos"]).select("paper_id", "pos", "label", "text", "parent_pos", "root_pos", F.col("depth").alias("lists"), "level", F.array_join("headings", " > ").alias("section"))


_TABLED_SQL = "WITH " + ITEMS_SQL + ", cells AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS k, text FROM items WHERE label = 'PAGE_HEADER')"


@query("html_tables", _TABLED_SQL + " SELECT paper_id, CAST(k - 1 AS INTEGER) AS row, k = 1 AS header, text AS first, text || ' 8 of' AS second, text AS cleaned FROM cells")
def html_tables(spark, d):
    """Tables made of the entries of each page's menu, two cells a row, the first row a head; counters at the end of cells go."""
    menu = F.regexp_replace(F.regexp_replace("html", "<li>(.*?)</li>", "<tr><td>$1<td>$1 8 of</tr>"), "<ul><tr><td>(.*?)<td>(.*?)</tr>", "<table><caption>Menu</caption><thead><tr><th>$1<th>$2</thead>")
    pages = fx.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(menu, "</ul>", "</table>"), "</?nav>", "").alias("html"))
    found = layout.table_fragments(html.tables(html.nodes(pages)).where(F.col("captions") == F.array(F.lit("Menu")))).withColumnRenamed("grid", "after")
    both = found.join(html.tables(html.nodes(pages)).select("paper_id", "pos", "grid"), ["paper_id", "pos"])
    rows = both.select("paper_id", F.posexplode(F.arrays_zip("grid", "after")).alias("row", "x"))
    return rows.select("paper_id", "row", F.col("x.grid")[0]["column_header"].alias("header"), F.col("x.grid")[0]["text"].alias("first"), F.col("x.grid")[1]["text"].alias("second"), F.col("x.after")[1]["text"].alias("cleaned"))


@query("label_histogram", "WITH " + ITEMS_SQL + "SELECT paper_id, label, count(*) AS n FROM items GROUP BY ALL")
def label_histogram(spark, d):
    return layout.label_histogram(readers.html_items(fx.table(spark, d, "pages")))


@query("pages_clean", "WITH " + CLEAN_SQL + "SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS INTEGER) AS pos, label, text FROM kept")
def pages_clean(spark, d):
    """All passes, in order, over the items of all pages."""
    return layout.clean(readers.html_items(fx.table(spark, d, "pages"))).items.select("paper_id", "pos", "label", "text")


@query("pages_diagnostics", "WITH " + ITEMS_SQL + ", f AS (SELECT paper_id, label, text FROM items WHERE label LIKE 'PAGE%') SELECT paper_id, 'furniture' AS name, count(DISTINCT label || text) AS n FROM f WHERE NOT regexp_matches(text, '(?i)^(?:page\\s*)?\\d+(?:\\s*(?:of|/)\\s*\\d+)?$') GROUP BY paper_id UNION ALL SELECT paper_id, 'furniture_removed', count(*) FROM f GROUP BY paper_id")
def pages_diagnostics(spark, d):
    """What each pass did, per page; passes that found nothing have no row."""
    return layout.clean(readers.html_items(fx.table(spark, d, "pages")), trace=True).diagnostics


@query("pages_markdown", "WITH " + CLEAN_SQL + "SELECT paper_id, sha256(string_agg(CASE label WHEN 'TITLE' THEN '# ' || text WHEN 'SECTION_HEADER' THEN '## ' || text WHEN 'LIST_ITEM' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos)) AS sha FROM kept GROUP BY paper_id")
def pages_markdown(spark, d):
    done = layout.clean(readers.html_items(fx.table(spark, d, "pages")))
    return readers.markdown(done.items).select("paper_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("sha"))


@query("section_paths", with_chunks() + "SELECT chunk_id, 'Part > ' || section AS path, length(section) AS n FROM chunks")
def section_paths(spark, d):
    """Headings to a path and back to its leaf; blank ones are left out."""
    path = X.section_path(F.array(F.lit(" Part "), F.lit("  "), F.col("section")))
    return fx.chunks(spark, d).select("chunk_id", path.alias("path"), F.length(F.trim(F.element_at(F.split(path, ">"), -1))).cast("long").alias("n"))


@query("layout_noise", "SELECT 'paper_' || item_id || '_chunk_0000' AS chunk_id, CASE item_id % 3 WHEN 0 THEN 'Text ' ELSE 'Research Article number ' END || item_id AS raw_text FROM benchmark WHERE item_id % 3 < 2 UNION ALL SELECT 'paper_' || item_id || '_chunk_0000', 'Article' FROM benchmark WHERE item_id % 3 = 2")
def layout_noise(spark, d):
    """A bare label without a section is dropped; a longer one, and one with a section, stay."""
    from sheaf.operators import chunking

    k = F.col("item_id") % 3
    item = lambda section, text, n: F.struct(section.alias("section"), text.alias("text"), F.lit(n).alias("tokens"), F.lit(1).alias("page"))
    none = F.lit(None).cast("string")
    number = F.col("item_id").cast("string")
    rows = F.when(k == 0, F.array(item(none, F.lit("Research  ARTICLE"), 2), item(F.lit("S"), F.concat(F.lit("Text "), number), 2))).when(k == 1, F.array(item(none, F.concat(F.lit("Research Article number "), number), 4))).otherwise(F.array(item(F.lit("S"), F.lit("Article"), 1)))
    papers = fx.table(spark, d, "benchmark").select(F.concat(F.lit("paper_"), number).alias("paper_id"), F.lit("t").alias("paper_title"), F.lit("s").alias("source"), rows.alias("items"))
    return chunking.build(papers, 512).select("chunk_id", "raw_text")


def _bench(spark, d):
    return fx.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("paper_id"), F.col("item_id").alias("i"), "text")


def _made(spark, d, *rows):
    """Items from (label, text) pairs of Columns over i and text, with page 1 unless given."""
    made = F.array(*(F.struct(F.lit(r[0]).alias("label"), r[1].alias("text"), F.lit(r[2] if len(r) > 2 else 1).alias("page")) for r in rows))
    flat = _bench(spark, d).select("paper_id", "i", F.posexplode(F.filter(made, lambda x: x["text"].isNotNull())).alias("pos", "x"))
    return flat.select("paper_id", "i", "pos", "x.label", "x.text", "x.page")


def _name(prefix: str):
    return F.concat(F.lit(prefix), F.col("i").cast("string"))


@query("tree_roots", """
WITH RECURSIVE nodes AS (SELECT doc_id AS pos, CASE WHEN doc_id % 10 <> 0 AND doc_id > 3 THEN doc_id - 1 - doc_id % 3 END AS parent_pos FROM documents),
up AS (SELECT pos, pos AS root_pos, 0 AS depth FROM nodes WHERE parent_pos IS NULL OR parent_pos NOT IN (SELECT pos FROM nodes) UNION ALL SELECT n.pos, u.root_pos, u.depth + 1 FROM nodes n JOIN up u ON n.parent_pos = u.pos)
SELECT pos, root_pos, CAST(depth AS BIGINT) AS depth FROM up""")
def tree_roots(spark, d):
    parent = F.when((F.col("doc_id") % 10 != 0) & (F.col("doc_id") > 3), F.col("doc_id") - 1 - F.col("doc_id") % 3)
    return layout.flattened(fx.table(spark, d, "documents").select(F.lit("p").alias("paper_id"), F.col("doc_id").alias("pos"), parent.alias("parent_pos"))).select("pos", "root_pos", "depth")


@query("page_furniture", "SELECT item_id::VARCHAR AS paper_id, 'Journal of Things ' || item_id AS text, 'header' AS location FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id::VARCHAR, 'Downloaded ' || item_id, 'footer' FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id::VARCHAR, 'Labelled ' || item_id, 'footer' FROM benchmark")
def page_furniture(spark, d):
    return layout.furniture(_furniture_items(spark, d), 800.0)


def _furniture_items(spark, d):
    # a header on three pages (it moves where i is odd), a footer on two where i is a multiple of 3, a repeated body line
    pages = _bench(spark, d).select("paper_id", "i", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    shift = F.when(F.col("i") % 2 == 1, F.col("page") * 20.0).otherwise(0.5 * (F.col("page") % 2))
    box = lambda label, text, top: F.struct(F.lit(label).alias("label"), text.alias("text"), F.lit(50.0).alias("l"), top.alias("t"), F.lit(300.0).alias("r"), (top - 12).alias("b"))
    rows = F.array(
        box("TEXT", F.concat(F.lit("Journal  of Things "), F.col("i").cast("string")), F.lit(740.0) + shift),
        box("TEXT", F.when((F.col("i") % 3 == 0) & (F.col("page") < 3), _name("Downloaded ")).otherwise(F.concat(_name("Only here "), F.lit("."), F.col("page").cast("string"))), F.lit(40.0)),
        box("TEXT", F.substring("text", 1, 30), F.lit(400.0)),
        box("PAGE_FOOTER", _name("Labelled "), F.lit(400.0)),
    )
    flat = pages.select("paper_id", "page", F.posexplode(rows).alias("k", "x"))
    return flat.select("paper_id", (F.col("page") * 10 + F.col("k")).alias("pos"), "x.label", "x.text", "page", "x.l", "x.t", "x.r", "x.b")


@query("furniture_removed", "SELECT item_id::VARCHAR AS paper_id, CAST(3 + CASE WHEN item_id % 2 = 0 THEN 0 ELSE 3 END + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 3 END AS BIGINT) AS n FROM benchmark")
def furniture_removed(spark, d):
    return layout.without_furniture(_furniture_items(spark, d), 800.0).groupBy("paper_id").agg(F.count("*").alias("n"))


HYPHENS = (("humid-\nity", "humidity"), ("low-pres-\nsure", "low-pressure"), ("model-\nbased", "model-based"), ("fore-\ncasting", "forecasting"), ("state-of-the-\nart", "state-of-the-art"), ("graph-\nwave", "graph-wave"), ("forecast-\r\n\r\n ing", "forecasting"), ("n-1", "n-1"))


@query("hyphen_repair", "SELECT item_id, text || ' ' || CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{good}'" for i, (_, good) in enumerate(HYPHENS)) + " END || ' end' AS text FROM benchmark")
def hyphen_repair(spark, d):
    broken = F.element_at(F.array(*(F.lit(b.replace("ity", "i­ ty")) if i == 0 else F.lit(b) for i, (b, _) in enumerate(HYPHENS))), (F.col("item_id") % 8 + 1).cast("int"))
    return fx.table(spark, d, "benchmark").select("item_id", X.repair_hyphens(F.concat("text", F.lit(" "), broken, F.lit(" end"))).alias("text"))


@query("cross_item_hyphens", "SELECT item_id::VARCHAR AS paper_id, k AS pos, CASE k WHEN 0 THEN 'Grows by forecasting' WHEN 1 THEN 'of item ' || item_id || ' and by humidity' ELSE 'rose.' END AS text FROM benchmark, (SELECT unnest([0, 1, 2]) AS k)")
def cross_item_hyphens(spark, d):
    items = _made(spark, d, ("TEXT", F.lit("Grows by fore-")), ("TEXT", F.concat(F.lit("casting of item "), F.col("i").cast("string"), F.lit(" and by humid-"))), ("TEXT", F.lit("ity rose.")))
    return layout.repair_text(items).select("paper_id", "pos", "text")


@query("merged_heading_split", "SELECT item_id::VARCHAR AS paper_id, CASE k WHEN 0 THEN '2. Related Work' WHEN 1 THEN '2.1. Graphs ' || item_id WHEN 2 THEN 'ARTICLE INFO' WHEN 3 THEN '3. One heading only' ELSE 'Text 4. Not split 4.1. Here' END AS text, CASE WHEN k = 4 THEN 'TEXT' ELSE 'SECTION_HEADER' END AS label, k AS pos FROM benchmark, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")
def merged_heading_split(spark, d):
    items = _made(spark, d, ("SECTION_HEADER", F.concat(F.lit("2. Related Work 2.1. Graphs "), F.col("i").cast("string"))), ("SECTION_HEADER", F.lit("A R T I C L E  I N F O")), ("SECTION_HEADER", F.lit("3. One heading only")), ("TEXT", F.lit("Text 4. Not split 4.1. Here")))
    return layout.split_headings(items).select("paper_id", "text", "label", "pos")


@query("list_heading_recovery", "SELECT item_id::VARCHAR AS paper_id, CASE WHEN item_id % 3 = 0 THEN 'LIST_ITEM' ELSE 'SECTION_HEADER' END AS label FROM benchmark")
def list_heading_recovery(spark, d):
    long = F.concat(F.lit("1) "), F.rpad(F.translate("text", "\n", " "), 90, "x"))
    following = F.when(F.col("i") % 3 == 0, F.lit("- 2) second point")).when(F.col("i") % 3 == 1, F.lit("3) wrong number")).otherwise(F.lit("plain"))
    hidden = F.when(F.col("i") % 3 == 2, F.lit("2) but after a heading"))
    items = _made(spark, d, ("SECTION_HEADER", long), ("TEXT", following), ("SECTION_HEADER", F.lit("Next")), ("TEXT", hidden))
    return layout.list_headings(items).where("pos = 0").select("paper_id", "label")


@query("peer_review_removal", "SELECT item_id::VARCHAR AS paper_id, CASE k WHEN 0 THEN text ELSE 'Elsewhere 3 of 11 stays' END AS text FROM benchmark, (SELECT unnest([0, 1]) AS k)")
def peer_review_removal(spark, d):
    rows = F.array(*(F.struct(F.lit(page).alias("page"), F.lit(top).alias("t"), text.alias("text")) for page, top, text in ((1, 780.0, F.lit("Sensors, for PEER  Review")), (1, 780.6, F.lit("fragment")), (1, 500.0, F.concat(F.lit("3 of 11 "), "text")), (2, 780.0, F.lit("Elsewhere 3 of 11 stays")))))
    items = _bench(spark, d).select("paper_id", F.posexplode(rows).alias("pos", "x")).select("paper_id", "pos", F.lit("TEXT").alias("label"), "x.text", "x.page", "x.t")
    return layout.peer_review_removed(items).select("paper_id", "text")


@query("abstract_reorder", "SELECT item_id::VARCHAR AS paper_id, CAST(n AS INTEGER) AS pos, CASE k WHEN 0 THEN 'Title' WHEN 1 THEN '1. Introduction' WHEN 2 THEN 'Intro text' WHEN 3 THEN 'Abstract' WHEN 4 THEN text ELSE 'Right column' END AS text FROM benchmark, (SELECT unnest([0, 3, 4, 1, 2, 5]) AS k, unnest(range(0, 6)) AS n)")
def abstract_reorder(spark, d):
    rows = ((0, "TITLE", F.lit("Title"), 50.0), (1, "SECTION_HEADER", F.lit("1. Introduction"), 300.0), (2, "TEXT", F.lit("Intro text"), 300.0), (3, "SECTION_HEADER", F.lit("Abstract"), 50.0), (4, "TEXT", F.col("text"), 60.0), (5, "TEXT", F.lit("Right column"), 300.0))
    made = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(label).alias("label"), text.alias("text"), F.lit(1).alias("page"), F.lit(left).alias("l")) for k, label, text, left in rows))
    items = _bench(spark, d).select("paper_id", F.explode(made).alias("x")).select("paper_id", "x.*")
    return layout.abstract_first(items).select("paper_id", "pos", "text")


@query("formula_tables", "SELECT item_id::VARCHAR AS paper_id, k AS row, 'x = ' || k || ' \\quad (' || (item_id + k) || ')' AS text FROM benchmark, (SELECT unnest([0, 1]) AS k) WHERE item_id % 3 = 0")
def formula_tables(spark, d):
    # numbers follow each other where i is a multiple of 3, skip one where i mod 3 is 1; others have no equation
    cell = lambda text: F.struct(text.alias("text"), F.lit(False).alias("column_header"))
    row = lambda k: F.array(cell(F.when(F.col("i") % 3 == 2, F.lit("name")).otherwise(F.lit(f"x = {k}"))), cell(F.concat(F.lit("("), (F.col("i") + (k if k == 0 else F.when(F.col("i") % 3 == 1, 2).otherwise(k))).cast("string"), F.lit(")"))))
    tables = _bench(spark, d).select("paper_id", F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("captions"), F.array(row(0), row(1)).alias("grid"))
    return layout.formula_rows(tables).select("paper_id", "row", "text")


@query("formula_cleanup", "SELECT item_id, 'y = ' || item_id || ' \\quad ( 1 2 )' AS text FROM benchmark")
def formula_cleanup(spark, d):
    made = F.concat(F.lit("y = "), F.col("item_id").cast("string"), F.lit(" \\quad ( 1 2 ) "), "text", F.lit("</formula>"))
    return fx.table(spark, d, "benchmark").select("item_id", X.clean_formula(made).alias("text"))


@query("caption_dedup", """
WITH made AS (SELECT item_id, 'Figure 3. ' || rpad(text, 90, 'y') AS once FROM benchmark)
SELECT item_id::VARCHAR AS paper_id, CASE WHEN item_id % 2 = 0 THEN trim(once) ELSE once || ' as in Figure 3. above' END AS text FROM made""")
def caption_dedup(spark, d):
    once = F.concat(F.lit("Figure 3. "), F.rpad("text", 90, "y"))
    items = _made(spark, d, ("CAPTION", F.when(F.col("i") % 2 == 0, F.concat(once, F.lit(" "), once)).otherwise(F.concat(once, F.lit(" as in Figure 3. above")))))
    return layout.captions_once(items).select("paper_id", "text")


@query("table_fragments", "SELECT item_id, text AS cell, text AS body, item_id % 2 = 0 AS counter FROM benchmark")
def table_fragments(spark, d):
    bench = fx.table(spark, d, "benchmark")
    counter = F.when(F.col("item_id") % 4 == 0, "Page 3").when(F.col("item_id") % 2 == 0, "3 / 11").otherwise("3 of them")
    return bench.select("item_id", X.strip_dangling_counter(F.concat("text", F.lit("  8 of "))).alias("cell"), X.strip_page_counter(F.concat(F.lit("page 3 of 11 "), "text")).alias("body"), X.is_page_counter(counter).alias("counter"))


def _title_items(spark, d):
    k = F.col("i") % 4
    at = lambda *cases: F.coalesce(*(F.when(k == n, c) for n, c in cases))
    authors, school = F.lit("Ann Lee, Bob Ray"), F.lit("School of Computing")
    rows = (
        ("TITLE", at((0, _name("Sparse Flow Forecasting Networks ")), (3, _name("Alpha Beta ")))),
        ("SECTION_HEADER", at((1, _name("Journal of Things ")), (2, _name("First heading ")))),
        ("TEXT", at((0, authors), (1, F.lit("journal homepage: www.example.org")))),
        ("TEXT", at((0, school))),
        ("SECTION_HEADER", at((0, F.lit("Abstract")), (1, _name("Sparse Flow Forecasting ")), (2, _name("Second heading ")))),
        ("TITLE", at((3, _name("Alpha Beta Two ")))),
        ("TEXT", at((1, authors))),
        ("TEXT", at((1, F.concat(F.lit("Abstract: "), "text")), (0, F.lit("lower body")), (2, F.lit("lower body")), (3, F.lit("lower body")))),
    )
    return _made(spark, d, *rows)


@query("title_scores", """
SELECT item_id::VARCHAR AS paper_id, pos, score FROM benchmark, (
  SELECT unnest([0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3]) AS k, unnest([0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1, 2, 0, 1, 2]) AS pos,
         unnest([42+2+4+3+12+14+10+16, 3+2+4+3-34+14+10, 3+2+4+3-18+10, -10000, 3+2+4+3, 20+2+4+3-38, -10000, 20+2+4+3+12+10, 3+2+4+3-34+10, -10000, 20+2+4+3, 20+2+4+3, 3+2+4+3, 42+2+4+3, 42+2+4+3, 3+2+4+3]) AS score)
WHERE item_id % 4 = k""")
def title_scores(spark, d):
    return layout.title_candidates(_title_items(spark, d)).select("paper_id", "pos", "score")


@query("title_resolution", "SELECT item_id::VARCHAR AS paper_id, CASE item_id % 4 WHEN 0 THEN 'Sparse Flow Forecasting Networks ' || item_id WHEN 1 THEN 'Sparse Flow Forecasting ' || item_id END AS paper_title, CASE WHEN item_id % 4 < 2 THEN 'front_matter_coherence_scoring' ELSE 'unresolved' END AS title_source FROM benchmark")
def title_resolution(spark, d):
    return layout.resolve_title(layout.title_candidates(_title_items(spark, d)))


@query("authorship_block", "SELECT item_id::VARCHAR AS paper_id, 'Ann Lee, Bob Ray' || chr(10) || 'School of Computing' AS text FROM benchmark WHERE item_id % 4 = 0")
def authorship_block(spark, d):
    items = _title_items(spark, d)
    return layout.authorship(items, layout.resolve_title(layout.title_candidates(items)))


def _front_items(spark, d):
    return _made(
        spark, d, ("TITLE", _name("Title ")), ("TEXT", F.when(F.col("i") % 2 == 1, F.concat(F.lit("Abstract:  "), "text"))), ("SECTION_HEADER", F.when(F.col("i") % 2 == 0, F.lit("A B S T R A C T"))), ("TEXT", F.when(F.col("i") % 2 == 0, F.col("text"))),
        ("SECTION_HEADER", F.lit("Data Availability:")), ("TEXT", F.lit("Under a Creative Commons licence")), ("TEXT", F.lit("At the archive"), 2), ("TEXT", F.lit("* Corresponding author: x@y.z"), 2), ("SECTION_HEADER", F.lit("1. Introduction"), 2), ("TEXT", _name("Received: 1 May "), 2), ("TEXT", F.lit("Accepted: 2 May"), 2), ("TEXT", F.lit("Copyright: 2024 us"), 2), ("TEXT", F.lit("Published: not in the window"), 3),
    )


@query("front_matter_promoted", """
SELECT item_id::VARCHAR AS paper_id, CAST(k AS INTEGER) AS pos, label, t AS text FROM (
  SELECT item_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k,
         unnest(['TITLE', 'SECTION_HEADER', 'TEXT', 'SECTION_HEADER', 'TEXT', 'SECTION_HEADER', 'TEXT', 'SECTION_HEADER', 'TEXT']) AS label,
         unnest(['Title ' || item_id, 'Keywords', trim(text), 'Abstract', 'of ' || item_id, CASE WHEN item_id % 2 = 0 THEN 'Article information' ELSE 'Introduction' END, 'Received first', 'Keywords', 'late']) AS t FROM benchmark)""")
def front_matter_promoted(spark, d):
    """A container of keywords, an inline abstract, and a container that begins with something else."""
    items = _made(
        spark, d, ("TITLE", _name("Title ")), ("SECTION_HEADER", F.lit("ARTICLE INFO")), ("TEXT", F.concat(F.lit("Keywords: "), "text")), ("TEXT", _name("Abstract : of ")),
        ("SECTION_HEADER", F.when(F.col("i") % 2 == 0, F.lit("Article information")).otherwise(F.lit("Introduction"))), ("TEXT", F.lit("Received first")), ("TEXT", F.lit("Index terms: late")),
    )
    return layout.promoted(items.select("paper_id", "pos", "label", "text", "page")).select("paper_id", "pos", "label", "text")


FRONT_SQL = """
blocks AS (
  SELECT item_id::VARCHAR AS paper_id, b.block_type, b.canonical_section, CASE b.block_type WHEN 'abstract' THEN text WHEN 'publication_info' THEN 'Received: 1 May ' || item_id || chr(10) || 'Accepted: 2 May' ELSE b.t END AS text, b.page AS page_start, b.page AS page_end, b.n AS n_items, b.i AS block_index
  FROM benchmark, (SELECT unnest(['abstract', 'rights', 'availability', 'correspondence', 'publication_info', 'rights']) AS block_type,
    unnest(['Front matter > Abstract', 'Front matter > Rights and license', 'Front matter > Availability', 'Front matter > Correspondence', 'Front matter > Publication information', 'Front matter > Rights and license']) AS canonical_section,
    unnest(['', 'Under a Creative Commons licence', 'At the archive', '* Corresponding author: x@y.z', '', 'Copyright: 2024 us']) AS t, unnest([1, 1, 2, 2, 2, 2]) AS page, unnest([1, 1, 1, 1, 2, 1]) AS n, unnest([0, 1, 2, 3, 4, 5]) AS i) b)
"""


@query("front_matter_blocks", "WITH " + FRONT_SQL + "SELECT paper_id, block_type, canonical_section, text, page_start, page_end, CAST(n_items AS BIGINT) AS n_items, block_index FROM blocks")
def front_matter_blocks(spark, d):
    return layout.front_matter_blocks(_front_items(spark, d))


@query("front_matter_chunk_type", "SELECT item_id || '-' || k AS chunk_id, CASE k WHEN 0 THEN 'abstract' WHEN 1 THEN 'rights' WHEN 3 THEN 'rights' END AS front_matter_type FROM benchmark, (SELECT unnest([0, 1, 3]) AS k)")
def front_matter_chunk_type(spark, d):
    blocks = layout.front_matter_blocks(_front_items(spark, d))
    # sections with spaced letters, with pages that meet a block, with pages that don't, without pages
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(section).alias("section"), F.lit(a).cast("int").alias("page_start"), F.lit(b).cast("int").alias("page_end")) for k, section, a, b in ((0, "A B S T R A C T", 1, 2), (1, "Front matter > Rights and License:", 2, 2), (2, "Abstract", 5, 6), (3, "rights and license", None, None), (4, "Results", 1, 1))))
    chunks = _bench(spark, d).select("paper_id", F.explode(rows).alias("x")).select("paper_id", F.concat_ws("-", "paper_id", "x.k").alias("chunk_id"), "x.section", "x.page_start", "x.page_end")
    return layout.front_matter_types(chunks, blocks)


@query("front_matter_labels", "SELECT item_id, 'keywords' AS heading, 'abstract' AS inline, trim(text) AS content, CASE WHEN item_id % 2 = 0 THEN 'publication_info' END AS publication FROM benchmark")
def front_matter_labels(spark, d):
    inline = F.concat(F.lit("ABSTRACT : "), "text")
    label = F.when(F.col("item_id") % 2 == 0, "Academic Editor: X").otherwise("Editor in chief: X")
    return fx.table(spark, d, "benchmark").select("item_id", layout.heading_type(F.lit("Key words and  Phrases")).alias("heading"), layout.inline_type(inline).alias("inline"), layout.inline_content(inline).alias("content"), layout.publication_type(label).alias("publication"))


@query("heading_rules", with_chunks() + "SELECT chunk_id, section = 'References' AS bibliography, lower(regexp_replace(section, '^[0-9]+\\. ', '')) AS leaf, CASE WHEN section LIKE '_. %' THEN CAST(substr(section, 1, 1) AS INTEGER) END AS chapter FROM chunks")
def heading_rules(spark, d):
    from sheaf.operators import overview

    path = F.concat(F.lit("Part > "), "section")
    return fx.chunks(spark, d).select("chunk_id", X.is_bibliography(path).alias("bibliography"), X.section_leaf(path).alias("leaf"), overview.top_number(F.col("section")).alias("chapter"))


@query("replace_import", with_chunks() + "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM chunks JOIN papers USING (paper_id) WHERE doc_id % 2 = 1 OR chunk_index = 0")
def replace_import(spark, d):
    chunks = fx.chunks(spark, d).select("chunk_id", "paper_id", "chunk_index", F.lit("old").alias("origin"))
    again = chunks.join(fx.papers(spark, d).where("doc_id % 2 = 0").select("paper_id"), "paper_id").where("chunk_index = 0").withColumn("origin", F.lit("new"))
    return catalog.replaced(chunks, again).select("chunk_id", "origin")


@query("migrate_bibliography_split", with_chunks() + "SELECT section_type, count(*) AS n FROM chunks GROUP BY section_type")
def migrate_bibliography_split(spark, d):
    old = fx.chunks(spark, d).withColumn("section_type", F.lit("content"))
    return catalog.migrate(old, 3).groupBy("section_type").agg(F.count("*").alias("n"))


@query("workspace_content_index", with_chunks() + "SELECT chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS vector_id FROM chunks WHERE section_type = 'content'")
def workspace_content_index(spark, d):
    return workspace.numbered(fx.chunks(spark, d)).select("chunk_id", "vector_id")


@query("chunk_jsonl_roundtrip", with_chunks() + "SELECT chunk_id, chunk_index, section, sha256(raw_text) AS sha FROM chunks")
def chunk_jsonl_roundtrip(spark, d):
    path = catalog.shared_folder(spark)
    readers.write_chunks(fx.chunks(spark, d), path)
    return readers.read_chunks(spark, path).select("chunk_id", "chunk_index", "section", F.sha2(F.col("raw_text").cast("binary"), 256).alias("sha"))


@query("stable_json", with_chunks() + "SELECT paper_id, '{\"chunks\":\"' || count(*) || '\",\"tokens\":\"' || sum(raw_token_count)::BIGINT || '\"}' AS json, 'x-' || regexp_replace(any_value(paper_id), '[^A-Za-z0-9]+', '-', 'g') || '-' || substr(sha256('x ' || any_value(paper_id)), 1, 10) AS slug FROM chunks GROUP BY paper_id")
def stable_json(spark, d):
    from sheaf.functions import json as J

    totals = fx.chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("n"), F.sum("raw_token_count").alias("t"))
    return totals.select("paper_id", J.stable_json(F.create_map(F.lit("tokens"), F.col("t").cast("string"), F.lit("chunks"), F.col("n").cast("string"))).alias("json"), X.slug(F.concat(F.lit("x "), "paper_id")).alias("slug"))


# extensions: what becomes cheap once many questions and papers are handled at once
@query("per_paper_topk", FUSED_SQL + "SELECT qid, paper_id, chunk_id, CAST(row_number() OVER (PARTITION BY qid, paper_id ORDER BY pre_rank) AS INTEGER) AS n FROM fused JOIN chunks USING (chunk_id) QUALIFY n <= 2")
def per_paper_topk(spark, d):
    fused, chunks = _fused(spark, d)
    return fusion.per_paper(fused, chunks, 2)


@query("paper_discovery", FUSED_SQL + "SELECT qid, paper_id, count(*) AS n_chunks, round(sum(fused_score), 9) AS mass, round(max(fused_score), 9) AS best FROM fused JOIN chunks USING (chunk_id) GROUP BY ALL")
def paper_discovery(spark, d):
    fused, chunks = _fused(spark, d)
    return fusion.papers_found(fused, chunks).select("qid", "paper_id", "n_chunks", F.round("mass", 9).alias("mass"), F.round("best", 9).alias("best"))


@query("paper_coverage_check", FUSED_SQL + "SELECT qid, count(DISTINCT paper_id) AS n_papers, round(max(c)::DOUBLE / sum(c), 9) AS top_share FROM (SELECT qid, paper_id, count(*) AS c FROM fused JOIN chunks USING (chunk_id) WHERE pre_rank <= 10 GROUP BY ALL) GROUP BY qid")
def paper_coverage_check(spark, d):
    fused, chunks = _fused(spark, d)
    return fusion.coverage(fused, chunks, 10).select("qid", "n_papers", F.round("top_share", 9).alias("top_share"))


@query("stream_ingest", "SELECT 'paper_' || substr(sha256(text), 1, 16) AS paper_id, max(doc_id) AS doc_id FROM documents GROUP BY text")
def stream_ingest(spark, d):
    from sheaf.streaming import ingest

    return ingest.run_once(spark, f"{d}/documents.parquet", catalog.shared_folder(spark))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    from sheaf.streaming import ingest

    return ingest.event_windows(spark, f"{d}/events.parquet", catalog.shared_folder(spark))


