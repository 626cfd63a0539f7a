"""Documents and pages as papers of the store: what is in them, and nothing made up.

A document's text is its lines, without sections or pages; a page is its cleaned items under
their headings.  A paper is named by its content, and of equal contents one is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.catalog import Catalog, written
from sheaf.config import Settings
from sheaf.functions import text as X
from sheaf.operators import chunking, layout
from sheaf.sources import html

ITEM = "struct<section:string,text:string,tokens:int,page:int,header:string>"


@dataclass(frozen=True)
class Papers:
    """paper_id, paper_title, title_source, source, source_sha256, items; and front-matter blocks, where there can be some."""

    papers: DataFrame
    blocks: DataFrame | None = None


def from_documents(documents: DataFrame) -> Papers:
    """Documents (doc_id, text, source): a line is an item; blank documents are left out.

    Plain text names no title, so there is none.  Of equal texts the smallest doc_id's source counts.
    """
    known = documents.where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    once = known.groupBy(chunking.paper_id(F.col("text")).alias("paper_id")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("first"))
    # each text is joined once, by the id of its first document
    texts = known.select("doc_id", "text", chunking.paper_id(F.col("text")).alias("paper_id")).dropDuplicates(["paper_id", "doc_id"])
    rows = once.select("paper_id", F.col("first.doc_id").alias("doc_id"), "first.source").join(texts, ["paper_id", "doc_id"])
    lines = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: X.squeeze(x) != "")
    item = lambda x: F.struct(F.lit(None).cast("string").alias("section"), x.alias("text"), X.word_count(x).cast("int").alias("tokens"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("header"))
    none = F.lit(None).cast("string")
    return Papers(rows.select("paper_id", none.alias("paper_title"), F.lit("unresolved").alias("title_source"), F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.transform(lines, item).alias("items")))


def sections(items: DataFrame) -> DataFrame:
    """Items with their heading path: the last heading of each level that no later one of a smaller level has ended.

    Headings without a level are of the first.
    """
    order = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.when(F.col("label") == "SECTION_HEADER", F.coalesce("level", F.lit(1)))
    marked = items.withColumn("__level", level)
    last = [F.max(F.when(F.col("__level") == k, F.struct("pos", "text"))).over(order).alias(f"__h{k}") for k in range(1, 7)]
    seen = marked.select("*", *last)
    path, above = [], F.lit(-1)
    for k in range(1, 7):
        at = F.coalesce(F.col(f"__h{k}.pos"), F.lit(-1))
        path.append(F.when(at > above, F.col(f"__h{k}.text")))
        above = F.greatest(above, at)
    named = X.section_path(F.filter(F.array(*path), lambda h: h.isNotNull()))
    return seen.withColumn("section", named).drop("__level", *(f"__h{k}" for k in range(1, 7)))


def from_pages(pages: DataFrame, settings: Settings) -> Papers:
    """Pages (page_id, html, and url where there are some): cleaned items under their headings; the headings go into the paths.

    The title is the one that clean-up finds, else the page's own ``title``.  Pages without any
    text are left out; of equal pages the smallest page_id's URL counts.
    """
    known = (pages if "url" in pages.columns else pages.withColumn("url", F.lit(None).cast("string"))).where(F.length(F.trim("html")) > 0)
    digest = F.sha2(F.col("html").cast("binary"), 256)
    once = known.groupBy(digest.alias("source_sha256")).agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))
    first = written(once.join(known.select("page_id", digest.alias("source_sha256"), "html").dropDuplicates(["page_id", "source_sha256"]), ["page_id", "source_sha256"]))
    # equal ids may carry different pages: a page is named by its content from here on
    named = first.withColumn("paper_id", chunking.paper_id(F.col("html")))
    tree = written(html.nodes(named.select(F.col("paper_id").alias("page_id"), "html")))
    tables = html.tables(tree)
    done = layout.clean(html.items(tree), tables, most_pages=settings.parsing.front_matter_max_pages, least_list_chars=settings.parsing.list_heading_min_chars)
    head = tables.select("paper_id", F.when(F.exists(F.get("grid", F.lit(0)), lambda c: c["column_header"]), layout.table_text(F.slice("grid", 1, 1))).alias("header"), layout.table_text("grid").alias("text"))
    kept = sections(done.items).where(~F.col("label").isin("TITLE", "SECTION_HEADER"))
    kept = kept.join(head.where("header is not null").dropDuplicates(["paper_id", "text"]), ["paper_id", "text"], "left")
    item = F.struct("pos", "section", "text", X.word_count(F.col("text")).cast("int").alias("tokens"), F.lit(None).cast("int").alias("page"), "header")
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in ("section", "text", "tokens", "page", "header"))))
    rows = kept.groupBy("paper_id").agg(items.alias("items"))
    own = tree.where("label = 'TITLE'").groupBy("paper_id").agg(F.min_by("text", "pos").alias("own"))
    titled = done.titles.join(own, "paper_id", "full")
    source = F.when(F.col("paper_title").isNotNull(), F.col("title_source")).when(F.col("own").isNotNull(), "page_title").otherwise("unresolved")
    titles = titled.select("paper_id", F.coalesce("paper_title", "own").alias("paper_title"), source.alias("title_source"))
    papers = rows.join(named.select("paper_id", F.coalesce("url", F.lit("")).alias("source"), "source_sha256"), "paper_id").join(titles, "paper_id", "left")
    return Papers(papers.select("paper_id", "paper_title", F.coalesce("title_source", F.lit("unresolved")).alias("title_source"), "source", "source_sha256", "items"), done.blocks)


def into(held: Catalog, found: Papers, settings: Settings, source: tuple[str, int] | None = None) -> str:
    """Chunk papers by the settings and import them; papers of which no chunk is left are not imported."""
    chunker = chunking.chunker(settings.chunking)
    papers = written(found.papers)
    chunks = written(chunker.chunk(papers, found.blocks).withColumn("vector_id", F.lit(None).cast("long")))
    documents = papers.drop("items").withColumn("chunker_id", F.lit(chunker.chunker_id)).join(chunks.select("paper_id").distinct(), "paper_id", "left_semi")
    return held.import_papers(documents, chunks, source=source)
