"""The fixture tables as papers, items, chunks, vectors and query plans, in Spark and in SQL.

Fixture rules, which say nothing about real papers: a document's lines are its items, five to
a page; every two items share a section, named in turn as a paper's would be; the last item of
papers with four or more is a reference list.  Equal texts are one paper (the largest doc_id
stays).  Chunks in order of paper and place get the stored vectors in order of vec_id.  A
benchmark item is a question; its three rarest words, by spelling length and then by letters,
are its keywords; its second question vector is the one 40 places on.

The chunks, with the vector ids of their content, and the lexical index are published once per
application and folder of tables; queries read that store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf import catalog
from sheaf.functions import text as X
from sheaf.operators import chunking, layout

MAX_TOKENS, RESERVE = 160, 64
BUDGET = MAX_TOKENS - RESERVE
SECTION_NAMES = ("Abstract", "1. Introduction", "2. Background", "3. Sparse flow", "4. Experiments", "5. Results and discussion", "6. Conclusion")
KEYWORDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_papers(table(spark, sf_dir, "documents"))


def distinct_papers(documents: DataFrame) -> DataFrame:
    """paper_id, doc_id, paper_title, source, text: one row per distinct text."""
    docs = documents.select("doc_id", "text", "source").withColumn("paper_id", chunking.paper_id(F.col("text")))
    # the copies are told apart by ids alone, and only the ids of those that go meet the texts
    order = Window.partitionBy("paper_id").orderBy(F.desc("doc_id"))
    ids = docs.where("paper_id is not null").select("paper_id", "doc_id")
    ranked = ids.withColumns({"n": F.rank().over(order), "at": F.row_number().over(order)}).where("at > 1")
    more = catalog.written(ranked.select(F.col("doc_id").alias("__doc"), F.col("paper_id").alias("__paper"), (F.col("n") == 1).alias("equal")))
    same = (F.col("paper_id") == F.col("__paper")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    kept = docs.where("paper_id is not null").join(more.where("not equal"), same, "left_anti")
    # rows that share the id too are told apart by nothing; only theirs are gathered
    doubled = more.where("equal").select("__doc", "__paper")
    if doubled.limit(1).count():
        once = kept.join(doubled, same, "left_semi").groupBy("paper_id", "doc_id").agg(F.first("text").alias("text"), F.max("source").alias("source"))
        kept = kept.join(doubled, same, "left_anti").unionByName(once)
    title = F.array_join(F.slice(F.split(X.squeeze("text"), " "), 1, 6), " ")
    return kept.select("paper_id", "doc_id", title.alias("paper_title"), "source", "text")


def items_of(text):
    """The items of a text as an array of (section, text, tokens, page)."""
    listed = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.array(*(F.lit(n) for n in SECTION_NAMES))

    def item(lines, line, i):
        last = (i == F.size(lines) - 1) & (i >= 3)
        section = F.when(last, "References").otherwise(F.element_at(names, F.least(F.floor(i / 2).cast("int"), F.lit(len(SECTION_NAMES) - 1)) + 1))
        return F.struct(section.alias("section"), line.alias("text"), F.size(F.split(X.squeeze(line), " ")).alias("tokens"), (F.floor(i / 5) + 1).cast("int").alias("page"))

    # an array of one, so that the lines are cut once and not again for every item
    return F.flatten(F.transform(F.array(listed), lambda lines: F.transform(lines, lambda line, i: item(lines, line, i))))


def layout_items(sources: DataFrame) -> DataFrame:
    """paper_id, pos, label, text, page of papers with items: each section's name stands as a heading before its first item."""
    # each item goes with the section before it, not with the whole array
    paired = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get("items", i - 1)["section"]).alias("before")))
    rows = sources.select("paper_id", F.posexplode(paired).alias("at", "p")).select("paper_id", "at", F.col("p.x").alias("x"), F.col("p.before").alias("before"))
    before = F.col("before")
    heading = F.struct((2 * F.col("at")).alias("pos"), F.lit("SECTION_HEADER").alias("label"), F.col("x.section").alias("text"), F.col("x.page").alias("page"))
    own = F.struct((2 * F.col("at") + 1).alias("pos"), F.lit("TEXT").alias("label"), F.col("x.text").alias("text"), F.col("x.page").alias("page"))
    both = F.when(F.col("x.section").eqNullSafe(before), F.array(own)).otherwise(F.array(heading, own))
    return rows.select("paper_id", F.explode(both).alias("i")).select("paper_id", "i.*")


def built(sources: DataFrame, numbered: bool = False) -> DataFrame:
    """The chunks of papers (paper_id, paper_title, source, text), with their front matter, and ``numbered`` with vector ids of the content."""
    with_items = sources.select("paper_id", "paper_title", "source", items_of(F.col("text")).alias("items"))
    # front matter is looked for on the first pages only
    first = with_items.select("paper_id", F.filter("items", lambda x: x["page"] <= layout.FIRST_PAGES).alias("items"))
    build = chunking.build_numbered if numbered else chunking.build
    return build(with_items, MAX_TOKENS, RESERVE, layout.front_matter_blocks(layout_items(first)))


_STORES: dict[tuple[str, str, str], catalog.Catalog] = {}


def store(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    """The store of the tables in a folder: papers, chunks, lexical index, vector ids of the content.

    Other documents in the same place have a store of their own.
    """
    key = spark.sparkContext.applicationId, sf_dir, catalog.Files(spark, sf_dir).stamp("documents.parquet")
    held = _STORES.get(key)
    if held is None or held.current() is None:
        held = catalog.Catalog(spark, catalog.shared_folder(spark))
        sources = papers(spark, sf_dir)
        # the titles are made from the texts once
        held.import_papers(catalog.written(sources.drop("text")), built(sources, numbered=True), chunkless=True)
        _STORES[key] = held
    return held


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).table("chunks")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content chunks with vector ids 1, 2, ... in order of paper and place."""
    return chunks(spark, sf_dir).where("section_type = 'content'")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("vector_id"), "embedding")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query, keywords."""
    words = F.array_distinct(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) >= 4))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.transform(F.slice(ranked, 1, KEYWORDS), lambda x: x["w"]).alias("keywords"))


def query_vectors(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("qid"), "embedding").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), "qid")


# The same in SQL, as common table expressions.
PAPERS_SQL = """
papers AS (
  SELECT 'paper_' || substr(sha256(text), 1, 16) AS paper_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, text,
         array_to_string(list_slice(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 6), ' ') AS paper_title
  FROM documents GROUP BY text),
lines AS (
  SELECT paper_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM papers),
items AS (
  SELECT paper_id, i - 1 AS pos, ls[i] AS text, len(ls) AS n_items,
         CASE WHEN i = len(ls) AND i >= 4 THEN 'References'
              ELSE ['Abstract', '1. Introduction', '2. Background', '3. Sparse flow', '4. Experiments', '5. Results and discussion', '6. Conclusion'][least((i - 1) // 2, 6) + 1] END AS section,
         CAST(len(string_split(trim(regexp_replace(ls[i], '\\s+', ' ', 'g')), ' ')) AS INTEGER) AS tokens,
         CAST((i - 1) // 5 + 1 AS INTEGER) AS page
  FROM (SELECT paper_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)),
pieces AS (
  SELECT paper_id, section, page, row_number() OVER (PARTITION BY paper_id ORDER BY pos, k) AS pos,
         CASE WHEN tokens > 96 THEN array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), k * 96 + 1, k * 96 + 96), ' ') ELSE text END AS text,
         CASE WHEN tokens > 96 THEN least(96, tokens - k * 96) ELSE tokens END AS tokens
  FROM (SELECT *, unnest(range(0, CAST(ceil(tokens / 96.0) AS BIGINT))) AS k FROM items)),
packed AS (
  SELECT paper_id, pos, section, text, tokens, page, 0 AS c, tokens AS used FROM pieces WHERE pos = 1
  UNION ALL
  SELECT p.paper_id, p.pos, p.section, p.text, p.tokens, p.page,
         CASE WHEN p.section = q.section AND q.used + p.tokens <= 96 THEN q.c ELSE q.c + 1 END,
         CASE WHEN p.section = q.section AND q.used + p.tokens <= 96 THEN q.used + p.tokens ELSE p.tokens END
  FROM packed q JOIN pieces p ON p.paper_id = q.paper_id AND p.pos = q.pos + 1),
chunks AS (
  SELECT format('{}_chunk_{:04d}', b.paper_id, b.c) AS chunk_id, b.paper_id, papers.paper_title, papers.source, CAST(b.c AS BIGINT) AS chunk_index, b.text AS raw_text, b.section,
         b.tokens AS raw_token_count, b.page_start, b.page_end,
         'Title: ' || papers.paper_title || chr(10) || 'Section: ' || b.section || chr(10) || 'Content: ' || b.text AS embedding_text,
         CASE WHEN b.section = 'References' THEN 'bibliography' ELSE 'content' END AS section_type
  FROM (SELECT paper_id, c, any_value(section) AS section, string_agg(text, chr(10) ORDER BY pos) AS text, CAST(sum(tokens) AS BIGINT) AS tokens, min(page) AS page_start, max(page) AS page_end FROM packed GROUP BY paper_id, c) b
  JOIN papers USING (paper_id))
"""
TERMS_SQL = """
terms AS (
  SELECT chunk_id AS id, section_type, paper_id, col, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos
  FROM (SELECT chunk_id, section_type, paper_id, unnest([0, 1, 2]) AS col,
               unnest([regexp_extract_all(lower(strip_accents(paper_title)), '[\\p{L}\\p{N}\\p{Co}]+'), regexp_extract_all(lower(strip_accents(section)), '[\\p{L}\\p{N}\\p{Co}]+'), regexp_extract_all(lower(strip_accents(raw_text)), '[\\p{L}\\p{N}\\p{Co}]+')]) AS ts
        FROM chunks)),
lens AS (SELECT id, section_type, paper_id, count(*) AS len FROM terms GROUP BY ALL)
"""
QUERIES_SQL = """
qs AS (SELECT item_id AS qid, text AS query, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}\\p{Co}]+') AS ts FROM benchmark),
kws AS (
  SELECT qid, word, row_number() OVER (PARTITION BY qid ORDER BY -length(word), word) AS n
  FROM (SELECT DISTINCT qid, unnest(ts) AS word FROM qs) WHERE length(word) >= 4 QUALIFY n <= 3)
"""


def bm25_sql(name: str, section_type: str, phrases: str, k: int, scope: str | None = None) -> str:
    """BM25 in SQL as tables ``name``: qid, id, score, rank.  ``phrases``: qid, pid, ts; ``scope``: qid, paper_id."""
    join = f"JOIN {scope} sc ON sc.qid = s.qid AND sc.paper_id = s.paper_id" if scope else ""
    return f"""
{name}_p AS (SELECT qid, pid, len(ts) AS n, unnest(ts) AS term, unnest(range(0, len(ts))) AS off FROM ({phrases})),
{name}_o AS (
  SELECT qid, pid, id, col, count(*) AS tf FROM (
    SELECT p.qid, p.pid, t.id, t.col, t.pos - p.off AS start, p.n, count(*) AS c
    FROM terms t JOIN {name}_p p ON p.term = t.term WHERE t.section_type = '{section_type}' GROUP BY ALL) WHERE c = n GROUP BY ALL),
{name}_f AS (SELECT qid, pid, id, sum(CASE col WHEN 0 THEN 0.8 ELSE 1.0 END * tf) AS f FROM {name}_o GROUP BY ALL),
{name}_d AS (SELECT qid, pid, count(*) AS df FROM {name}_f GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens WHERE section_type = '{section_type}'),
{name}_s AS (
  SELECT f.qid, f.id, l.paper_id, sum(-CASE WHEN ln((n.n - d.df + 0.5) / (d.df + 0.5)) > 0 THEN ln((n.n - d.df + 0.5) / (d.df + 0.5)) ELSE 1e-6 END
              * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.len / n.avgdl))) AS score
  FROM {name}_f f JOIN {name}_d d ON d.qid = f.qid AND d.pid = f.pid JOIN lens l ON l.id = f.id CROSS JOIN {name}_n n GROUP BY ALL),
{name} AS (SELECT s.qid, s.id, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 12), s.id) AS rank FROM {name}_s s {join} QUALIFY rank <= {k})
"""


def with_chunks(*more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([PAPERS_SQL, *more])
