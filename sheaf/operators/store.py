"""Access paths of the store: lookups, filters, joins and summaries as plain relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.storage import CatalogError


def document(documents: DataFrame, paper: str) -> DataFrame:
    return documents.where(F.col("paper_id") == paper)


def chunks_of(chunks: DataFrame, paper: str) -> DataFrame:
    return chunks.where(F.col("paper_id") == paper).orderBy("chunk_index")


def front_matter(chunks: DataFrame, paper: str | None = None) -> DataFrame:
    """Front-matter chunks of one paper or of all."""
    found = chunks.where("content_kind = 'front_matter'")
    return found if paper is None else found.where(F.col("paper_id") == paper).orderBy("chunk_index")


def embedding_inputs(chunks: DataFrame) -> DataFrame:
    """Content chunks to embed; an assigned vector ends the query, and so does a store without content."""
    content = chunks.where("section_type = 'content'")
    if not content.limit(1).count():
        raise CatalogError("there is no content to embed")
    return content.select("chunk_id", "paper_id", "chunk_index", F.when(F.col("vector_id").isNull(), F.col("embedding_text")).otherwise(F.raise_error(F.lit("vectors are assigned already"))).alias("embedding_text"))


def by_vector_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Content chunks with the given vector ids (each once; ids under 1 end the query)."""
    wanted = ids.select(F.when(F.col("vector_id") >= 1, F.col("vector_id")).otherwise(F.raise_error(F.lit("vector ids start at 1")).cast("long")).alias("vector_id")).distinct()
    return chunks.where("section_type = 'content'").join(wanted, "vector_id")


def with_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("paper_id", "source_filename", "source_sha256"), "paper_id")


def in_section(chunks: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Content chunks of (paper_id, section) pairs, with their documents."""
    return with_document(chunks.where("section_type = 'content'").join(sections.select("paper_id", "section").distinct(), ["paper_id", "section"]), documents)


def indexed_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What an index holds of each chunk: the document's title stands in for a missing one.

    Only chunks without a title meet the documents; the texts of the others stay where they are.
    """
    titles = documents.where("paper_title is not null").select("paper_id", F.col("paper_title").alias("document_title"))
    held = lambda rows, title: rows.select("chunk_id", "paper_id", F.coalesce(title, F.lit("")).alias("paper_title"), F.coalesce("section", F.lit("")).alias("section"), "raw_text", "section_type")
    lacking = chunks.where("paper_title is null").join(titles, "paper_id", "left")
    return held(chunks.where("paper_title is not null"), F.col("paper_title")).unionByName(held(lacking, F.col("document_title")))


def row_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def histogram(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def import_summary(chunks: DataFrame) -> DataFrame:
    """Per paper: chunks by kind and type."""
    return chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("content_kind") == "front_matter").alias("n_front_matter"), F.count_if(F.col("section_type") == "bibliography").alias("n_bibliography"))


def last_turns(conversations: DataFrame, n: int) -> DataFrame:
    """The last n non-blank turns of each conversation in order, white space collapsed."""
    from pyspark.sql import Window

    from sheaf.functions import text as X

    clean = conversations.select("conv_id", "turn", X.squeeze(F.coalesce("text", F.lit(""))).alias("text")).where("text != ''")
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return clean.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n).select("conv_id", "turn", "text", "back")
