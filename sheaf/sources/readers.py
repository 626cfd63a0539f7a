"""Sources and sinks: HTML pages as layout items, chunk files, artifacts, PDF folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources import html


def html_items(pages: DataFrame) -> DataFrame:
    """paper_id, pos, label, text, level, depth, headings of what has text in pages (page_id, html); malformed markup is no error."""
    return html.items(html.nodes(pages))


def pdf_files(spark: SparkSession, folder: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """PDF files in order of their paths, each once: path, length, content and its digest.

    Either the files of a folder or an explicit list; other files are refused.
    """
    if (folder is None) == (paths is None):
        raise ValueError("name either a folder or files")
    if paths is not None and (wrong := [p for p in paths if not p.lower().endswith(".pdf")]):
        raise ValueError(f"no PDF file: {wrong[0]}")
    if paths == []:
        raise ValueError("no file is named")
    reader = spark.read.format("binaryFile")
    files = reader.option("pathGlobFilter", "*.[pP][dD][fF]").load(folder) if folder is not None else reader.load(sorted(set(paths)))
    return files.select("path", "length", F.sha2("content", 256).alias("source_sha256"), "content").orderBy("path")


def markdown(items: DataFrame) -> DataFrame:
    """paper_id, markdown of items in order: headings, lists, code and paragraphs."""
    text = F.col("text")
    line = (
        F.when(F.col("label") == "TITLE", F.concat(F.lit("# "), text))
        .when(F.col("label") == "SECTION_HEADER", F.concat(F.lit("## "), text))
        .when(F.col("label") == "LIST_ITEM", F.concat(F.lit("- "), text))
        .when(F.col("label") == "CODE", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("label") == "FORMULA", F.concat(F.lit("$$"), text, F.lit("$$")))
        .otherwise(text)
    )
    return items.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("markdown"))


def write_markdown(items: DataFrame, path: str) -> None:
    """The papers as Markdown, a JSON line each (paper_id, markdown)."""
    markdown(items).write.json(path)


def parse_files(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Run a parser (bytes to item dictionaries) over files; its model is loaded once per worker."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"source_sha256": sha, "pos": i, **item} for sha, content in zip(batch["source_sha256"], batch["content"], strict=True) for i, item in enumerate(parse(content))]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("source_sha256", "content").mapInPandas(run, schema)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines."""
    chunks.write.json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records from JSON lines; blank lines are skipped, anything else that is no record ends the query."""
    from sheaf.schemas import CHUNKS

    # a line that is not read into the record would be silently null with a lenient mode
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object from a file that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_artifact(vectors: DataFrame, path: str, dimension: int) -> str:
    """Vectors (chunk_id, paper_id, chunk_index, embedding_text, embedding) with records and a manifest, written last.

    Returns the snapshot's folder.  Vectors that are not valid end the query before the
    manifest appears, so a reader never takes a half-written artifact.
    """
    import uuid

    from sheaf.catalog import CatalogError, Files
    from sheaf.functions import vector as V
    from sheaf.operators import dense

    spark, name = vectors.sparkSession, f"{path}/artifact-{uuid.uuid4().hex}"
    rows = vectors.select("chunk_id", "paper_id", "chunk_index", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("text_sha256"), "embedding")
    dense.number_rows(rows, "paper_id", "chunk_index").write.parquet(f"{name}/vectors")
    stored = spark.read.parquet(f"{name}/vectors")
    bad = stored.where(V.problem(F.col("embedding"), dimension).isNotNull()).limit(1).collect()
    if bad:
        raise CatalogError(f"vector of {bad[0]['chunk_id']} is not valid")
    line = F.concat_ws("|", "chunk_id", "text_sha256")
    facts = {"count": stored.count(), "dimension": dimension, "fingerprint": dense.fingerprint(stored, line, "vector_id").first()["fingerprint"]}
    Files(spark, name).write_json("manifest.json", facts)
    return name


def read_artifact(spark: SparkSession, name: str) -> DataFrame:
    """Stored vectors after checking them against their manifest."""
    from sheaf.catalog import CatalogError, Files
    from sheaf.operators import dense

    facts = Files(spark, name).read_json("manifest.json")
    if facts is None:
        raise CatalogError("the artifact has no manifest")
    stored = spark.read.parquet(f"{name}/vectors")
    line = F.concat_ws("|", "chunk_id", "text_sha256")
    if stored.count() != facts["count"] or dense.invalid(stored, facts["dimension"]).limit(1).count():
        raise CatalogError("the artifact's vectors do not fit its manifest")
    if dense.fingerprint(stored, line, "vector_id").first()["fingerprint"] != facts["fingerprint"]:
        raise CatalogError("the artifact's records were changed")
    return stored
