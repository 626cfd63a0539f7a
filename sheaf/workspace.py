"""Isolated workspaces: one paper's chunks, vectors and overview context in a folder of their own."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.adaptors import Embedder, embed
from sheaf.catalog import CatalogError, Files
from sheaf.config import Overview
from sheaf.operators import chunking, dense, overview
from sheaf.storage import written

PREFIX = "workspace_"


def check_id(name: str) -> str:
    """A workspace id has the prefix and no separators, so it can't leave its parent."""
    if not re.fullmatch(PREFIX + "[0-9a-f]{32}", name):
        raise CatalogError(f"no workspace id: {name!r}")
    return name


def numbered(chunks: DataFrame) -> DataFrame:
    """The content chunks with vector ids 1, 2, ... within their paper."""
    from pyspark.sql import Window

    order = Window.partitionBy("paper_id").orderBy("chunk_index")
    return chunks.where("section_type = 'content'").withColumn("vector_id", F.row_number().over(order).cast("long"))


def create(chunks: DataFrame, parent: str, factory, source_sha256: str) -> str:
    """Write a workspace for the chunks of one paper and publish it by one rename; returns its id.

    Only content is embedded and indexed; reference lists stay lexical.
    """
    spark = chunks.sparkSession
    papers = chunks.select("paper_id").distinct().limit(2).collect()
    if len(papers) != 1:
        raise CatalogError("a workspace holds one paper")
    if chunking.violations(chunks).limit(1).count():
        raise CatalogError("the chunks break rules")
    content = chunks.where("section_type = 'content'")
    if not content.limit(1).count():
        raise CatalogError("the paper has no content")
    name, files = PREFIX + uuid.uuid4().hex, Files(spark, parent)
    hidden = f".{name}"
    chunks.write.parquet(f"{parent}/{hidden}/chunks")
    # one paper: its chunks are few
    vectors = numbered(embed(content.select("chunk_id", "paper_id", "chunk_index", "section_type", "embedding_text"), factory))
    vectors.select("vector_id", "chunk_id", "embedding").write.parquet(f"{parent}/{hidden}/vectors")
    count = spark.read.parquet(f"{parent}/{hidden}/vectors").count()
    Files(spark, f"{parent}/{hidden}").write_json("manifest.json", {"workspace_id": name, "paper_id": papers[0]["paper_id"], "source_sha256": source_sha256, "vectors": count})
    if not files.fs.rename(files._path(hidden), files._path(name)):
        raise CatalogError("the workspace could not be published")
    return name


def open_chunks(spark: SparkSession, parent: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{parent}/{check_id(name)}/chunks")


def search(spark: SparkSession, parent: str, name: str, query: str, model: Embedder, k: int = 5, instruction: str = "") -> DataFrame:
    """The chunks of the workspace nearest to a question."""
    vector = [float(x) for x in model.embed_queries([query], instruction)[0]]
    queries = spark.createDataFrame([(0, vector)], "qid long, embedding array<float>")
    vectors = spark.read.parquet(f"{parent}/{check_id(name)}/vectors")
    return dense.search(vectors, queries, k).join(vectors.select("vector_id", "chunk_id"), "vector_id").select("chunk_id", "score", "rank")


def delete(spark: SparkSession, parent: str, name: str) -> None:
    """Delete a workspace; anything that is none is refused."""
    files = Files(spark, parent)
    if not files.exists(f"{check_id(name)}/manifest.json"):
        raise CatalogError(f"{name} is no workspace here")
    files.delete(name)


def write_overview(spark: SparkSession, parent: str, name: str, payload: str, title: str | None, settings: Overview = Overview(), now: datetime | None = None) -> dict:
    """Check a drafted overview (a model's JSON) against the workspace's context and keep both as JSON; returns the overview.

    The title must be the paper's.  Each field's sections are those of the chunks that it cites.
    A draft that breaks a rule is refused and nothing is written.
    """
    context = overview_context(open_chunks(spark, parent, name), settings).orderBy("ord").collect()
    row = spark.createDataFrame([(payload, title)], "payload string, title string").select(overview.parse_draft(F.col("payload")).alias("d"), F.col("title")).select("d", overview.title_problem(F.col("d.paper_title"), F.col("title")).alias("problem")).first()
    if row["d"] is None:
        raise CatalogError("the draft is no overview")
    if row["problem"]:
        raise CatalogError(f"the draft's {row['problem']}")
    fields = spark.createDataFrame([("p", f["field"], f["content"] or "", f["source_chunk_ids"] or []) for f in row["d"]["fields"]], "paper_id string, field string, content string, source_chunk_ids array<string>")
    known = spark.createDataFrame([("p", r["chunk_id"], r["section"]) for r in context], "paper_id string, chunk_id string, section string")
    checked = {r["field"]: r for r in overview.validate(fields, known).collect()}
    if bad := sorted(f"{f}: {r['problem']}" for f, r in checked.items() if r["problem"]):
        raise CatalogError("the draft breaks rules: " + ", ".join(bad))
    result = {"paper_title": row["d"]["paper_title"].strip(), **{f: {"content": checked[f]["content"], "source_chunk_ids": list(checked[f]["ids"]), "source_sections": list(checked[f]["sections"])} for f in overview.ROLES}}
    chosen = [{"chunk_id": r["chunk_id"], "section": r["section"], "category": r["category"], "overview_roles": (r["roles"] or "").split(","), "token_count": r["tokens"]} for r in context]
    files = Files(spark, f"{parent}/{check_id(name)}")
    # The keys of the two files are a format
    made = (now or datetime.now(timezone.utc)).isoformat()
    files.write_json("context.json", {"created_at": made, "paper_title": title, "selected_chunks": chosen, "final_token_count": sum(r["tokens"] for r in context), "token_budget": settings.max_total_context_tokens})
    files.write_json("overview.json", result)
    return result


def overview_context(chunks: DataFrame, settings: Overview = Overview()) -> DataFrame:
    """Selected chunks with their cut texts in reading order; the first chunks where no role finds any."""
    placed = overview.candidates(chunks)
    # stored, for the papers without a selected chunk are told by it too
    selected = written(overview.select(overview.role_top(overview.role_scores(placed), settings), settings))
    every = selected.unionByName(overview.fallback(placed, selected, settings)) if settings.max_fallback_chunks else selected
    texts = placed.select("chunk_id", F.coalesce(F.trim("section"), F.lit(overview.NO_SECTION)).alias("section"), overview.context_text(settings).alias("text"))
    return every.join(texts, "chunk_id")
