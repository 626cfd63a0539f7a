"""Neighbour expansion of hits within their section, window merging and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as X


def windows(seeds: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """For each seed (qid, chunk_id, priority) the window [lo, hi] of chunk indexes around it.

    A window spans ``width`` neighbours each side in the same paper and section and stops at a
    gap.  Without a section a seed stands alone.
    """
    content = chunks.where("section_type = 'content'").select("chunk_id", "paper_id", "section", "chunk_index")
    named = content.where(X.blank_to_null(F.col("section")).isNotNull())
    # only sections with seeds are looked at
    hit = seeds.join(content, "chunk_id")
    wanted = hit.select("paper_id", "section").distinct()
    order = Window.partitionBy("paper_id", "section").orderBy("chunk_index")
    runs = named.join(wanted, ["paper_id", "section"]).withColumn("run", F.col("chunk_index") - F.row_number().over(order))
    whole = Window.partitionBy("paper_id", "section", "run")
    runs = runs.select("chunk_id", F.min("chunk_index").over(whole).alias("first"), F.max("chunk_index").over(whole).alias("last"))
    joined = hit.join(runs, "chunk_id", "left")
    section = F.coalesce(X.blank_to_null(F.col("section")), F.concat(F.lit("\x00"), "chunk_id"))
    c = F.col("chunk_index")
    return joined.select("qid", "chunk_id", "priority", "paper_id", section.alias("section"), F.coalesce(F.greatest(c - width, "first"), c).alias("lo"), F.coalesce(F.least(c + width, "last"), c).alias("hi"))


def merge(spans: DataFrame) -> DataFrame:
    """Windows of a query, paper and section that share a chunk become one: qid, paper_id, section, lo, hi, priority, seeds.

    Adjacent windows without a common chunk stay apart.  Seeds are listed by priority.
    """
    by = Window.partitionBy("qid", "paper_id", "section").orderBy("lo", "hi", "chunk_id")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(by))
    seeds = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "chunk_id"))), lambda s: s["chunk_id"])
    return islands.groupBy("qid", "paper_id", "section", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("priority").alias("priority"), F.array_join(seeds, ",").alias("seeds"))


def groups(merged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Merged windows with their chunks' ids, text, pages and token sum, and their order in the query."""
    content = chunks.where("section_type = 'content'").select("chunk_id", "paper_id", F.coalesce(X.blank_to_null(F.col("section")), F.concat(F.lit("\x00"), "chunk_id")).alias("section"), "chunk_index", "raw_text", "raw_token_count", "page_start", "page_end")
    rows = merged.join(content, ["paper_id", "section"]).where(F.col("chunk_index").between(F.col("lo"), F.col("hi")))
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.trim("raw_text").alias("text"))))
    out = rows.groupBy("qid", "paper_id", "section", "lo", "hi", "priority", "seeds").agg(listed.alias("rows"), F.sum("raw_token_count").alias("tokens"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    out = out.withColumn("chunk_ids", F.array_join(F.transform("rows", lambda r: r["chunk_id"]), ",")).withColumn("text", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")).drop("rows")
    order = Window.partitionBy("qid").orderBy(F.desc("priority"), "paper_id", "section", "chunk_ids")
    return out.withColumn("ord", F.row_number().over(order))


def greedy(items: Column, budget: int) -> Column:
    """Of ordered (ord, tokens) those that a budget takes in turn; what is too large is skipped, later ones may fit."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = item["tokens"] <= state["left"]
        return F.when(fits, F.struct((state["left"] - item["tokens"]).alias("left"), F.concat(state["kept"], F.array(item["ord"].cast("int"))).alias("kept"))).otherwise(state)

    return F.aggregate(items, start, step, lambda s: s["kept"])


def budgeted(ordered: DataFrame, budget: int) -> DataFrame:
    """Groups that fit the budget, with evidence ids E1, E2, ... in their order."""
    kept = ordered.groupBy("qid").agg(greedy(F.array_sort(F.collect_list(F.struct("ord", F.col("tokens").cast("long").alias("tokens")))), budget).alias("kept"))
    chosen = kept.select("qid", F.posexplode("kept").alias("n", "ord"))
    return ordered.join(chosen, ["qid", "ord"]).withColumn("evidence_id", F.concat(F.lit("E"), (F.col("n") + 1).cast("string"))).drop("n")


def units(content: DataFrame, bibliography: DataFrame, most: int) -> DataFrame:
    """E units, then R units of the bibliography hits (qid, chunk_id, rank, ...), at most ``most`` per query."""
    e = content.select("qid", "evidence_id", F.lit("content").alias("kind"), "paper_id", F.when(~F.col("section").startswith("\x00"), F.col("section")).alias("section"), "page_start", "page_end", F.col("seeds").alias("seed_chunk_ids"), "chunk_ids", "text", F.col("tokens").alias("token_count"), F.lit(0).alias("class"), F.col("ord").alias("at"))
    order = Window.partitionBy("qid").orderBy("rank")
    r = bibliography.withColumn("at", F.row_number().over(order)).select("qid", F.concat(F.lit("R"), F.col("at").cast("string")).alias("evidence_id"), F.lit("bibliography").alias("kind"), "paper_id", "section", "page_start", "page_end", F.col("chunk_id").alias("seed_chunk_ids"), F.col("chunk_id").alias("chunk_ids"), F.col("raw_text").alias("text"), X.word_count(F.col("raw_text")).cast("long").alias("token_count"), F.lit(1).alias("class"), "at")
    final = Window.partitionBy("qid").orderBy("class", "at")
    return e.unionByName(r).withColumn("ord", F.row_number().over(final)).where(F.col("ord") <= most).drop("class", "at")


def expand(seeds: DataFrame, chunks: DataFrame, width: int, budget: int) -> DataFrame:
    """Seeds to budgeted content evidence."""
    return budgeted(groups(merge(windows(seeds, chunks, width)), chunks), budget)
