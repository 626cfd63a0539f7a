"""Weighted reciprocal-rank fusion, reranking, bibliography target and output quotas.

Texts stay out of all ranking: hits carry ids, ranks and scores, and the chunk columns are
joined to the final rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as X

ROUTES = ("dense_original", "dense_rewrite", "bm25_original", "bm25_rewrite")


def route(hits: DataFrame, name: str, weight: float, score: str = "score") -> DataFrame:
    """Hits (qid, chunk_id, rank, score) as rows of one route."""
    return hits.select("qid", F.lit(name).alias("route"), "chunk_id", F.col("rank").cast("int").alias("rank"), F.col(score).cast("double").alias("raw_score"), F.lit(float(weight)).alias("weight"))


def dense_route(hits: DataFrame, chunks: DataFrame, name: str, weight: float) -> DataFrame:
    """Vector hits (qid, vector_id, score, rank) joined to content; ids without a chunk leave gaps in the ranks."""
    known = chunks.where("section_type = 'content' and vector_id is not null").select("vector_id", "chunk_id")
    return route(hits.where("vector_id >= 1").join(known, "vector_id"), name, weight)


def pool(*routes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, routes)


def fuse(hits: DataFrame, rrf_k: int) -> DataFrame:
    """qid, chunk_id, fused_score, sources, pre_rank: a route counts once per chunk, with its best rank."""
    once = hits.groupBy("qid", "chunk_id", "route").agg(F.min(F.struct("rank", "raw_score", "weight")).alias("h"))
    order = {name: i for i, name in enumerate(ROUTES)}
    place = F.coalesce(*(F.when(F.col("route") == name, i) for name, i in order.items()), F.lit(len(order)))
    term = F.col("h.weight") / (rrf_k + F.col("h.rank"))
    source = F.struct(place.alias("place"), "route", F.col("h.rank").alias("rank"), F.col("h.raw_score").alias("raw_score"), F.col("h.weight").alias("weight"), term.alias("term"))
    listed = once.groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    # summed in the routes' order, so the score does not depend on how rows arrive
    total = F.aggregate("sources", F.lit(0.0), lambda t, s: t + s["term"])
    scored = listed.select("qid", "chunk_id", total.alias("fused_score"), "sources")
    # equal sums of other routes' terms differ in their last bits
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("fused_score", 12)), "chunk_id")
    return scored.withColumn("pre_rank", F.row_number().over(by))


def best_paper(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, paper_id: the paper with the largest sum of fused scores; equal sums by paper_id."""
    mass = fused.join(chunks.select("chunk_id", "paper_id"), "chunk_id").groupBy("qid", "paper_id").agg(F.sum("fused_score").alias("mass"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("mass", 12)), "paper_id")
    return mass.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "paper_id", "mass")


def rerank(fused: DataFrame, scored: DataFrame | None, candidates: int) -> DataFrame:
    """Final order: the first ``candidates`` by rerank score, then the rest as they were.

    ``scored``: qid, chunk_id, rerank_score for the candidates.  Without it, or for queries
    where the reranker failed (no scores), the fused order stays.
    """
    if scored is None:
        return fused.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.col("pre_rank"))
    inside = F.col("pre_rank") <= candidates
    joined = fused.join(scored, ["qid", "chunk_id"], "left").withColumn("rerank_score", F.when(inside, F.col("rerank_score")))
    order = Window.partitionBy("qid").orderBy(F.when(inside, 0).otherwise(1), F.desc_nulls_last("rerank_score"), F.desc(F.round("fused_score", 12)), "chunk_id")
    return joined.withColumn("rank", F.row_number().over(order))


def overlap_scores(fused: DataFrame, queries: DataFrame, chunks: DataFrame, candidates: int) -> DataFrame:
    """The offline reranker: share of the query's terms in the passage; only candidates are read."""
    wanted = fused.where(F.col("pre_rank") <= candidates).select("qid", "chunk_id")
    texts = wanted.join(chunks.select("chunk_id", X.passage(F.col("paper_title"), F.col("section"), F.col("raw_text")).alias("passage")), "chunk_id").join(queries.select("qid", "query"), "qid")
    terms = F.array_distinct(X.tokens(F.col("query")))
    share = F.size(F.array_intersect(terms, X.tokens(F.col("passage")))) / F.greatest(F.size(terms), F.lit(1))
    return texts.select("qid", "chunk_id", share.cast("double").alias("rerank_score"))


def per_paper(fused: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k hits of each paper for each question: qid, paper_id, chunk_id, n."""
    rows = fused.join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    order = Window.partitionBy("qid", "paper_id").orderBy("pre_rank")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("qid", "paper_id", "chunk_id", "n")


def papers_found(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question and paper: hits, sum and best of their fused scores."""
    rows = fused.join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    return rows.groupBy("qid", "paper_id").agg(F.count("*").alias("n_chunks"), F.sum("fused_score").alias("mass"), F.max("fused_score").alias("best"))


def coverage(fused: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Per question: papers among its first hits, and the share of hits that the most frequent has."""
    rows = fused.where(F.col("pre_rank") <= most).join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    counts = rows.groupBy("qid", "paper_id").agg(F.count("*").alias("c"))
    return counts.groupBy("qid").agg(F.count("*").alias("n_papers"), (F.max("c") / F.sum("c")).alias("top_share"))


def quota(ranked: DataFrame, bibliography: DataFrame, plans: DataFrame, final_top_k: int, bibliography_top_k: int, result_limit: int | None = None) -> DataFrame:
    """Content first, then bibliography hits, within the limit; ranks from 1 (``route_rank``: the rank in its own list).

    ``bibliography``: qid, chunk_id, rank, and its BM25 score where there is one, which becomes
    ``raw_score``.  ``plans``: qid, search_bibliography.  The limit is ``result_limit`` or else final_top_k
    plus, where the bibliography is searched, bibliography_top_k.  Bibliography hits take up
    to their own limit and content what is left.
    """
    found_score = F.col("score").cast("double") if "score" in bibliography.columns else F.lit(None).cast("double")
    refs = bibliography.select("qid", "chunk_id", "rank", found_score.alias("raw_score")).join(plans.where("search_bibliography").select("qid"), "qid")
    counts = refs.groupBy("qid").agg(F.count("*").alias("n_hits"))
    limit = F.lit(result_limit) if result_limit is not None else F.lit(final_top_k) + F.when(F.col("search_bibliography"), bibliography_top_k).otherwise(0)
    limits = plans.join(counts, "qid", "left").select("qid", limit.alias("limit"), F.least(F.coalesce("n_hits", F.lit(0)), F.lit(bibliography_top_k), limit).alias("n_bib"))
    content = ranked.join(limits, "qid").where(F.col("rank") <= F.col("limit") - F.col("n_bib")).select("qid", "chunk_id", F.lit("content").alias("section_type"), F.lit(0).alias("class"), F.col("rank").alias("at"), "fused_score", F.lit(None).cast("double").alias("raw_score"))
    found = refs.join(limits, "qid").where(F.col("rank") <= F.col("n_bib")).select("qid", "chunk_id", F.lit("bibliography").alias("section_type"), F.lit(1).alias("class"), F.col("rank").alias("at"), F.lit(0.0).alias("fused_score"), "raw_score")
    order = Window.partitionBy("qid").orderBy("class", "at")
    return content.unionByName(found).withColumn("final_rank", F.row_number().over(order)).withColumnRenamed("at", "route_rank").drop("class")


def detailed(final: DataFrame, ranked: DataFrame) -> DataFrame:
    """Final hits with what led to them: pre_rank, rerank_score and sources of content, one route without weight of references."""
    joined = final.join(ranked.select("qid", "chunk_id", "pre_rank", "rerank_score", "sources"), ["qid", "chunk_id"], "left")
    direct = bibliography_source(F.col("route_rank").cast("int"), F.col("raw_score"))
    return joined.withColumn("sources", F.when(F.col("section_type") == "bibliography", direct).otherwise(F.col("sources")))


#: What a result record takes from its chunk.
RECORD_COLUMNS = ("chunk_id", "vector_id", "paper_id", "paper_title", "section", "content_kind", "front_matter_type", "page_start", "page_end", "raw_text")


def bibliography_source(rank: Column, score: Column) -> Column:
    """The sources of a reference hit: one route with its BM25 score, without weight."""
    return F.array(F.struct(F.lit(len(ROUTES)).alias("place"), F.lit("bm25_bibliography").alias("route"), rank.alias("rank"), F.coalesce(score, F.lit(0.0)).alias("raw_score"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("term")))


def asked(route: Column) -> Column:
    """What a route searched for, of a plan (original_query, semantic_query, keywords): keywords as one query of alternatives."""
    words = F.array_join("keywords", " OR ")
    rewritten = F.coalesce("semantic_query", "original_query")
    return (
        F.when(route == "dense_rewrite", F.col("semantic_query"))
        .when(route == "bm25_rewrite", words)
        .when(route == "bm25_bibliography", F.when(F.size("keywords") > 0, words).otherwise(rewritten))
        .otherwise(F.col("original_query"))
    )


def to_json(rows: DataFrame, text_limit: int = 500) -> DataFrame:
    """qid, rank, json: hits joined with their chunks and plans as full records, texts cut to their first characters."""
    sources = F.transform("sources", lambda s: F.struct(s["route"].alias("route"), asked(s["route"]).alias("query"), s["rank"].alias("rank"), s["raw_score"].alias("raw_score"), s["weight"].alias("effective_weight")))
    fields = [F.col("final_rank").cast("long").alias("rank"), "chunk_id", "vector_id", "paper_id", "paper_title", "section", "content_kind", "front_matter_type", "section_type", "page_start", "page_end", F.substring("raw_text", 1, text_limit).alias("raw_text")]
    fields += [F.col("pre_rank").cast("long").alias("pre_rerank_rank"), "rerank_score", "fused_score", sources.alias("source_matches")]
    return rows.select("qid", F.col("final_rank").cast("long").alias("rank"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
