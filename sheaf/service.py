"""Retrieval, expansion and answers over a store, for batches of questions at once.

The steps are the operators; this module is their order.  Models are handed in as factories
and have deterministic stand-ins, so a service runs without any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import adaptors, prompts
from sheaf.catalog import Catalog, CatalogError
from sheaf.config import Settings
from sheaf.functions import text as X
from sheaf.operators import answers, context, dense, fusion, lexical
from sheaf.storage import written

#: States of reranking.
RERANKED, NOT_RERANKED, RERANK_OFF = "success", "fallback", "disabled"


@dataclass(frozen=True)
class Retrieved:
    """plans: a row per question; hits: ranked chunks (ids, scores, sources), without texts."""

    plans: DataFrame
    hits: DataFrame


@dataclass(frozen=True)
class Service:
    """Answers questions (qid, query, turns) from a store with published vectors.

    ``turns``: earlier turns as an array of texts, or null.  ``rewriter`` and ``drafter`` add a
    ``payload`` to questions; ``reranker`` is a factory of adaptors.Reranker.
    """

    store: Catalog
    settings: Settings = field(default_factory=Settings)
    embedder: Callable[[], adaptors.Embedder] = adaptors.HashEmbedder
    instruction: str = ""
    rewriter: Callable[[DataFrame], DataFrame] | None = None
    reranker: Callable[[], adaptors.Reranker] | None = None
    drafter: Callable[[DataFrame], DataFrame] | None = None

    def plan(self, questions: DataFrame) -> DataFrame:
        """qid, original_query, semantic_query, keywords, search_bibliography, status."""
        rewrite = self.settings.retrieval.rewrite
        if not rewrite.enabled:
            return answers.unplanned(questions)
        turns = F.slice(F.coalesce("turns", F.expr("cast(array() as array<string>)")), -F.least(F.size("turns"), F.lit(rewrite.max_context_turns)), rewrite.max_context_turns)
        asked = questions.withColumn("turns", F.when(F.coalesce(F.size("turns"), F.lit(0)) > 0, turns)) if rewrite.max_context_turns else questions.withColumn("turns", F.lit(None).cast("array<string>"))
        payloads = self.rewriter(asked) if self.rewriter else adaptors.rewrite_offline(asked, rewrite.max_keywords)
        return answers.rewrite_plan(payloads, rewrite.max_keywords)

    def retrieve(self, questions: DataFrame, limit: int | None = None) -> Retrieved:
        """Four routes fused, reranked, with reference lists where the plan asks for them; at most ``limit`` hits a question."""
        s = self.settings
        chunks, vectors = self.store.table("chunks"), self.store.table("vectors")
        if vectors is None:
            raise CatalogError("no index is published")
        plans = written(self.plan(questions))
        fused = written(fusion.fuse(self._pool(plans, chunks, vectors), s.retrieval.rrf_k))
        size = s.reranking.final_top_k if s.reranking.enabled else s.retrieval.fused_top_k
        ranked = fusion.rerank(fused, self._scores(fused, plans, chunks), s.reranking.candidate_top_k)
        target = fusion.best_paper(fused, chunks).select("qid", "paper_id")
        wanted = plans.where("search_bibliography").join(target, "qid")
        # without keywords the rewritten question is searched, if there is one
        texts = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array(F.coalesce("semantic_query", "original_query")))
        most = s.retrieval.rewrite.bibliography_top_k
        found = lexical.search_scoped(self.store.index().of("bibliography"), wanted.select("qid", "paper_id", texts.alias("texts")), most, s.bm25).withColumnRenamed("id", "chunk_id")
        final = fusion.quota(ranked, found, plans, size, most, limit)
        hits = fusion.detailed(final, ranked)
        state = F.lit(RERANK_OFF) if not s.reranking.enabled else F.when(F.max(F.col("rerank_score").isNotNull()), RERANKED).otherwise(NOT_RERANKED)
        states = ranked.groupBy("qid").agg(state.alias("reranking_status")) if s.reranking.enabled else plans.select("qid", state.alias("reranking_status"))
        return Retrieved(plans.join(states, "qid", "left"), hits)

    def _pool(self, plans: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
        r, index = self.settings.retrieval, self.store.index().of("content")
        ids = chunks.select("chunk_id", "section_type", "vector_id")

        def near(text: str, name: str, weight: float) -> DataFrame:
            asked = plans.select("qid", F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
            embedded = adaptors.embed_queries(asked, self.embedder, self.instruction)
            return fusion.dense_route(dense.search(vectors.select("vector_id", "embedding"), embedded, r.dense_top_k), ids, name, weight)

        def words(texts, name: str, weight: float, k: int) -> DataFrame:
            return fusion.route(lexical.search(index, plans.select("qid", texts.alias("texts")), k, self.settings.bm25).withColumnRenamed("id", "chunk_id"), name, weight)

        return fusion.pool(
            near("original_query", "dense_original", r.dense_original_weight),
            near("semantic_query", "dense_rewrite", r.dense_rewrite_weight),
            words(F.array("original_query"), "bm25_original", r.bm25_original_weight, r.bm25_original_top_k),
            words(F.col("keywords"), "bm25_rewrite", r.bm25_rewrite_weight, r.bm25_rewrite_top_k),
        )

    def _scores(self, fused: DataFrame, plans: DataFrame, chunks: DataFrame) -> DataFrame | None:
        s = self.settings.reranking
        if not s.enabled:
            return None
        asked = plans.select("qid", F.coalesce("semantic_query", "original_query").alias("query"))
        if self.reranker is None:
            return fusion.overlap_scores(fused, asked, chunks, s.candidate_top_k)
        passage = X.passage(F.col("paper_title"), F.col("section"), F.col("raw_text")).alias("passage")
        wanted = fused.where(F.col("pre_rank") <= s.candidate_top_k).select("qid", "chunk_id")
        return adaptors.rerank(wanted.join(chunks.select("chunk_id", passage), "chunk_id").join(asked, "qid"), self.reranker)

    def records(self, found: Retrieved) -> DataFrame:
        """The hits as full records (qid, rank, json)."""
        plans = found.plans.select("qid", "original_query", "semantic_query", "keywords")
        return fusion.to_json(found.hits.join(self.store.table("chunks").select(*fusion.RECORD_COLUMNS), "chunk_id").join(plans, "qid"))

    def evidence(self, found: Retrieved) -> DataFrame:
        """Evidence units of the hits: content expanded within its section, then references, numbered."""
        s, chunks = self.settings, self.store.table("chunks")
        content = found.hits.where("section_type = 'content'")
        # a reranked hit's score is its priority, any other's its place
        seeds = content.select("qid", "chunk_id", F.coalesce("rerank_score", (-F.col("final_rank")).cast("double")).alias("priority"))
        width = s.context.neighbor_window if s.context.enabled else 0
        groups = context.expand(seeds, chunks, width, s.context.max_total_tokens)
        refs = found.hits.where("section_type = 'bibliography'").select("qid", "chunk_id", F.col("final_rank").alias("rank"))
        return context.units(groups, refs.join(chunks.drop("section_type"), "chunk_id"), s.answer.max_evidence_units)

    def _titles(self) -> DataFrame | None:
        documents = self.store.table("documents")
        return documents.select("paper_id", "paper_title") if documents is not None and "paper_title" in documents.columns else None

    def answer(self, questions: DataFrame, limit: int | None = None) -> DataFrame:
        """qid and the whole outcome as JSON: plan, states, answer, citations, hits and evidence."""
        found = self.retrieve(questions, limit)
        found = Retrieved(written(found.plans), written(found.hits))
        units = written(self.evidence(found))
        turns = F.filter(F.coalesce("turns", F.expr("cast(array() as array<string>)")), lambda t: F.length(F.trim(t)) > 0)
        asked = questions.select("qid", "query", turns.alias("turns"), F.size(turns).alias("n_context"))
        states = answers.status(asked, units, self.settings.answer.enabled)
        ready = states.where("status = 'ready'").select("qid").join(asked, "qid").join(answers.prompt(units, self._titles()), "qid")
        user = ready.select("qid", prompts.answer(F.col("query"), F.col("prompt"), F.col("turns")).alias("query"))
        none = F.lit(None).cast("string")
        drafts = answers.parse_drafts(self.drafter(user) if self.drafter else user.withColumn("payload", none))
        outcome = answers.finish(states, drafts, units)
        return answers.outcome_json(questions.select("qid", "query"), found.plans, outcome, self.records(found), units)
