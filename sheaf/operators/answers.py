"""Query planning rules, rewrite clean-up, and the answer state machine with its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import json as J
from sheaf.functions import text as X

# Questions about a numbered reference.
NUMBERED = r"\[\s*\d{1,4}\s*\]\s*(?:是|是哪|对应|什么|which|what)"
# Expressions that ask for citations.
REFERENCE_PATTERNS = (
    r"参考文献",
    r"文献列表",
    r"参考书目",
    r"(?:有没有|是否|有无|是否有).{0,30}引用",
    r"引用了?(?:哪些|什么|哪篇|哪个|谁|.*吗|.*？|.*\?)",
    r"(?:cite|cited|cites|citation|citations|references|bibliography|works cited|literature cited)",
)
# Expressions that ask for content.
CONTENT_PATTERNS = (
    r"(?:有什么|有何|哪些|如何|怎么).{0,20}(?:区别|不同|差异|优势|劣势)",
    r"(?:比较|对比|区别|不同|差异|优于|为什么比)",
    r"(?:baseline|baselines|基线)",
    r"(?:如何|怎么|怎样).{0,20}(?:构建|建立|训练|实现|计算|预测)",
    r"(?:方法|模型).{0,20}(?:为什么|如何|怎么)",
)
# References to one paper that does not stand in the question.
DEICTIC = ("这篇论文", "本文", "该论文", "该文", "this paper", "the paper")
# What is said instead of an answer.
INSUFFICIENT_TEXT = "当前检索到的论文证据不足以回答该问题。"
AMBIGUOUS_TEXT = "问题中的论文对象不明确；当前检索到多个论文来源，请指定论文标题后再提问。"


def bibliography_rule(query: Column) -> Column:
    """True for questions about references, false for ones about content, null where rules don't tell."""
    text = F.lower(X.squeeze(query))
    return F.when(text.rlike(NUMBERED) | text.rlike("|".join(REFERENCE_PATTERNS)), True).when(text.rlike("|".join(CONTENT_PATTERNS)), False)


def bibliography_decision(query: Column, model: Column) -> Column:
    return F.coalesce(bibliography_rule(query), model)


def keywords(values: Column, most: int) -> Column:
    """Keywords trimmed, blank ones dropped, equal ones (case aside) once, at most so many."""
    return F.slice(X.first_seen_folded(values), 1, most)


def semantic_query(value: Column) -> Column:
    clean = F.trim(value)
    return F.when(F.length(clean) > 0, clean)


def rewrite_plan(queries: DataFrame, most_keywords: int) -> DataFrame:
    """Plans from queries (qid, query, payload): the model's JSON, or the question alone where it is not valid.

    The payload must have exactly the keys semantic_query, lexical_keywords_en and
    search_bibliography with their types.
    """
    raw = F.col("payload")
    fine = J.has_exactly(raw, ("semantic_query", "lexical_keywords_en", "search_bibliography")) & J.has_types(raw, {"semantic_query": ("STRING", "VOID"), "search_bibliography": ("BOOLEAN",), "lexical_keywords_en": ("ARRAY<STRING>", "ARRAY<VOID>")})
    parsed = F.from_json(raw, "semantic_query string, lexical_keywords_en array<string>, search_bibliography boolean")
    out = queries.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("p", F.when(F.col("fine"), parsed))
    rule = bibliography_rule(F.col("query"))
    return out.select(
        "qid",
        X.squeeze("query").alias("original_query"),
        semantic_query(F.col("p.semantic_query")).alias("semantic_query"),
        F.coalesce(keywords(F.col("p.lexical_keywords_en"), most_keywords), F.expr("cast(array() as array<string>)")).alias("keywords"),
        F.when(F.col("fine"), F.coalesce(rule, F.col("p.search_bibliography"))).otherwise(F.coalesce(rule, F.lit(False))).alias("search_bibliography"),
        F.when(F.col("fine"), "success").otherwise("fallback").alias("status"),
    )


def unplanned(questions: DataFrame) -> DataFrame:
    """Plans where rewriting is off: the question alone, with the rules for references."""
    return questions.select(
        "qid", X.squeeze("query").alias("original_query"), F.lit(None).cast("string").alias("semantic_query"), F.expr("cast(array() as array<string>)").alias("keywords"),
        F.coalesce(bibliography_rule(F.col("query")), F.lit(False)).alias("search_bibliography"), F.lit("disabled").alias("status"),
    )


def is_deictic(query: Column) -> Column:
    text = F.lower(X.squeeze(query))
    out = F.lit(False)
    for p in DEICTIC:
        out = out | F.contains(text, F.lit(p))
    return out


def answer_problem(answer: Column, citations: Column, insufficient: Column, allowed: Column) -> Column:
    """Why an answer is refused, or null.  Labels in the text must be allowed and cited."""
    cited, labels = X.first_seen(citations), X.citation_labels(answer)
    return (
        F.when(F.length(F.trim(F.coalesce(answer, F.lit("")))) == 0, "blank answer")
        .when(F.size(F.array_except(cited, allowed)) > 0, "unknown citation")
        .when(F.size(F.array_except(labels, allowed)) > 0, "unknown label")
        .when(F.size(F.array_except(labels, cited)) > 0, "label not cited")
        .when(~insufficient & (F.size(cited) == 0), "no citation")
    )


def status(queries: DataFrame, evidence: DataFrame, enabled: bool = True) -> DataFrame:
    """qid and the answer's state before the model: disabled, insufficient_evidence, ambiguous_paper or ready.

    ``queries``: qid, query, n_context (earlier turns); ``evidence``: qid, paper_id.
    """
    found = evidence.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))
    joined = queries.join(found, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    state = F.lit("disabled") if not enabled else F.when(n == 0, "insufficient_evidence").when((F.col("n_context") == 0) & is_deictic(F.col("query")) & (F.col("papers") > 1), "ambiguous_paper").otherwise("ready")
    return joined.select("qid", state.alias("status"), n.alias("n_evidence"), F.coalesce("papers", F.lit(0)).alias("n_papers"))


def finish(states: DataFrame, drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome per query from states and drafted answers (qid, answer, citations, insufficient_evidence)."""
    allowed = evidence.groupBy("qid").agg(F.collect_set("evidence_id").alias("allowed"))
    joined = states.join(drafts, "qid", "left").join(allowed, "qid", "left").withColumn("allowed", F.coalesce("allowed", F.expr("cast(array() as array<string>)")))
    problem = F.when(F.col("answer").isNull() | F.col("citations").isNull() | F.col("insufficient_evidence").isNull(), "no draft").otherwise(answer_problem(F.col("answer"), F.col("citations"), F.col("insufficient_evidence"), F.col("allowed")))
    state = F.when(F.col("status") != "ready", F.col("status")).when(problem.isNull(), "success").otherwise("fallback")
    text = F.when(state == "success", F.trim("answer")).when(state == "insufficient_evidence", INSUFFICIENT_TEXT).when(state == "ambiguous_paper", AMBIGUOUS_TEXT)
    cited = F.when(state == "success", X.first_seen(F.col("citations"))).otherwise(F.expr("cast(array() as array<string>)"))
    lacking = F.when(state == "success", F.col("insufficient_evidence")).when(state == "disabled", F.col("n_evidence") == 0).otherwise(state.isin("insufficient_evidence", "ambiguous_paper"))
    return joined.select("qid", state.alias("status"), text.alias("answer"), cited.alias("citations"), lacking.alias("insufficient_evidence"))


def prompt(units: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Per query the evidence as a prompt's text, in order: label, kind, paper, section, pages and chunks of each unit, then its text.

    ``titles`` (paper_id, paper_title): a paper without one is named by its id.
    """
    named = units.withColumn("__title", F.lit(None).cast("string")) if titles is None else units.join(titles.select("paper_id", X.blank_to_null(F.col("paper_title")).alias("__title")), "paper_id", "left")
    one = F.format_string("[%s] %s | %s | %s | p. %s | %s\n%s", "evidence_id", "kind", F.coalesce("__title", "paper_id"), F.coalesce("section", F.lit("-")), X.page_label(F.col("page_start"), F.col("page_end")), "chunk_ids", "text")
    return named.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("line")))), lambda x: x["line"]), "\n\n").alias("prompt"))


def parse_drafts(replies: DataFrame) -> DataFrame:
    """Drafts (qid, answer, citations, insufficient_evidence) from model replies (qid, payload); what is no valid draft has nulls."""
    raw = F.col("payload")
    fine = J.has_exactly(raw, ("answer", "citations", "insufficient_evidence")) & J.has_types(raw, {"answer": ("STRING",), "insufficient_evidence": ("BOOLEAN",), "citations": ("ARRAY<STRING>", "ARRAY<VOID>")})
    parsed = F.when(F.coalesce(fine, F.lit(False)), F.from_json(raw, "answer string, citations array<string>, insufficient_evidence boolean"))
    return replies.select("qid", parsed.alias("d")).select("qid", "d.answer", "d.citations", "d.insufficient_evidence")


def to_json(outcome: DataFrame) -> DataFrame:
    """qid, json: the outcome's own fields."""
    return outcome.select("qid", F.to_json(F.struct("status", "answer", "citations", "insufficient_evidence"), {"ignoreNullFields": "false"}).alias("json"))


def outcome_json(questions: DataFrame, plans: DataFrame, outcome: DataFrame, records: DataFrame, units: DataFrame) -> DataFrame:
    """qid, json: question, plan, states, answer, hits and evidence, so that each step can be checked by itself.

    ``records``: qid, rank, json; ``units``: evidence units.  Lists are in order of rank.
    """
    hits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "json"))), lambda x: x["json"]), ",")
    listed = records.groupBy("qid").agg(hits.alias("hits"))
    unit = F.struct("evidence_id", "kind", "paper_id", "section", "page_start", "page_end", F.split("seed_chunk_ids", ",").alias("seed_chunk_ids"), F.split("chunk_ids", ",").alias("chunk_ids"), "token_count", "text")
    proofs = F.transform(F.array_sort(F.collect_list(F.struct("ord", unit.alias("unit")))), lambda x: x["unit"])
    shown = units.groupBy("qid").agg(F.to_json(proofs, {"ignoreNullFields": "false"}).alias("evidence"))
    plan = F.struct(F.col("p.status").alias("status"), "p.semantic_query", F.col("p.keywords").alias("lexical_keywords_en"), "p.search_bibliography")
    head = F.struct(F.col("query"), plan.alias("rewrite_plan"), "p.reranking_status", F.col("o.status").alias("answer_status"), "o.answer", "o.citations", "o.insufficient_evidence")
    joined = questions.join(plans.alias("p"), "qid").join(outcome.alias("o"), "qid").join(listed, "qid", "left").join(shown, "qid", "left")
    text = F.to_json(head, {"ignoreNullFields": "false"})
    # the two lists are JSON already
    whole = F.concat(F.expr("substring(__head, 1, length(__head) - 1)"), F.lit(',"retrieved_chunks":['), F.coalesce("hits", F.lit("")), F.lit('],"evidence":'), F.coalesce("evidence", F.lit("[]")), F.lit("}"))
    return joined.withColumn("__head", text).select("qid", whole.alias("json"))
