"""Queries: conversation context, routing rules, rewrites, evidence expansion and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.config import Settings
from sheaf.functions import text as X
from sheaf.operators import answers, context, overview, store
from sheaf.plans import fixtures as fx
from sheaf.plans.fixtures import with_chunks
from sheaf.plans.retrieval import FUSED_SQL, _fused

S = Settings()
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query("context_last_turns", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' QUALIFY back <= 4")
def context_last_turns(spark, d):
    return store.last_turns(fx.table(spark, d, "conversations"), S.retrieval.rewrite.max_context_turns)


# questions made from the fixture texts by rules that give every kind of routing
QUESTION_SQL = """
CASE item_id % 6 WHEN 0 THEN 'Which papers are cited for ' || text WHEN 1 THEN '[' || item_id || '] 是哪篇论文' WHEN 2 THEN '这个模型和 baseline 有什么区别 ' || text
  WHEN 3 THEN '方法 如何 训练 ' || item_id WHEN 4 THEN 'In this paper, ' || text ELSE text END
"""


def _questions(spark, d):
    i, text = F.col("item_id"), F.col("text")
    made = (
        F.when(i % 6 == 0, F.concat(F.lit("Which papers are cited for "), text))
        .when(i % 6 == 1, F.concat(F.lit("["), i.cast("string"), F.lit("] 是哪篇论文")))
        .when(i % 6 == 2, F.concat(F.lit("这个模型和 baseline 有什么区别 "), text))
        .when(i % 6 == 3, F.concat(F.lit("方法 如何 训练 "), i.cast("string")))
        .when(i % 6 == 4, F.concat(F.lit("In this paper, "), text))
        .otherwise(text)
    )
    return fx.table(spark, d, "benchmark").select(i.alias("qid"), made.alias("query"))


RULE_SQL = """CASE WHEN regexp_matches(q, '\\[\\s*\\d{1,4}\\s*\\]\\s*(是|对应|什么|which|what)') OR regexp_matches(q, '参考文献|文献列表|参考书目|(有没有|是否|有无).{0,30}引用|引用了?(哪些|什么|哪篇|哪个|谁|.*吗|.*？|.*\\?)|cite|citation|references|bibliography') THEN true
  WHEN regexp_matches(q, '(有什么|有何|哪些|如何|怎么).{0,20}(区别|不同|差异|优势|劣势)|比较|对比|区别|不同|差异|优于|为什么比|baseline|基线|(如何|怎么|怎样).{0,20}(构建|建立|训练|实现|计算|预测)|(方法|模型).{0,20}(为什么|如何|怎么)') THEN false END"""


@query("bibliography_router", f"WITH t AS (SELECT item_id AS qid, lower(trim(regexp_replace({QUESTION_SQL}, '\\s+', ' ', 'g'))) AS q FROM benchmark) SELECT qid, {RULE_SQL} AS rule, coalesce({RULE_SQL}, qid % 4 = 0) AS decision FROM t")
def bibliography_router(spark, d):
    q = _questions(spark, d)
    return q.select("qid", answers.bibliography_rule(F.col("query")).alias("rule"), answers.bibliography_decision(F.col("query"), F.col("qid") % 4 == 0).alias("decision"))


REWRITE_SQL = f"""
WITH t AS (SELECT item_id AS qid, {QUESTION_SQL} AS query, lower(trim(regexp_replace({QUESTION_SQL}, '\\s+', ' ', 'g'))) AS q, string_split(text, ' ')[1] AS w, string_split(text, ' ')[2] AS v FROM benchmark)
SELECT qid, CASE WHEN qid % 5 < 2 THEN trim(q2) END AS semantic_query,
       CASE WHEN qid % 5 < 2 THEN CASE WHEN lower(w) = lower(v) THEN w || '|third' ELSE w || '|' || v || '|third' END ELSE '' END AS keywords,
       CASE WHEN qid % 5 < 3 THEN coalesce({RULE_SQL}, qid % 2 = 0) ELSE coalesce({RULE_SQL}, false) END AS search_bibliography,
       CASE WHEN qid % 5 < 3 THEN 'success' ELSE 'fallback' END AS status
FROM (SELECT *, w || ' ' || v AS q2 FROM t)
"""


@query("rewrite_normalize", REWRITE_SQL)
def rewrite_normalize(spark, d):
    words = F.split("text", " ")
    parts = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), words[0].alias("w"), words[1].alias("v"))
    # payloads: valid, valid, valid without a query and keywords, with a key too many, no JSON
    listed = F.array(F.concat(F.lit(" "), "w", F.lit(" ")), F.upper("w"), F.lit(""), F.col("v"), F.lit("third"), F.lit("fourth"))
    full = F.to_json(F.struct(F.concat(F.lit(" "), "w", F.lit(" "), "v", F.lit(" ")).alias("semantic_query"), listed.alias("lexical_keywords_en"), (F.col("qid") % 2 == 0).alias("search_bibliography")))
    bare = F.concat(F.lit('{"semantic_query":null,"lexical_keywords_en":[" "],"search_bibliography":'), (F.col("qid") % 2 == 0).cast("string"), F.lit("}"))
    extra = F.concat(F.lit('{"semantic_query":"x","lexical_keywords_en":[],"search_bibliography":true,"more":'), F.col("qid").cast("string"), F.lit("}"))
    payload = F.when(F.col("qid") % 5 < 2, full).when(F.col("qid") % 5 == 2, bare).when(F.col("qid") % 5 == 3, extra).otherwise("no json")
    plans = answers.rewrite_plan(_questions(spark, d).join(parts.select("qid", payload.alias("payload")), "qid"), S.retrieval.rewrite.max_keywords)
    return plans.select("qid", "semantic_query", F.array_join("keywords", "|").alias("keywords"), "search_bibliography", "status")


# seeds: the fused order's first ten, with their fused score as priority
SEEDS_SQL = "seeds AS (SELECT qid, chunk_id, round(fused_score, 9) AS priority, pre_rank FROM fused WHERE pre_rank <= 10)"
WINDOW_SQL = """
content AS (SELECT chunk_id, paper_id, section, chunk_index, chunk_index - row_number() OVER (PARTITION BY paper_id, section ORDER BY chunk_index) AS run FROM chunks WHERE section_type = 'content'),
runs AS (SELECT *, min(chunk_index) OVER r AS lo1, max(chunk_index) OVER r AS hi1 FROM content WINDOW r AS (PARTITION BY paper_id, section, run)),
spans AS (SELECT s.qid, s.chunk_id, s.priority, r.paper_id, r.section, greatest(r.chunk_index - 1, lo1) AS lo, least(r.chunk_index + 1, hi1) AS hi FROM seeds s JOIN runs r USING (chunk_id)),
marked AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY qid, paper_id, section ORDER BY lo, hi, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY qid, paper_id, section ORDER BY lo, hi, chunk_id) AS island FROM marked),
merged AS (SELECT qid, paper_id, section, min(lo) AS lo, max(hi) AS hi, max(priority) AS priority, string_agg(chunk_id, ',' ORDER BY priority DESC, chunk_id) AS seeds FROM islands GROUP BY qid, paper_id, section, island),
grouped AS (
  SELECT m.qid, m.paper_id, m.section, m.lo, m.hi, m.priority, m.seeds, string_agg(c.chunk_id, ',' ORDER BY c.chunk_index) AS chunk_ids, string_agg(trim(c.raw_text), chr(10) || chr(10) ORDER BY c.chunk_index) AS text, CAST(sum(c.raw_token_count) AS BIGINT) AS tokens, min(c.page_start) AS page_start, max(c.page_end) AS page_end
  FROM merged m JOIN chunks c ON c.paper_id = m.paper_id AND c.section = m.section AND c.chunk_index BETWEEN m.lo AND m.hi AND c.section_type = 'content' GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, paper_id, section, chunk_ids) AS ord FROM grouped)
"""
BUDGET = 400
BUDGET_SQL = f"""
fold AS (
  SELECT qid, ord, tokens <= {BUDGET} AS kept, {BUDGET} - CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS left_over FROM ordered WHERE ord = 1
  UNION ALL
  SELECT o.qid, o.ord, o.tokens <= f.left_over, f.left_over - CASE WHEN o.tokens <= f.left_over THEN o.tokens ELSE 0 END FROM fold f JOIN ordered o ON o.qid = f.qid AND o.ord = f.ord + 1),
evidence AS (SELECT o.*, 'E' || row_number() OVER (PARTITION BY o.qid ORDER BY o.ord) AS evidence_id FROM ordered o JOIN fold f ON f.qid = o.qid AND f.ord = o.ord WHERE f.kept)
"""


def _seeds(spark, d):
    fused, chunks = _fused(spark, d)
    return fused.where("pre_rank <= 10").select("qid", "chunk_id", F.round("fused_score", 9).alias("priority"), "pre_rank"), chunks


@query("neighbor_windows", FUSED_SQL + "," + SEEDS_SQL + "," + WINDOW_SQL + "SELECT qid, chunk_id, paper_id, section, lo, hi FROM spans")
def neighbor_windows(spark, d):
    seeds, chunks = _seeds(spark, d)
    return context.windows(seeds, chunks, S.context.neighbor_window).select("qid", "chunk_id", "paper_id", "section", "lo", "hi")


@query("window_merge", FUSED_SQL + "," + SEEDS_SQL + "," + WINDOW_SQL + "SELECT qid, paper_id, section, lo, hi, priority, seeds FROM merged")
def window_merge(spark, d):
    seeds, chunks = _seeds(spark, d)
    return context.merge(context.windows(seeds, chunks, S.context.neighbor_window)).drop("island")


@query("evidence_budget", FUSED_SQL + "," + SEEDS_SQL + "," + WINDOW_SQL + "," + BUDGET_SQL + "SELECT qid, evidence_id, chunk_ids, tokens, CAST(ord AS INTEGER) AS ord FROM evidence")
def evidence_budget(spark, d):
    seeds, chunks = _seeds(spark, d)
    return context.expand(seeds, chunks, S.context.neighbor_window, BUDGET).select("qid", "evidence_id", "chunk_ids", "tokens", "ord")


# every question's papers' reference lists are its bibliography hits
REFS_SQL = "refs AS (SELECT s.qid, c.chunk_id, c.paper_id, c.section, c.page_start, c.page_end, c.raw_text, row_number() OVER (PARTITION BY s.qid ORDER BY c.chunk_id) AS rank FROM (SELECT DISTINCT qid, paper_id FROM seeds JOIN chunks USING (chunk_id)) s JOIN chunks c ON c.paper_id = s.paper_id AND c.section_type = 'bibliography' QUALIFY rank <= 5)"
UNITS_SQL = """
units AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k, r) AS n FROM (
    SELECT qid, evidence_id, 'content' AS kind, paper_id, section, page_start, page_end, seeds AS seed_chunk_ids, chunk_ids, text, tokens AS token_count, 0 AS k, ord AS r FROM evidence
    UNION ALL SELECT qid, 'R' || rank, 'bibliography', paper_id, section, page_start, page_end, chunk_id, chunk_id, raw_text, CAST(greatest(1, len(string_split(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), ' '))) AS BIGINT), 1, rank FROM refs) QUALIFY n <= 8)
"""
EVIDENCE_SQL = FUSED_SQL + "," + SEEDS_SQL + "," + WINDOW_SQL + "," + BUDGET_SQL + "," + REFS_SQL + "," + UNITS_SQL


def _units(spark, d):
    from pyspark.sql import Window

    seeds, chunks = _seeds(spark, d)
    every = fx.chunks(spark, d)
    content = context.expand(seeds, chunks, S.context.neighbor_window, BUDGET)
    papers = seeds.join(chunks.select("chunk_id", "paper_id"), "chunk_id").select("qid", "paper_id").distinct()
    order = Window.partitionBy("qid").orderBy("chunk_id")
    refs = papers.join(every.where("section_type = 'bibliography'"), "paper_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    return context.units(content, refs, S.answer.max_evidence_units)


@query("evidence_units", EVIDENCE_SQL + "SELECT qid, evidence_id, kind, paper_id, section, page_start, page_end, seed_chunk_ids, chunk_ids, sha256(text) AS text_sha256, token_count, CAST(n AS INTEGER) AS ord FROM units")
def evidence_units(spark, d):
    return _units(spark, d).select("qid", "evidence_id", "kind", "paper_id", "section", "page_start", "page_end", "seed_chunk_ids", "chunk_ids", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "token_count", "ord")


@query("answer_prompt", EVIDENCE_SQL + "SELECT qid, sha256(string_agg('[' || evidence_id || '] ' || u.kind || ' | ' || paper_title || ' | ' || coalesce(section, '-') || ' | p. ' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END || ' | ' || chunk_ids || chr(10) || u.text, chr(10) || chr(10) ORDER BY n)) AS sha FROM units u JOIN papers USING (paper_id) GROUP BY qid")
def answer_prompt(spark, d):
    return answers.prompt(_units(spark, d), fx.papers(spark, d).select("paper_id", "paper_title")).select("qid", F.sha2(F.col("prompt").cast("binary"), 256).alias("sha"))


# drafts made by rule: valid, unknown citation, label that is not cited, no citation, insufficient
DRAFT_SQL = """
drafts AS (
  SELECT qid, CASE qid % 5 WHEN 1 THEN 'See [E1].' WHEN 2 THEN 'See [E1] and [E2].' WHEN 3 THEN 'No source.' WHEN 4 THEN ' Nothing found. ' ELSE 'As [E1] says.' END AS answer,
         CASE qid % 5 WHEN 1 THEN ['E9'] WHEN 2 THEN ['E1'] WHEN 3 THEN [] WHEN 4 THEN [] ELSE ['E1'] END AS cites, qid % 5 = 4 AS insufficient FROM qs),
states AS (
  SELECT q.qid, count(u.qid) AS n_evidence, count(DISTINCT u.paper_id) AS n_papers, coalesce(bool_or(u.evidence_id = 'E1'), false) AS has1, any_value(q.qid % 6 = 4 AND q.qid % 4 <> 0) AS deictic
  FROM qs q LEFT JOIN (SELECT * FROM units WHERE qid % 7 <> 0) u ON u.qid = q.qid GROUP BY q.qid),
status AS (SELECT *, CASE WHEN n_evidence = 0 THEN 'insufficient_evidence' WHEN deictic AND n_papers > 1 THEN 'ambiguous_paper' ELSE 'ready' END AS status FROM states)
"""


def _states(spark, d):
    units = _units(spark, d).where("qid % 7 != 0")
    # every fourth question has earlier turns
    questions = _questions(spark, d).withColumn("n_context", F.when(F.col("qid") % 4 == 0, 2).otherwise(0))
    return answers.status(questions, units), units


@query("answer_status", EVIDENCE_SQL + "," + DRAFT_SQL + "SELECT qid, status, n_evidence, n_papers FROM status")
def answer_status(spark, d):
    return _states(spark, d)[0]


@query("deictic_ambiguity", f"SELECT item_id AS qid, regexp_matches(lower({QUESTION_SQL}), '这篇论文|本文|该论文|该文|this paper|the paper') AS deictic FROM benchmark")
def deictic_ambiguity(spark, d):
    return _questions(spark, d).select("qid", answers.is_deictic(F.col("query")).alias("deictic"))


@query("citation_validation", EVIDENCE_SQL + "," + DRAFT_SQL + "SELECT d.qid, CASE WHEN s.status <> 'ready' THEN s.status WHEN d.qid % 5 IN (1, 2, 3) OR d.qid % 5 = 0 AND NOT has1 THEN 'fallback' ELSE 'success' END AS status, CASE WHEN s.status = 'ready' AND (d.qid % 5 = 4 OR d.qid % 5 = 0 AND has1) THEN trim(d.answer) WHEN s.status = 'insufficient_evidence' THEN '当前检索到的论文证据不足以回答该问题。' WHEN s.status = 'ambiguous_paper' THEN '问题中的论文对象不明确；当前检索到多个论文来源，请指定论文标题后再提问。' END AS answer, CASE WHEN s.status = 'ready' AND d.qid % 5 = 0 AND has1 THEN 'E1' ELSE '' END AS citations, CASE WHEN s.status = 'ready' THEN d.qid % 5 = 4 ELSE true END AS insufficient_evidence FROM drafts d JOIN status s USING (qid)")
def citation_validation(spark, d):
    return _outcome(spark, d).withColumn("citations", F.array_join("citations", ","))


def _outcome(spark, d):
    states, units = _states(spark, d)
    q = F.col("qid") % 5
    answer = F.when(q == 1, "See [E1].").when(q == 2, "See [E1] and [E2].").when(q == 3, "No source.").when(q == 4, " Nothing found. ").otherwise("As [E1] says.")
    cites = F.when(q == 1, F.array(F.lit("E9"))).when(q.isin(0, 2), F.array(F.lit(" E1 "), F.lit("E1"))).otherwise(F.expr("cast(array() as array<string>)"))
    drafts = _questions(spark, d).select("qid", answer.alias("answer"), cites.alias("citations"), (q == 4).alias("insufficient_evidence"))
    return answers.finish(states, drafts, units)


@query("answer_json", EVIDENCE_SQL + "," + DRAFT_SQL + """, done AS (
  SELECT d.qid, CASE WHEN s.status <> 'ready' THEN s.status WHEN d.qid % 5 IN (1, 2, 3) OR d.qid % 5 = 0 AND NOT has1 THEN 'fallback' ELSE 'success' END AS state, d.answer, d.cites, d.insufficient FROM drafts d JOIN status s ON s.qid = d.qid)
SELECT qid, to_json({'status': state, 'answer': CASE state WHEN 'success' THEN trim(answer) WHEN 'insufficient_evidence' THEN '当前检索到的论文证据不足以回答该问题。' WHEN 'ambiguous_paper' THEN '问题中的论文对象不明确；当前检索到多个论文来源，请指定论文标题后再提问。' END,
  'citations': CASE WHEN state = 'success' THEN cites ELSE []::VARCHAR[] END, 'insufficient_evidence': CASE WHEN state = 'success' THEN insufficient ELSE state IN ('insufficient_evidence', 'ambiguous_paper') END})::VARCHAR AS json FROM done""")
def answer_json(spark, d):
    return answers.to_json(_outcome(spark, d))


@query("unknown_ids", with_chunks() + "SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN chunk_id || '_x' ELSE '' END AS unknown, chunk_index % 3 <> 0 AS subset FROM chunks")
def unknown_ids(spark, d):
    cited = F.when(F.col("chunk_index") % 3 == 0, F.array("chunk_id", F.concat("chunk_id", F.lit("_x")))).otherwise(F.array("chunk_id"))
    left = overview.unknown_sources(cited, F.array("chunk_id", F.lit("other")))
    return fx.chunks(spark, d).select("chunk_id", F.array_join(left, ",").alias("unknown"), (F.size(left) == 0).alias("subset"))


@query("ordered_distinct", "SELECT item_id, array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: list_position(ws, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)")
def ordered_distinct(spark, d):
    return fx.table(spark, d, "benchmark").select("item_id", F.array_join(X.first_seen(F.split("text", " ")), " ").alias("words"))
