"""Queries: categories, role scores and budgeted selection for overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf import overviews
from sheaf.config import Overview
from sheaf.operators import overview
from sheaf.plans import fixtures as fx
from sheaf.plans.fixtures import with_chunks

# a tight budget, so that chunks are skipped and cut
SETTINGS = Overview(max_abstract_chunks=1, main_method=2, max_tokens_per_chunk=64, max_total_context_tokens=256)
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


CATEGORY_SQL = """
cat AS (
  SELECT *, CASE WHEN s LIKE '%abstract%' THEN 'abstract' WHEN regexp_matches(s, 'method|approach|proposed|framework|model|algorithm') THEN 'method' WHEN regexp_matches(s, 'introduction|background|overview') THEN 'introduction'
                 WHEN regexp_matches(s, 'experiment|evaluation|result|performance|empirical') THEN 'experiments' WHEN regexp_matches(s, 'conclusion|discussion|limitation|future work') THEN 'conclusion' END AS own,
         TRY_CAST(regexp_extract(section, '^([0-9]+)', 1) AS INTEGER) AS num
  FROM (SELECT *, lower(section) AS s, trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')) AS low FROM chunks WHERE section_type = 'content')),
placed AS (
  SELECT *, coalesce(own, CASE WHEN min(num) FILTER (own = 'experiments') OVER p - 1 > 0 AND num = min(num) FILTER (own = 'experiments') OVER p - 1 THEN 'method' END) AS category,
         (row_number() OVER (PARTITION BY paper_id, section ORDER BY chunk_index, chunk_id) - 1) / greatest(count(*) OVER (PARTITION BY paper_id, section) - 1, 1)::DOUBLE AS section_position
  FROM cat WINDOW p AS (PARTITION BY paper_id))
"""


def _signals(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words) + ")"


def _score_sql(role: str) -> str:
    base = "CASE category " + " ".join(f"WHEN '{k}' THEN {n}.0" for k, n in overview.BASE_POINTS[role].items()) + " ELSE 0.0 END"
    where = "low" if role in overview.TEXT_ONLY else "(s || ' ' || low)"
    score = f"{base} + {overview.SIGNAL_POINTS[role]} * {_signals(where, overview.SIGNALS[role])}"
    if role == "research_problem":
        score += " + CASE WHEN category = 'introduction' THEN 2 * (1 - section_position) ELSE 0.0 END"
    if role == "contributions":
        score += " + CASE WHEN category = 'introduction' THEN 3 * section_position ELSE 0.0 END"
    if role == "main_results":
        score += " + least(len(regexp_extract_all(low, '\\d+(?:\\.\\d+)?%?')) / greatest(len(string_split(low, ' ')), 1)::DOUBLE * 8, 6.0)"
    return score


SCORED_SQL = "scored AS (" + " UNION ALL ".join(f"SELECT paper_id, chunk_id, chunk_index, section, category, raw_token_count, low, '{r}' AS role, {i} AS place, {_score_sql(r)} AS score FROM placed" for i, r in enumerate(overview.ROLES)) + "), positive AS (SELECT * FROM scored WHERE score > 0)"
LIMITS = " ".join(f"WHEN '{r}' THEN {getattr(SETTINGS, r)}" for r in overview.ROLES)
PRIORITY = " ".join(f"WHEN '{r}' THEN {p}" for r, p in overview.PRIORITIES.items())
TOP_SQL = f"""
again AS (SELECT *, CASE WHEN role = 'main_method' AND row_number() OVER (PARTITION BY paper_id, role, section ORDER BY score DESC, chunk_index, chunk_id) > 1 THEN 1 ELSE 0 END AS a FROM positive),
chosen AS (SELECT *, row_number() OVER (PARTITION BY paper_id, role ORDER BY a, score DESC, chunk_index, chunk_id) AS n FROM again QUALIFY n <= CASE role {LIMITS} END)
"""
BUDGET_SQL = f"""
merged AS (SELECT paper_id, chunk_id, chunk_index, coalesce(category, 'fallback') AS category, least(raw_token_count, 64) AS tokens, string_agg(role, ',' ORDER BY role) AS roles, max(CASE role {PRIORITY} END) AS priority, max(score) AS best FROM chosen GROUP BY ALL),
queue AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY priority DESC, best DESC, chunk_index, chunk_id) AS i FROM merged),
fold AS (
  SELECT paper_id, i, chunk_id, true AS kept, 256 - tokens AS room, CASE WHEN category = 'abstract' THEN 1 ELSE 0 END AS abstracts FROM queue WHERE i = 1
  UNION ALL
  SELECT q.paper_id, q.i, q.chunk_id, fits, f.room - CASE WHEN fits THEN q.tokens ELSE 0 END, f.abstracts + CASE WHEN fits AND q.category = 'abstract' THEN 1 ELSE 0 END
  FROM (SELECT *, 0 AS z FROM queue) q JOIN fold f ON f.paper_id = q.paper_id AND q.i = f.i + 1, LATERAL (SELECT q.tokens <= f.room AND NOT (q.category = 'abstract' AND f.abstracts >= 1) AS fits)),
selected AS (SELECT m.paper_id, m.chunk_id, m.category, m.roles, CAST(m.tokens AS BIGINT) AS tokens, CAST(row_number() OVER (PARTITION BY m.paper_id ORDER BY m.chunk_index, m.chunk_id) AS INTEGER) AS ord FROM merged m JOIN fold f ON f.paper_id = m.paper_id AND f.chunk_id = m.chunk_id WHERE f.kept)
"""


def _placed(spark, d):
    return overview.candidates(fx.chunks(spark, d))


def _chosen(spark, d):
    return overview.role_top(overview.role_scores(_placed(spark, d)), SETTINGS)


@query("section_category", with_chunks(CATEGORY_SQL) + "SELECT chunk_id, category FROM placed WHERE category IS NOT NULL")
def section_category(spark, d):
    return _placed(spark, d).select("chunk_id", "category").where("category is not null")


@query("method_chapter_inference", with_chunks(CATEGORY_SQL) + "SELECT paper_id, count(*) AS n FROM placed WHERE category = 'method' AND own IS NULL GROUP BY paper_id")
def method_chapter_inference(spark, d):
    rows = _placed(spark, d).where((F.col("category") == "method") & overview.category(F.col("section"), F.col("front_matter_type")).isNull())
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"))


@query("section_positions", with_chunks(CATEGORY_SQL) + "SELECT chunk_id, round(section_position, 9) AS section_position FROM placed")
def section_positions(spark, d):
    return _placed(spark, d).select("chunk_id", F.round("section_position", 9).alias("section_position"))


@query("role_scores", with_chunks(CATEGORY_SQL, SCORED_SQL) + "SELECT chunk_id, role, round(score, 6) AS score FROM positive")
def role_scores(spark, d):
    return overview.role_scores(_placed(spark, d)).select("chunk_id", "role", F.round("score", 6).alias("score"))


@query("role_topk", with_chunks(CATEGORY_SQL, SCORED_SQL, TOP_SQL) + "SELECT paper_id, role, chunk_id, CAST(n AS INTEGER) AS n FROM chosen")
def role_topk(spark, d):
    return _chosen(spark, d).select("paper_id", "role", "chunk_id", "n")


@query("method_diverse_topk", with_chunks(CATEGORY_SQL, SCORED_SQL, TOP_SQL) + "SELECT paper_id, chunk_id, section, CAST(n AS INTEGER) AS n FROM chosen WHERE role = 'main_method'")
def method_diverse_topk(spark, d):
    return _chosen(spark, d).where("role = 'main_method'").select("paper_id", "chunk_id", "section", "n")


@query("overview_budget", with_chunks(CATEGORY_SQL, SCORED_SQL, TOP_SQL, BUDGET_SQL) + "SELECT * FROM selected")
def overview_budget(spark, d):
    return overview.select(_chosen(spark, d), SETTINGS)


@query("overview_union_ids", with_chunks(CATEGORY_SQL, SCORED_SQL, TOP_SQL) + "SELECT paper_id, string_agg(chunk_id, ',' ORDER BY place, n) AS ids FROM (SELECT paper_id, chunk_id, arg_min(place, place * 1000 + n) AS place, arg_min(n, place * 1000 + n) AS n FROM chosen GROUP BY paper_id, chunk_id) GROUP BY paper_id")
def overview_union_ids(spark, d):
    return overview.union_ids(_chosen(spark, d))


@query("overview_fallback", with_chunks() + "SELECT paper_id, chunk_id, 'fallback' AS category, 'fallback' AS roles, CAST(least(raw_token_count, 64) AS BIGINT) AS tokens, CAST(chunk_index + 1 AS INTEGER) AS ord FROM chunks JOIN papers USING (paper_id) WHERE section_type = 'content' AND chunk_index < 2 AND doc_id % 3 = 0")
def overview_fallback(spark, d):
    # papers whose doc_id is no multiple of 3 count as selected
    placed = _placed(spark, d)
    selected = fx.papers(spark, d).where("doc_id % 3 != 0").select("paper_id")
    return overview.fallback(placed, selected, SETTINGS)


@query("overview_context_text", with_chunks() + "SELECT chunk_id, CASE WHEN raw_token_count > 64 THEN rtrim(substr(t, 1, greatest(1, CAST(floor(length(t) * 64 / raw_token_count::DOUBLE) AS INTEGER)))) || chr(10) || '[本 chunk 后续内容已截断]' ELSE t END AS text FROM (SELECT *, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS t FROM chunks)")
def overview_context_text(spark, d):
    return fx.chunks(spark, d).select("chunk_id", overview.context_text(SETTINGS).alias("text"))


@query("overview_validate", with_chunks() + "SELECT paper_id, CASE doc_id % 4 WHEN 0 THEN 'unknown chunk' WHEN 1 THEN 'missing field cites' WHEN 2 THEN 'no source' END AS problem, CASE WHEN doc_id % 4 = 3 THEN section ELSE '' END AS sections FROM papers JOIN chunks USING (paper_id) WHERE chunk_index = 0")
def overview_validate(spark, d):
    chunks = fx.chunks(spark, d).where("chunk_index = 0")
    first = F.concat("paper_id", F.lit("_chunk_0000"))
    k = F.col("doc_id") % 4
    ids = F.when(k == 0, F.array(F.lit("nowhere"))).when(k == 2, F.expr("cast(array() as array<string>)")).otherwise(F.array(first, F.concat(F.lit(" "), first)))
    content = F.when(k == 1, F.lit(overview.MISSING)).otherwise(F.lit(" found "))
    fields = fx.papers(spark, d).select("paper_id", F.lit("datasets").alias("field"), content.alias("content"), ids.alias("source_chunk_ids"))
    checked = overview.validate(fields, chunks.select("paper_id", "chunk_id", "section"))
    return checked.select("paper_id", "problem", F.coalesce(F.array_join("sections", ","), F.lit("")).alias("sections"))


# each field's first passage; drafts of every fifth paper have a field of their own, of every seventh another title
@query("overview_drafts", with_chunks(CATEGORY_SQL, SCORED_SQL, TOP_SQL, BUDGET_SQL) + """,
firsts AS (SELECT paper_id, role, arg_min(chunk_id, ord) AS chunk_id FROM (SELECT paper_id, chunk_id, ord, unnest(string_split(roles, ',')) AS role FROM selected) GROUP BY ALL),
backs AS (SELECT DISTINCT paper_id FROM chunks WHERE section_type = 'content'),
roles AS (SELECT unnest([""" + ", ".join(f"'{r}'" for r in overview.ROLES) + """]) AS field)
SELECT p.paper_id, CASE WHEN p.doc_id % 5 = 0 THEN 'no overview' WHEN p.doc_id % 7 = 0 THEN 'title differs' END AS problem, r.field, f.chunk_id AS ids, c.section AS sections
FROM papers p JOIN backs USING (paper_id) JOIN roles r ON p.doc_id % 5 <> 0 AND p.doc_id % 7 <> 0 LEFT JOIN firsts f ON f.paper_id = p.paper_id AND f.role = r.field LEFT JOIN chunks c ON c.chunk_id = f.chunk_id
UNION ALL SELECT paper_id, CASE WHEN doc_id % 5 = 0 THEN 'no overview' ELSE 'title differs' END, NULL, NULL, NULL FROM papers JOIN backs USING (paper_id) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def overview_drafts(spark, d):
    """Overviews of all papers: passages, drafts without a model, strict checks."""
    papers = fx.papers(spark, d)
    odd = papers.select("paper_id", F.when(F.col("doc_id") % 5 == 0, "five").when(F.col("doc_id") % 7 == 0, "seven").alias("odd"))

    def draft(context, titles):
        made = overviews.drafted_offline(context, titles).join(odd, "paper_id")
        whole = F.col("payload")
        more = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"more":1}'))
        return made.select("paper_id", F.when(F.col("odd") == "five", more).when(F.col("odd") == "seven", F.regexp_replace(whole, '"paper_title":"', '"paper_title":"Not ')).otherwise(whole).alias("payload"))

    found, _ = overviews.overviews(fx.chunks(spark, d), papers.select("paper_id", "paper_title"), SETTINGS, draft)
    rows = found.select("paper_id", "problem", F.explode_outer("fields").alias("f"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return rows.select("paper_id", "problem", F.col("f.field").alias("field"), joined("f.source_chunk_ids").alias("ids"), joined("f.source_sections").alias("sections"))
