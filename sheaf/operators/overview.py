"""Evidence selection for structured overviews of single papers: categories, role scores, budgets.

Everything is per paper, so a corpus of papers is handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.config import Overview
from sheaf.functions import json as J
from sheaf.functions import text as X

# What section names tell about the category, in this order after abstracts.
CATEGORY_TOKENS = (
    ("method", ("method", "methodology", "approach", "proposed", "framework", "model", "algorithm", "方法", "模型", "框架")),
    ("introduction", ("introduction", "background", "overview", "引言", "背景")),
    ("experiments", ("experiment", "evaluation", "result", "performance", "empirical", "实验", "结果", "评估", "评价")),
    ("conclusion", ("conclusion", "discussion", "limitation", "future work", "结论", "讨论", "局限", "展望")),
)

# Signals of the roles, looked for as substrings.
SIGNALS = {
    "research_problem": ("problem", "challenge", "limitation", "however", "issue", "difficult", "drawback", "问题", "挑战", "局限", "然而", "不足"),
    "contributions": ("contribution", "contributions", "we propose", "our work", "in summary", "we present", "提出", "贡献", "本文", "总结"),
    "main_method": ("method", "approach", "framework", "algorithm", "model", "proposed", "overview", "methodology", "方法", "框架", "算法", "模型", "提出"),
    "datasets": ("dataset", "datasets", "data set", "data collection", "benchmark", "corpus", "ucr", "数据集", "数据集", "基准"),
    "experimental_setup": ("setup", "baseline", "metric", "implementation", "setting", "protocol", "parameter", "evaluation", "experiment", "设置", "基线", "指标", "实现", "参数", "实验"),
    "main_results": ("result", "performance", "comparison", "outperform", "improvement", "better than", "accuracy", "rmse", "mae", "mape", "error", "table", "figure", "结果", "性能", "比较", "优于", "提升", "准确率", "误差", "表", "图"),
    "limitations": ("limitation", "limitations", "fail", "failure", "worse", "sensitive", "however", "drawback", "future work", "error analysis", "局限", "失败", "较差", "敏感", "然而", "缺点", "未来工作"),
}

# Per role the points of a category, and the points of each signal.
BASE_POINTS = {
    "research_problem": {"abstract": 9, "introduction": 5},
    "contributions": {"abstract": 8, "introduction": 4, "conclusion": 2},
    "main_method": {"method": 20, "abstract": 2},
    "datasets": {"experiments": 4},
    "experimental_setup": {"experiments": 4},
    "main_results": {"experiments": 5, "conclusion": 4},
    "limitations": {"conclusion": 5},
}
SIGNAL_POINTS = {"research_problem": 5, "contributions": 6, "main_method": 5, "datasets": 8, "experimental_setup": 7, "main_results": 9, "limitations": 9}
PRIORITIES = {"research_problem": 2, "contributions": 2, "main_method": 3, "datasets": 2, "experimental_setup": 2, "main_results": 3, "limitations": 2}
ROLES = tuple(SIGNALS)
#: The letters of signals that are not in ASCII.
WIDE = "[\u4e00-\u9fff]"
#: The two roles whose signals count in the text alone.
TEXT_ONLY = ("research_problem", "contributions")
# What stands in the results for cut texts, sections without a name and missing fields.
TRUNCATED = "\n[本 chunk 后续内容已截断]"
NO_SECTION = "未标注章节"
MISSING = "论文未明确说明"


def category(section: Column, front_matter_type: Column) -> Column:
    """Category by section name; abstract first, then the groups in order."""

    def of(name: Column) -> Column:
        out = F.when((F.lower(F.coalesce(front_matter_type, F.lit(""))) == "abstract") | _any(name, ("abstract", "摘要")), "abstract")
        for kind, words in CATEGORY_TOKENS:
            out = out.when(_any(name, words), kind)
        return out

    # an array of one, so that the name is made once and not for every word
    return F.get(F.transform(F.array(F.lower(X.squeeze(F.coalesce(section, F.lit(""))))), of), F.lit(0))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def top_number(section: Column) -> Column:
    """The chapter number that a section name begins with, or null."""
    first = F.rtrim(F.regexp_extract(F.trim(F.coalesce(section, F.lit(""))), r"^(\S+)", 1))
    chapter = F.split_part(F.regexp_replace(first, r"\.+$", ""), F.lit("."), F.lit(1))
    return F.when(chapter.rlike("^[0-9]+$"), F.try_to_number(chapter, F.lit("999999999")).cast("int"))


def categorize(chunks: DataFrame) -> DataFrame:
    """Adds category; chapters right before the first experiments chapter count as method where unnamed."""
    named = chunks.withColumn("__own", category(F.col("section"), F.col("front_matter_type"))).withColumn("__number", top_number(F.col("section")))
    first = F.min(F.when(F.col("__own") == "experiments", F.col("__number"))).over(Window.partitionBy("paper_id"))
    inferred = F.when((first - 1 > 0) & (F.col("__number") == first - 1), "method")
    return named.withColumn("category", F.coalesce("__own", inferred)).drop("__own", "__number")


def positions(chunks: DataFrame) -> DataFrame:
    """Adds section_position: 0 to 1 through the section."""
    section = F.coalesce(X.blank_to_null(F.col("section")), F.lit(NO_SECTION))
    by = Window.partitionBy("paper_id", section)
    at = F.row_number().over(by.orderBy("chunk_index", "chunk_id")) - 1
    return chunks.withColumn("section_position", at / F.greatest(F.count("*").over(by) - 1, F.lit(1)))


def role_points(role: str) -> Column:
    """The score of a role, for rows with what their text says (``said``)."""
    base = F.lit(0.0)
    for kind, n in reversed(BASE_POINTS[role].items()):
        base = F.when(F.col("category") == kind, F.lit(float(n))).otherwise(base)
    points = base + F.lit(float(SIGNAL_POINTS[role])) * F.get("signals", F.lit(ROLES.index(role)))
    intro = F.coalesce(F.col("category") == "introduction", F.lit(False))
    place = {"research_problem": 2 * (1 - F.col("section_position")), "contributions": 3 * F.col("section_position")}
    if role in place:
        points = points + F.when(intro, place[role]).otherwise(0.0)
    return points + F.col("numbers") if role == "main_results" else points


def said(chunks: DataFrame) -> DataFrame:
    """Adds what is taken from a chunk's text: signals (how many of each role), numbers (points for their density), text_tokens.

    None of it depends on other chunks, so a paper's chunks can be put together without their texts.
    """
    low = chunks.withColumn("__text", F.lower(X.squeeze("raw_text")))
    low = low.withColumn("__where", F.concat_ws(" ", F.lower(F.coalesce(F.trim("section"), F.lit(""))), "__text"))
    low = low.withColumn("__wide", F.col("__where").rlike(WIDE))

    def found(role: str, ascii_only: bool) -> Column:
        words = F.array(*(F.lit(s) for s in SIGNALS[role] if s.isascii() == ascii_only))
        return F.size(F.filter(words, lambda s: F.contains(F.col("__text" if role in TEXT_ONLY else "__where"), s)))

    # most texts have none of the wide letters, and are not searched for words of these
    counted = lambda r: found(r, True) + F.when(F.col("__wide"), found(r, False)).otherwise(0)
    numbers = F.coalesce(F.least(X.numeric_density(F.col("__text")) * 8, F.lit(6.0)), F.lit(0.0))
    return low.withColumns({"signals": F.array(*(counted(r) for r in ROLES)), "numbers": numbers, "text_tokens": text_tokens()}).drop("__text", "__where", "__wide")


def candidates(chunks: DataFrame) -> DataFrame:
    """Content chunks with text, categorized and placed, with what their texts say."""
    return positions(categorize(said(chunks.where("section_type = 'content'").where(F.length(F.trim("raw_text")) > 0))))


def role_scores(placed: DataFrame) -> DataFrame:
    """paper_id, chunk_id, chunk_index, section, role, score: positive scores only.

    A chunk's scores are made once, in its row; only those that count become rows.
    """
    known = placed if "signals" in placed.columns else said(placed)
    scored = F.array(*(F.struct(F.lit(r).alias("role"), role_points(r).alias("score")) for r in ROLES))
    carried = ("paper_id", "chunk_id", "chunk_index", "section", "category", "raw_text", "raw_token_count", "text_tokens")
    # an inner explode would filter by the size of its array, and make the scores again
    rows = known.select(*carried, F.explode_outer(F.filter(scored, lambda x: x["score"] > 0)).alias("__r")).where("__r is not null")
    return rows.select(*carried, "__r.role", "__r.score")


def role_top(scored: DataFrame, settings: Overview = Overview()) -> DataFrame:
    """The best chunks of each role, by score, place and id; methods from different sections first."""
    limits = F.create_map(*(x for r in ROLES for x in (F.lit(r), F.lit(getattr(settings, r)))))
    by = (F.desc("score"), "chunk_index", "chunk_id")
    section = F.coalesce(X.blank_to_null(F.col("section")), F.lit(NO_SECTION))
    inside = F.row_number().over(Window.partitionBy("paper_id", "role", section).orderBy(*by))
    marked = scored.withColumn("again", F.when((F.col("role") == "main_method") & (inside > 1), 1).otherwise(0))
    order = Window.partitionBy("paper_id", "role").orderBy("again", *by)
    return marked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.element_at(limits, F.col("role"))).drop("again")


def text_tokens() -> Column:
    """A chunk's tokens, guessed by its length where they are not known."""
    return F.coalesce(F.when(F.col("raw_token_count") > 0, F.col("raw_token_count")), F.greatest(F.lit(1), F.floor((F.length(X.squeeze("raw_text")) + 3) / 4)))


def context_tokens(rows: DataFrame, settings: Overview) -> Column:
    original = F.col("text_tokens") if "text_tokens" in rows.columns else text_tokens()
    return F.least(original, F.lit(settings.max_tokens_per_chunk)).cast("long")


def context_text(settings: Overview) -> Column:
    """The text, cut in proportion to its tokens where these are too many."""
    text = X.squeeze("raw_text")
    n = F.greatest(F.lit(1), F.floor(F.length(text) * settings.max_tokens_per_chunk / F.col("raw_token_count"))).cast("int")
    return F.when(F.col("raw_token_count") > settings.max_tokens_per_chunk, F.concat(F.rtrim(F.substring(text, F.lit(1), n)), F.lit(TRUNCATED))).otherwise(text)


def select(chosen: DataFrame, settings: Overview = Overview()) -> DataFrame:
    """Union of the roles' chunks within the token budget, by priority and score; abstracts are capped.

    What does not fit is skipped, later chunks may still fit.  Rows come out in reading order
    (``ord``), each with its roles.
    """
    priority = F.create_map(*(x for r, p in PRIORITIES.items() for x in (F.lit(r), F.lit(p))))
    merged = chosen.withColumn("tokens", context_tokens(chosen, settings)).groupBy("paper_id", "chunk_id", "chunk_index", "category", "tokens").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max(F.element_at(priority, F.col("role"))).alias("priority"), F.max("score").alias("best")
    )
    item = F.struct((-F.col("priority")).alias("p"), (-F.col("best")).alias("s"), "chunk_index", "chunk_id", "tokens", F.coalesce("category", F.lit("fallback")).alias("category"), "roles")
    listed = merged.groupBy("paper_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(settings.max_total_context_tokens).cast("long").alias("left"), F.lit(0).alias("abstracts"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        abstract = x["category"] == "abstract"
        fine = (x["tokens"] <= state["left"]) & ~(abstract & (state["abstracts"] >= settings.max_abstract_chunks))
        return F.when(fine, F.struct((state["left"] - x["tokens"]).alias("left"), (state["abstracts"] + abstract.cast("int")).alias("abstracts"), F.concat(state["kept"], F.array(x["chunk_id"])).alias("kept"))).otherwise(state)

    kept = listed.withColumn("kept", F.aggregate("items", start, step, lambda s: s["kept"]))
    rows = kept.select("paper_id", F.explode(F.filter("items", lambda x: F.array_contains(F.col("kept"), x["chunk_id"]))).alias("x"))
    order = Window.partitionBy("paper_id").orderBy("x.chunk_index", "x.chunk_id")
    return rows.select("paper_id", "x.chunk_id", "x.category", "x.roles", F.col("x.tokens").alias("tokens"), F.row_number().over(order).alias("ord"))


def fallback(placed: DataFrame, selected: DataFrame, settings: Overview = Overview()) -> DataFrame:
    """For papers with no selected chunk their first chunks within the budget."""
    from sheaf.operators import context

    order = Window.partitionBy("paper_id").orderBy("chunk_index", "chunk_id")
    # the tokens are taken first, so that no text moves
    light = placed.select("paper_id", "chunk_id", "chunk_index", context_tokens(placed, settings).alias("tokens"))
    first = light.join(selected.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= settings.max_fallback_chunks)
    sized = first.select(F.col("paper_id").alias("qid"), "chunk_id", "ord", "tokens")
    kept = sized.groupBy("qid").agg(context.greedy(F.array_sort(F.collect_list(F.struct("ord", "tokens"))), settings.max_total_context_tokens).alias("kept"))
    return sized.join(kept.select("qid", F.explode("kept").alias("ord")), ["qid", "ord"]).select(F.col("qid").alias("paper_id"), "chunk_id", F.lit("fallback").alias("category"), F.lit("fallback").alias("roles"), "tokens", "ord")


def union_ids(chosen: DataFrame) -> DataFrame:
    """Per paper the chunk ids of all roles, each at its first occurrence in the order of roles."""
    place = F.create_map(*(x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))))
    first = chosen.groupBy("paper_id", "chunk_id").agg(F.min(F.struct(F.element_at(place, F.col("role")).alias("r"), "n")).alias("at"))
    return first.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("ids"))


def title_problem(drafted: Column, known: Column) -> Column:
    """Why a drafted title is refused, or null: it must be the paper's, or the stand-in where that is missing."""
    expected = F.coalesce(X.blank_to_null(known), F.lit(MISSING))
    return F.when(~F.trim(F.coalesce(drafted, F.lit(""))).eqNullSafe(F.trim(expected)), "title differs")


def parse_draft(payload: Column) -> Column:
    """The fields of a drafted overview (a model's JSON): title and an array of (field, content, source_chunk_ids).

    Null if it is no object of just these fields, each with just its content and ids, of the right types.
    """
    inner = lambda r: F.get_json_object(payload, f"$.{r}")
    strict = J.has_exactly(payload, ("paper_title", *ROLES)) & J.has_types(payload, {"paper_title": ("STRING",)})
    for r in ROLES:
        strict = strict & J.has_exactly(inner(r), ("content", "source_chunk_ids")) & J.has_types(inner(r), {"content": ("STRING",), "source_chunk_ids": ("ARRAY<STRING>", "ARRAY<VOID>")})
    kinds = "paper_title string, " + ", ".join(f"{r} struct<content:string,source_chunk_ids:array<string>>" for r in ROLES)

    def known(draft: Column) -> Column:
        fields = F.array(*(F.struct(F.lit(r).alias("field"), draft[r]["content"].alias("content"), draft[r]["source_chunk_ids"].alias("source_chunk_ids")) for r in ROLES))
        return F.when(draft["paper_title"].isNotNull(), F.struct(draft["paper_title"].alias("paper_title"), fields.alias("fields")))

    # an array of one, so that the draft is read once and not for every field
    return F.when(strict, F.get(F.transform(F.array(F.from_json(payload, kinds)), known), F.lit(0)))


def unknown_sources(cited: Column, known: Column) -> Column:
    """Cited ids that are not among the known ones."""
    return F.array_except(cited, known)


def validate(fields: DataFrame, context: DataFrame) -> DataFrame:
    """Drafted fields (paper_id, field, content, source_chunk_ids) with their problem, or sections filled in.

    A missing field cites nothing; any other cites at least one chunk, and only chunks of the
    context (paper_id, chunk_id, section).
    """
    clean = fields.withColumn("ids", X.first_seen(F.col("source_chunk_ids"))).withColumn("content", F.trim("content"))
    known = context.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "section"))).alias("known"))
    joined = clean.join(known, "paper_id", "left").withColumn("known", F.coalesce("known", F.expr("cast(map() as map<string,string>)")))
    unknown = F.size(unknown_sources(F.col("ids"), F.map_keys("known"))) > 0
    problem = F.when(unknown, "unknown chunk").when((F.col("content") == MISSING) & (F.size("ids") > 0), "missing field cites").when((F.col("content") != MISSING) & (F.size("ids") == 0), "no source")
    sections = F.array_distinct(F.transform("ids", lambda i: F.element_at(F.col("known"), i)))
    return joined.select("paper_id", "field", "content", "ids", problem.alias("problem"), F.when(problem.isNull(), sections).alias("sections"))
