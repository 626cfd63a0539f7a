"""Overviews of all papers of a store as one plan: passages, drafts, strict checks, records.

No step goes through the driver: passages are chosen by windows over papers, drafts are asked
on the executors, and a draft is parsed and checked as columns.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import prompts, replies
from sheaf.adaptors import ChatClient
from sheaf.config import Overview
from sheaf.functions import text as X
from sheaf.operators import overview
from sheaf.storage import written
from sheaf.workspace import overview_context

NO_OVERVIEW = "no overview"


def questions(context: DataFrame, titles: DataFrame) -> DataFrame:
    """qid (the paper_id), query: the prompt of each paper's overview; papers without passages have none."""
    named = prompts.passages(context).join(titles.select("paper_id", "paper_title"), "paper_id", "left")
    return named.select(F.col("paper_id").alias("qid"), prompts.paper_overview(F.col("paper_title"), F.col("passages")).alias("query"))


def limited(factory: Callable[[], ChatClient], settings: Overview) -> Callable[[], ChatClient]:
    """Clients whose replies have the overviews' own bound, where they know one; the factory's settings stay."""

    def made() -> ChatClient:
        client = factory()
        return client.limited(settings.max_output_tokens) if hasattr(client, "limited") else client

    return made


def drafted(asked: DataFrame, folder: str, factory: Callable[[], ChatClient], model: str, settings: Overview) -> DataFrame:
    """paper_id, payload, failure: a model's drafts, each paper's prompt asked once."""
    found = replies.ask(asked, folder, limited(factory, settings), f"{model}/{settings.max_output_tokens}", prompts.OVERVIEW_SYSTEM, prompts.overview_schema())
    return found.select(F.col("qid").alias("paper_id"), "payload", "failure")


def drafted_offline(context: DataFrame, titles: DataFrame) -> DataFrame:
    """paper_id, payload: drafts without a model, which quote each field's first passage."""
    passage = F.struct("ord", "chunk_id", "text", F.split(F.coalesce("roles", F.lit("")), ",").alias("roles"))
    listed = context.groupBy("paper_id").agg(F.array_sort(F.collect_list(passage)).alias("passages"))

    def field(role: str) -> Column:
        first = F.get(F.filter("passages", lambda p: F.array_contains(p["roles"], role)), F.lit(0))
        ids = F.when(first.isNotNull(), F.array(first["chunk_id"])).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.coalesce(first["text"], F.lit(overview.MISSING)).alias("content"), ids.alias("source_chunk_ids")).alias(role)

    title = F.coalesce(X.blank_to_null(F.col("paper_title")), F.lit(overview.MISSING)).alias("paper_title")
    return listed.join(titles.select("paper_id", "paper_title"), "paper_id", "left").select("paper_id", F.to_json(F.struct(title, *(field(r) for r in overview.ROLES))).alias("payload"))


def checked(drafts: DataFrame, context: DataFrame, titles: DataFrame) -> DataFrame:
    """paper_id, problem, fields: of each draft (paper_id, payload) why it is refused, or its checked fields.

    ``fields``: field, content, source_chunk_ids, source_sections, in the fields' order.  A
    draft with fields of its own, or none, of wrong types, with another title or other chunks is
    refused as a whole; ``problem`` names the first reason by field.
    """
    parsed = drafts.join(titles.select("paper_id", F.col("paper_title").alias("__title")), "paper_id", "left").select("paper_id", overview.parse_draft(F.col("payload")).alias("d"), "__title")
    # stored, so that a draft is parsed once and not again for each way that its rows go
    judged = written(parsed.select("paper_id", "d", F.when(F.col("d").isNull(), NO_OVERVIEW).otherwise(overview.title_problem(F.col("d.paper_title"), F.col("__title"))).alias("problem")))
    fine = judged.where("problem is null")
    rows = fine.select("paper_id", F.explode("d.fields").alias("f")).select("paper_id", F.col("f.field").alias("field"), F.coalesce("f.content", F.lit("")).alias("content"), F.coalesce("f.source_chunk_ids", F.expr("cast(array() as array<string>)")).alias("source_chunk_ids"))
    tested = overview.validate(rows, context.select("paper_id", "chunk_id", "section"))
    place = F.array_position(F.array(*(F.lit(r) for r in overview.ROLES)), F.col("field"))
    one = F.struct(place.alias("at"), "field", "content", F.col("ids").alias("source_chunk_ids"), F.col("sections").alias("source_sections"))
    bad = F.struct(place.alias("at"), F.concat_ws(": ", "field", "problem").alias("problem"))
    whole = tested.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("fields"), F.min(F.when(F.col("problem").isNotNull(), bad))["problem"].alias("problem"))
    refused = judged.where("problem is not null").select("paper_id", "problem", F.lit(None).cast(whole.schema["fields"].dataType).alias("fields"))
    return whole.select("paper_id", "problem", F.when(F.col("problem").isNull(), F.col("fields")).alias("fields")).unionByName(refused)


def records(results: DataFrame, context: DataFrame, titles: DataFrame, settings: Overview) -> DataFrame:
    """paper_id, overview, context: both as JSON, of the papers whose drafts were accepted."""
    fine = results.where("problem is null").join(titles.select("paper_id", F.coalesce(X.blank_to_null(F.col("paper_title")), F.lit(overview.MISSING)).alias("paper_title")), "paper_id", "left")

    def field(role: str) -> Column:
        found = F.get(F.filter("fields", lambda f: f["field"] == role), F.lit(0))
        return F.struct(found["content"].alias("content"), found["source_chunk_ids"].alias("source_chunk_ids"), found["source_sections"].alias("source_sections")).alias(role)

    own = fine.select("paper_id", F.to_json(F.struct("paper_title", *(field(r) for r in overview.ROLES))).alias("overview"))
    chosen = F.struct("ord", "chunk_id", "section", "category", F.split("roles", ",").alias("roles"), "tokens")
    listed = context.groupBy("paper_id").agg(F.array_sort(F.collect_list(chosen)).alias("passages"), F.sum("tokens").alias("tokens"))
    shown = listed.select("paper_id", F.to_json(F.struct("passages", "tokens", F.lit(settings.max_total_context_tokens).alias("budget"))).alias("context"))
    return own.join(shown, "paper_id")


def overviews(chunks: DataFrame, titles: DataFrame, settings: Overview, draft: Callable[[DataFrame, DataFrame], DataFrame] = drafted_offline) -> tuple[DataFrame, DataFrame]:
    """The checked drafts of all papers of ``chunks``, and the passages that they are from.

    ``draft`` makes paper_id, payload of the passages and the titles (paper_id, paper_title).
    """
    # drafts are made of the passages and checked against them
    context = written(overview_context(chunks, settings))
    return checked(draft(context, titles), context, titles), context


def with_limit(settings: Overview, most: int) -> Overview:
    """The settings with another bound on replies."""
    return dataclasses.replace(settings, max_output_tokens=most)
