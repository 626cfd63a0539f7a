"""Replies that are kept, and overviews of many papers at once."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf import overviews, replies
from sheaf.config import Overview
from sheaf.operators import overview
from sheaf.plans import fixtures as fx


class Model:
    """Counts its calls in a folder; fails as the text says."""

    def __init__(self, folder, bound=None):
        self.folder, self.bound = folder, bound

    def limited(self, most):
        return Model(self.folder, most)

    def complete_json(self, system, user, schema):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if "slow" in user:
            raise TimeoutError("later")
        if "bad" in user:
            raise ValueError(user)
        return json.dumps({"said": user.upper(), "bound": self.bound})


def test_every_prompt_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    made = lambda: Model(str(calls))
    folder = str(tmp_path / "replies")
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "slow"), (5, "bad"), (6, None), (7, " ")]
    prompts = spark.createDataFrame(rows, "qid long, query string").repartition(3)

    def run(frame=prompts, **more):
        before = len(list(calls.iterdir()))
        got = {r["qid"]: (r["payload"] and json.loads(r["payload"])["said"], r["failure"]) for r in replies.ask(frame, folder, made, "m", "s", {}, **more).collect()}
        return got, len(list(calls.iterdir())) - before

    want = {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, "TimeoutError"), 5: (None, "ValueError"), 6: (None, None), 7: (None, None)}
    assert run(parts=2) == (want, 4)
    # only what may pass is asked again, and not for ever
    assert run() == (want, 1) and run() == (want, 1) and run() == (want, 0)
    more = spark.createDataFrame([(9, "c"), (1, "b")], "qid long, query string")
    assert run(more) == ({9: ("C", None), 1: ("B", None)}, 1)
    # another model, system text or schema is another prompt
    keys = {spark.range(1).select(replies.key_of(F.lit("a"), *x)).first()[0] for x in (("m", "s", {}), ("ms", "", {}), ("m", "s", {"a": 1}), ("n", "s", {}))}
    assert len(keys) == 4


def test_overviews_of_all_papers(spark, sf, tmp_path):
    chunks = fx.chunks(spark, sf)
    titles = fx.papers(spark, sf).select("paper_id", "paper_title")
    settings = Overview(max_total_context_tokens=600)
    results, context = overviews.overviews(chunks, titles, settings)
    context = context.cache()
    rows = results.collect()
    assert len(rows) == context.select("paper_id").distinct().count() and all(r["problem"] is None for r in rows)
    assert all([f["field"] for f in r["fields"]] == list(overview.ROLES) for r in rows)
    made = {r["paper_id"]: r for r in overviews.records(results, context, titles, settings).collect()}
    one = json.loads(made[rows[0]["paper_id"]]["overview"])
    assert set(one) == {"paper_title", *overview.ROLES} and json.loads(made[rows[0]["paper_id"]]["context"])["budget"] == 600
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = overviews.questions(context, titles)
    drafts = overviews.drafted(asked, str(tmp_path / "r"), lambda: Model(str(calls)), "m", overviews.with_limit(settings, 777))
    assert {json.loads(r["payload"])["bound"] for r in drafts.collect()} == {777} and len(list(calls.iterdir())) == asked.count()
    context.unpersist()


FIELD = {"content": overview.MISSING, "source_chunk_ids": []}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None),
        ({"more": 1}, "no overview"),
        ({"datasets": None}, "no overview"),
        ({"datasets": {**FIELD, "extra": 1}}, "no overview"),
        ({"datasets": {"content": 3, "source_chunk_ids": []}}, "no overview"),
        ({"datasets": {"content": "x", "source_chunk_ids": [1]}}, "no overview"),
        ({"datasets": {"content": "x"}}, "no overview"),
        ({"paper_title": "Other"}, "title differs"),
        ({"paper_title": 3}, "no overview"),
        ({"datasets": {"content": "x", "source_chunk_ids": []}}, "datasets: no source"),
        ({"datasets": {"content": "x", "source_chunk_ids": ["c9"]}, "limitations": {"content": "y", "source_chunk_ids": []}}, "datasets: unknown chunk"),
        ({"datasets": {"content": "x", "source_chunk_ids": ["c1", " c1", "c2"]}}, None),
    ],
)
def test_drafts_are_checked_strictly(spark, change, problem):
    draft = {"paper_title": "T", **{r: FIELD for r in overview.ROLES}} | change
    if change == {"datasets": None}:
        del draft["datasets"]
    context = spark.createDataFrame([("p", "c1", "S1"), ("p", "c2", "S2")], "paper_id string, chunk_id string, section string")
    titles = spark.createDataFrame([("p", "T")], "paper_id string, paper_title string")
    drafts = spark.createDataFrame([("p", json.dumps(draft)), ("q", "no json"), ("r", None)], "paper_id string, payload string")
    got = {r["paper_id"]: r for r in overviews.checked(drafts, context, titles).collect()}
    assert got["p"]["problem"] == problem and got["q"]["problem"] == got["r"]["problem"] == "no overview"
    if (change.get("datasets") or {}).get("source_chunk_ids") == ["c1", " c1", "c2"]:
        field = next(f for f in got["p"]["fields"] if f["field"] == "datasets")
        assert field["source_chunk_ids"] == ["c1", "c2"] and field["source_sections"] == ["S1", "S2"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_move_no_texts_and_are_made_once(spark, sf):
    chunks = fx.chunks(spark, sf)
    placed = overview.candidates(chunks)
    chosen = overview.role_top(overview.role_scores(placed), Overview())
    shown = _plan(overview.select(chosen, Overview()))
    below = shown[shown.rindex("Window [min(") :].splitlines()[1]
    assert "signals" in below and "raw_text" not in below
    # the seven roles' words stand once in the plan
    assert shown.count("better than") == 1
    selected = spark.createDataFrame([], "paper_id string")
    joined = _plan(overview.fallback(placed, selected, Overview()))
    assert "raw_text" not in joined[: joined.index("LeftAnti")]


def test_drafts_are_parsed_once(spark):
    context = spark.createDataFrame([("p", "c1", "S1")], "paper_id string, chunk_id string, section string")
    titles = spark.createDataFrame([("p", "T")], "paper_id string, paper_title string")
    drafts = spark.createDataFrame([("p", "{}")], "paper_id string, payload string")
    assert "from_json" not in _plan(overviews.checked(drafts, context, titles))
    parsed = _plan(drafts.select(overview.parse_draft(F.col("payload")).alias("d")))
    assert parsed.count("from_json") + parsed.count("JsonToStructs") <= 1


def test_signals_of_wide_letters_are_counted(spark):
    import re

    assert all(s.isascii() or re.fullmatch(f"{overview.WIDE}+", s) for words in overview.SIGNALS.values() for s in words)
    rows = [("a", "p", 0, "1. Introduction", "However 问题 und 挑战", 4, "content", None), ("b", "p", 1, "数据集", "Größe", 1, "content", None), ("c", "p", 2, "Dataset", "none", 1, "content", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index long, section string, raw_text string, raw_token_count long, section_type string, front_matter_type string")
    signals = {r["chunk_id"]: dict(zip(overview.ROLES, r["signals"])) for r in overview.said(chunks).collect()}
    assert signals["a"]["research_problem"] == 3 and signals["b"]["datasets"] == 2 and signals["c"]["datasets"] == 1
    assert signals["b"]["research_problem"] == 0
