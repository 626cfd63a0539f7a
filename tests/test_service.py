"""The composed service, prompts, overview drafts, index lifecycle and command line on a small store."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf import adaptors, catalog, cli, config, prompts, workspace
from sheaf.config import Reranking, Settings
from sheaf.operators import chunking, layout, lexical, overview
from sheaf.plans import fixtures as fx
from sheaf.service import Service
from sheaf.sources import readers

TEXTS = [
    "Sparse Flow Networks\nWe propose sparse flow networks for traffic.\nTraffic is hard to forecast.\nSparse flow uses graph attention.\nThe model has two layers.\nAccuracy rises on METR data.\n[1] Graph attention networks, 2018. [2] Diffusion networks.",
    "Dense Rain Models\nRain is forecast with dense models.\nDense models need radar images.\nThe radar images come hourly.\nErrors fall by 9.5 percent.\nFuture work will use satellites.\n[1] Rain by radar, 2015.",
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "made") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    held = catalog.Catalog(spark, str(tmp_path_factory.mktemp("store")))
    sources = fx.distinct_papers(docs)
    held.import_papers(sources.drop("text"), fx.built(sources).withColumn("vector_id", F.lit(None).cast("long")))
    held.publish_index(embedded(held), 64)
    return held


def embedded(held):
    content = held.table("chunks").where("section_type = 'content'")
    return adaptors.embed(content.select("chunk_id", "paper_id", "chunk_index", "embedding_text"), adaptors.HashEmbedder)


def ask(spark, *texts, turns=None):
    return spark.createDataFrame([(i, t, turns) for i, t in enumerate(texts)], "qid long, query string, turns array<string>")


def drafter(rows):
    reply = F.when(F.contains("query", F.lit("How often")), F.lit('{"answer":"Hourly [E1].","citations":["E1"],"insufficient_evidence":false}')).otherwise(F.lit('{"answer":"See [E9].","citations":["E9"],"insufficient_evidence":false}'))
    return rows.select("qid", reply.alias("payload"))


def test_answers_from_a_store(spark, store):
    service = Service(store, drafter=drafter)
    questions = ask(spark, "How often do radar images come", "sparse flow networks", "which references does it cite")
    rows = {r["qid"]: json.loads(r["json"]) for r in service.answer(questions).collect()}
    first = rows[0]
    assert (first["answer_status"], first["answer"], first["citations"]) == ("success", "Hourly [E1].", ["E1"])
    assert first["reranking_status"] == "success" and first["rewrite_plan"]["status"] == "success"
    assert any("hourly" in e["text"] for e in first["evidence"]) and first["evidence"][0]["evidence_id"] == "E1"
    hit = first["retrieved_chunks"][0]
    assert hit["rank"] == 1 and hit["source_matches"] and hit["pre_rerank_rank"] >= 1 and hit["vector_id"] and hit["section_type"] == "content"
    # a citation of evidence that was not given is refused
    assert rows[1]["answer_status"] == "fallback" and rows[1]["answer"] is None
    assert rows[2]["rewrite_plan"]["search_bibliography"] is True


def test_references_are_hits_of_their_own(spark, store):
    rewriter = lambda q: q.select("qid", "query", F.lit('{"semantic_query":"graph attention","lexical_keywords_en":["graph attention","networks"],"search_bibliography":true}').alias("payload"))
    service = Service(store, rewriter=rewriter)
    records = [json.loads(r["json"]) for r in service.records(service.retrieve(ask(spark, "sparse flow graph attention"))).orderBy("rank").collect()]
    assert [r["rank"] for r in records] == list(range(1, len(records) + 1))
    last = records[-1]
    assert last["section_type"] == "bibliography" and last["source_matches"][0]["route"] == "bm25_bibliography" and last["fused_score"] == 0 and last["pre_rerank_rank"] is None
    units = service.evidence(service.retrieve(ask(spark, "sparse flow graph attention"))).collect()
    assert {u["kind"] for u in units} == {"content", "bibliography"}


def test_reranking_off_and_limits(spark, store):
    off = Service(store, Settings(reranking=Reranking(enabled=False)))
    found = off.retrieve(ask(spark, "dense rain models"))
    rows = found.hits.orderBy("final_rank").collect()
    assert [r["pre_rank"] for r in rows] == [r["final_rank"] for r in rows] and all(r["rerank_score"] is None for r in rows)
    assert found.plans.first()["reranking_status"] == "disabled" and len(rows) > 5
    assert off.retrieve(ask(spark, "dense rain models"), 2).hits.count() == 2
    nothing = Service(store, config.build(Settings, {"retrieval": {"rewrite": {"enabled": False}}, "answer": {"enabled": False}}))
    row = json.loads(nothing.answer(ask(spark, "dense rain models")).first()["json"])
    assert row["rewrite_plan"]["status"] == "disabled" and row["answer_status"] == "disabled"


def test_a_reranker_that_fails_leaves_the_order(spark, store):
    class Fails:
        def rerank(self, query, passages):
            raise RuntimeError("model")

    found = Service(store, reranker=Fails).retrieve(ask(spark, "dense rain models"))
    assert found.plans.first()["reranking_status"] == "fallback"
    rows = found.hits.where("section_type = 'content'").orderBy("final_rank").collect()
    assert [r["pre_rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_index_lifecycle(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "made") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    sources = fx.distinct_papers(docs)
    chunks = fx.built(sources).withColumn("vector_id", F.lit(None).cast("long"))
    held.import_papers(sources.drop("text"), chunks)
    made = held.table("documents").first()
    assert made["ingested_at"] == made["updated_at"]
    held.import_papers(sources.drop("text"), chunks)
    again = held.table("documents").where(F.col("paper_id") == made["paper_id"]).first()
    assert again["ingested_at"] == made["ingested_at"] < again["updated_at"]
    with pytest.raises(catalog.CatalogError, match="no index"):
        held.verify_index()
    # cut short before the swap: nothing took place
    held.publish_index(embedded(held), 64, stop="journal")
    assert held.table("chunks").where("vector_id is not null").count() == 0 and held.recover() == "discarded"
    # cut short after it: all did
    held.publish_index(embedded(held), 64, stop="swap")
    assert held.recover() == "published" and held.recover() == "none"
    assert held.verify_index().count() == 0
    with pytest.raises(catalog.CatalogError, match="assigned already"):
        held.publish_index(embedded(held), 64)
    with pytest.raises(catalog.CatalogError, match="has vectors"):
        held.import_papers(sources.drop("text"), chunks)
    before = held.table("postings")
    held.rebuild_index(embedded(held), 64)
    assert held.verify_index().count() == 0
    # what no table lies in goes, once it is old enough
    assert held.vacuum() == []
    gone = held.vacuum(0)
    assert gone and held.verify_index().count() == 0 and held.index().terms.count() > 0 and held.vacuum(0) == []
    # the lexical index stayed where it was
    assert held.table("postings").inputFiles() == before.inputFiles()
    changed = held.table("chunks").withColumn("embedding_text", F.concat("embedding_text", F.lit("!")))
    held.publish({"chunks": changed.withColumn("vector_id", F.col("vector_id") + 1)})
    assert {r["problem"] for r in held.verify_index().collect()} == {"mapping", "text changed", "fingerprint"}
    with pytest.raises(catalog.CatalogError, match="not valid"):
        held.reset_vectors()
        held.publish_index(embedded(held), 32)
    assert held.reset_vectors() == 0


def test_replaced_papers_leave_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, TEXTS[0], "made"), (1, TEXTS[1], "made")], "doc_id long, text string, source string")
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    sources = fx.distinct_papers(docs)
    chunks = fx.built(sources).withColumn("vector_id", F.lit(None).cast("long"))
    held.import_papers(sources.drop("text"), chunks)
    df = lambda term: {r["section_type"]: r["df"] for r in held.index().terms.where(F.col("term") == term).collect()}
    assert df("radar") and df("rain")
    paper = sources.where("doc_id = 1").first()["paper_id"]
    fresh = chunks.where(F.col("paper_id") == paper).withColumn("raw_text", F.lit("other words")).withColumn("paper_title", F.lit("Other"))
    held.import_papers(sources.where("doc_id = 1").drop("text"), fresh)
    assert not df("radar") and df("other") and df("sparse")
    queries = spark.createDataFrame([(0, ["other words"])], "qid long, texts array<string>")
    assert lexical.search(held.index().of("content"), queries, 10).count() > 0


def test_overview_drafts(spark, tmp_path, store):
    paper = store.table("documents").where("paper_title like 'Dense%'").first()
    name = workspace.create(store.table("chunks").where(F.col("paper_id") == paper["paper_id"]), str(tmp_path), adaptors.HashEmbedder, "")
    context = workspace.overview_context(workspace.open_chunks(spark, str(tmp_path), name)).collect()
    some = context[0]["chunk_id"]
    draft = {"paper_title": "Dense Rain Models", **{r: {"content": overview.MISSING, "source_chunk_ids": []} for r in overview.ROLES}}
    draft["main_method"] = {"content": "Dense models.", "source_chunk_ids": [some, some]}
    done = workspace.write_overview(spark, str(tmp_path), name, json.dumps(draft), "Dense Rain Models")
    assert done["main_method"]["source_chunk_ids"] == [some] and done["main_method"]["source_sections"] == [context[0]["section"]]
    files = catalog.Files(spark, f"{tmp_path}/{name}")
    assert files.read_json("overview.json") == done and files.read_json("context.json")["selected_chunks"]
    for change, problem in (({"paper_title": "Other"}, "title differs"), ({"datasets": {"content": "x", "source_chunk_ids": []}}, "no source"), ({"datasets": {"content": "x", "source_chunk_ids": ["nowhere"]}}, "unknown chunk"), ({"datasets": {"content": overview.MISSING, "source_chunk_ids": [some]}}, "missing field cites")):
        with pytest.raises(catalog.CatalogError, match=problem):
            workspace.write_overview(spark, str(tmp_path), name, json.dumps(draft | change), "Dense Rain Models")
    with pytest.raises(catalog.CatalogError, match="no overview"):
        workspace.write_overview(spark, str(tmp_path), name, "text", "Dense Rain Models")
    shown = prompts.passages(workspace.overview_context(workspace.open_chunks(spark, str(tmp_path), name))).first()["passages"]
    assert f"[{some}]" in shown


def test_prompts(spark):
    rows = spark.createDataFrame([("what is it", ["a model"]), ("x", None)], "query string, turns array<string>")
    first, second = (r[0] for r in rows.select(prompts.rewrite(F.col("query"), F.col("turns"), 3)).collect())
    assert "- a model" in first and "what is it" in first and "3 keywords" in first and prompts.NO_CONTEXT in second
    assert set(prompts.overview_schema()["properties"]) == {"paper_title", *overview.ROLES}
    title = spark.range(1).select(prompts.paper_overview(F.lit(" "), F.lit("text"))).first()[0]
    assert overview.MISSING in title and "text" in title


def test_tables_repeat_their_heading(spark):
    words = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([("p", "t", "s", [("Results", f"name value {words}", 27, 1, "name value"), ("Results", "short", 1, 1, None)])], "paper_id string, paper_title string, source string, items array<struct<section:string,text:string,tokens:int,page:int,header:string>>")
    chunks = chunking.build(rows, 12, 2).orderBy("chunk_index").collect()
    assert all(c["raw_token_count"] <= 10 for c in chunks)
    assert [c["raw_text"].startswith("name value") for c in chunks][:3] == [True] * 3
    said = " ".join(c["raw_text"].replace("name value\n", "") for c in chunks).split()
    assert said == ["name", "value", *words.split(), "short"]


def test_front_matter_in_chunks(spark, store):
    kinds = {(r["section"], r["content_kind"], r["front_matter_type"]) for r in store.table("chunks").collect()}
    assert ("Abstract", "front_matter", "abstract") in kinds and ("References", "body", None) in kinds
    assert all((kind == "front_matter") == (section == "Abstract") for section, kind, _ in kinds)


def test_all_text_of_pages(spark):
    html = "before<h2>Part</h2>loose<table><tr><th>a</th><td>b <code>c</code></td></tr></table><pre>x  y</pre><blockquote>quote</blockquote>after <section>inner</section> end"
    rows = readers.html_items(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = [(r["label"], r["text"]) for r in rows.orderBy("pos").collect()]
    assert got == [("TEXT", "before"), ("SECTION_HEADER", "Part"), ("TEXT", "loose"), ("TABLE", "a | b c"), ("CODE", "x y"), ("TEXT", "quote"), ("TEXT", "after"), ("TEXT", "inner"), ("TEXT", "end")]
    text = readers.markdown(rows).first()["markdown"]
    assert text.startswith("before\n\n## Part\n\nloose") and "```\nx y\n```" in text


def test_clean_runs_all_passes(spark):
    rows = [("TITLE", "Sparse Flow Forecasting Networks"), ("TEXT", "Ann Lee, Bob Ray"), ("TEXT", "School of Roads"), ("TEXT", "Abstract: We fore-\ncast flows."), ("SECTION_HEADER", "1. Introduction 1.1. Roads"), ("TEXT", "Roads have humid-"), ("TEXT", "ity on them."), ("PAGE_FOOTER", "Journal"), ("TEXT", "3 of 11"), ("FORMULA", "y = 1 \\quad ( 1 2 ) rest</formula>")]
    items = spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "paper_id string, pos int, label string, text string")
    cell = lambda t: (t, False)
    tables = spark.createDataFrame([("p", 20, [], [[cell("x = 1"), cell("(1)")], [cell("x = 2"), cell("(2)")]])], "paper_id string, pos int, captions array<string>, grid array<array<struct<text:string,column_header:boolean>>>")
    items = items.union(spark.createDataFrame([("p", 20, "TABLE", "x = 1 (1)")], items.schema))
    done = layout.clean(items, tables, trace=True)
    got = [(r["label"], r["text"]) for r in done.items.orderBy("pos").collect()]
    assert got == [
        ("TITLE", "Sparse Flow Forecasting Networks"), ("SECTION_HEADER", "Authors and affiliations"), ("TEXT", "Ann Lee, Bob Ray"), ("TEXT", "School of Roads"), ("SECTION_HEADER", "Abstract"), ("TEXT", "We forecast flows."),
        ("SECTION_HEADER", "1. Introduction"), ("SECTION_HEADER", "1.1. Roads"), ("TEXT", "Roads have humidity"), ("TEXT", "on them."), ("FORMULA", "y = 1 \\quad ( 1 2 )"), ("FORMULA", "x = 1 \\quad (1)"), ("FORMULA", "x = 2 \\quad (2)"),
    ]
    assert done.titles.first()["paper_title"] == "Sparse Flow Forecasting Networks"
    counts = {r["name"]: r["n"] for r in done.diagnostics.collect()}
    assert counts["formula_tables"] == 1 and counts["hyphens"] == 3 and counts["headings"] == 1 and counts["furniture_removed"] == 2 and counts["front_matter_abstract"] == 1 and counts["front_matter_authors_affiliations"] == 1
    cells = layout.table_fragments(spark.createDataFrame([([["text  8 of ", "x"]],)], "g array<array<string>>").select(F.transform("g", lambda r: F.transform(r, lambda c: F.struct(c.alias("text")))).alias("grid")))
    assert [c["text"] for c in cells.first()["grid"][0]] == ["text", "x"]


def test_circles_are_refused(spark):
    items = spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "paper_id string, pos long, parent_pos long")
    with pytest.raises(catalog.CatalogError, match="circle"):
        layout.flattened(items)


def test_files_are_named_one_way(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1")
    assert readers.pdf_files(spark, paths=[str(tmp_path / "a.pdf")] * 2).count() == 1
    for wrong in ({}, {"folder": str(tmp_path), "paths": ["a.pdf"]}, {"paths": ["a.txt"]}, {"paths": []}):
        with pytest.raises(ValueError):
            readers.pdf_files(spark, **wrong)


def test_settings_files(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"storage": {"store": "here", "artifacts": "s3://bucket/x"}, "reranking": {"enabled": false}}')
    settings = config.load(str(path))
    assert settings.storage.store == str(tmp_path / "here") and settings.storage.artifacts == "s3://bucket/x" and not settings.reranking.enabled
    client = adaptors.HttpChatClient(config.ModelRuntime(base_url="http://x", model="m"))
    assert client.limited(77).runtime.max_output_tokens == 77 and client.runtime.max_output_tokens == 1024


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("SHEAF_LLM_MODEL", raising=False)
    assert cli.main(["health"]) == 2
    monkeypatch.setenv("SHEAF_LLM_MODEL", "m")
    monkeypatch.setenv("SHEAF_LLM_BASE_URL", "http://127.0.0.1:9")
    assert cli.main(["health"]) == 1
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "made") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(docs)
    store = str(tmp_path / "store")
    assert cli.main(["inspect", store]) == 2
    assert cli.main(["import", docs, store]) == 0
    # no section, page or title that the documents do not have
    assert catalog.Catalog(spark, store).table("chunks").where("section is not null or page_start is not null or paper_title is not null").count() == 0
    assert cli.main(["retrieve", store, "radar images"]) == 1  # no index yet
    assert cli.main(["index", store]) == 0 and cli.main(["index", store]) == 1
    assert cli.main(["index", store, "--verify"]) == 0 and cli.main(["index", store, "--recover"]) == 0
    capsys.readouterr()
    assert cli.main(["retrieve", store, "radar images", "-k", "2"]) == 0
    assert [json.loads(x)["rank"] for x in capsys.readouterr().out.strip().splitlines()] == [1, 2]
    assert cli.main(["answer", store, "radar images"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["answer_status"] == "fallback"
    assert cli.main(["embed", store, str(tmp_path / "artifacts")]) == 0
    assert readers.read_artifact(spark, capsys.readouterr().out.strip().splitlines()[-1]).count() > 0
    assert cli.main(["embed", store, str(tmp_path / "artifacts"), "--dimension", "16"]) == 0
    assert len(readers.read_artifact(spark, capsys.readouterr().out.strip().splitlines()[-1]).first()["embedding"]) == 16
    assert cli.main(["compact", store]) == 0 and cli.main(["import", docs, store]) == 1  # the papers have vectors
    paper = catalog.Catalog(spark, store).table("documents").first()["paper_id"]
    assert cli.main(["stage", store, paper, str(tmp_path / "w")]) == 0
    name = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.main(["overview", str(tmp_path / "w"), name]) == 0
    assert cli.main(["unstage", str(tmp_path / "w"), name]) == 0 and cli.main(["unstage", str(tmp_path / "w"), name]) == 2
    assert cli.main(["index", store, "--rebuild"]) == 0 and cli.main(["index", store, "--reset"]) == 0
    pages = str(tmp_path / "pages")
    spark.createDataFrame([(1, "<h1>Head</h1><p>Text</p>")], "page_id long, html string").write.parquet(pages)
    assert cli.main(["inspect-items", pages, "--label", "TEXT", "--markdown", str(tmp_path / "md")]) == 0
    assert spark.read.json(str(tmp_path / "md")).count() == 1
    assert cli.main(["import-pages", pages, str(tmp_path / "other")]) == 0 and catalog.Catalog(spark, str(tmp_path / "other")).table("chunks").first()["section"] == "Head"


def test_the_answer_prompt_has_earlier_turns_and_where_evidence_is_from(spark, store):
    seen = {}

    def drafter(asked):
        seen.update({r["qid"]: r["query"] for r in asked.collect()})
        return asked.withColumn("payload", F.lit('{"answer":"It is so. [E1]","citations":["E1"],"insufficient_evidence":false}'))

    service = Service(store, drafter=drafter)
    asked = spark.createDataFrame([(0, "What does this paper say about radar?", ["We spoke of rain models.", " "]), (1, "radar images", None)], "qid long, query string, turns array<string>")
    got = {r["qid"]: json.loads(r["json"]) for r in service.answer(asked).collect()}
    assert got[0]["answer_status"] == "success" and "- We spoke of rain models." in seen[0] and "(none)" not in seen[0] and "(none)" in seen[1]
    first = got[1]["evidence"][0]
    titles = {r["paper_id"]: r["paper_title"] for r in store.table("documents").collect()}
    assert f"[E1] content | {titles[first['paper_id']]} | {first['section']} | p. " in seen[1] and ",".join(first["chunk_ids"]) in seen[1]
    sources = [s for hit in got[1]["retrieved_chunks"] for s in hit["source_matches"]]
    assert all(s["query"] for s in sources) and {s["query"] for s in sources if s["route"] == "bm25_original"} <= {"radar images"}
