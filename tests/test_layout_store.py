"""Layout passes, catalog, workspaces, sources and streaming on literal rows."""

import pytest
from pyspark.sql import functions as F

from sheaf import adaptors, catalog, workspace
from sheaf.operators import chunking, layout, overview
from sheaf.plans import fixtures as fx
from sheaf.sources import readers
from sheaf.streaming import ingest


def items(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "paper_id string, pos int, label string, text string, page int")


def title(spark, rows):
    return layout.resolve_title(layout.title_candidates(items(spark, rows))).first()["paper_title"]


def test_titles(spark):
    chain = [("TEXT", "Ann Lee, Bob Ray", 1), ("TEXT", "School of Roads", 1), ("SECTION_HEADER", "Abstract", 1)]
    assert title(spark, [("SECTION_HEADER", "Journal of Roads", 1), ("TEXT", "journal homepage: www.x.org", 1), ("TITLE", "Roads and Rain", 1), *chain]) == "Roads and Rain"
    # plain text can be a title where the chain supports it, but an author line can't
    assert title(spark, [("TEXT", "Roads and Rain", 1), *chain]) == "Roads and Rain"
    assert title(spark, [("SECTION_HEADER", "Alone", 1)]) is None
    assert title(spark, [("TITLE", "Twice the Title", 1), ("TITLE", "Twice the Titles", 1)]) is None
    # what lies outside the first pages is no candidate
    assert title(spark, [("TITLE", "Late Title", 3), *chain]) is None


def test_furniture_needs_stable_places(spark):
    rows = [("TEXT", "Running head", 1, 50.0, 790.0, 200.0, 780.0), ("TEXT", "Running  head", 2, 50.5, 790.5, 200.0, 780.0), ("TEXT", "Moves", 1, 50.0, 790.0, 200.0, 780.0), ("TEXT", "Moves", 2, 80.0, 790.0, 200.0, 780.0), ("TEXT", "Body", 1, 50.0, 400.0, 200.0, 380.0), ("TEXT", "Body", 2, 50.0, 400.0, 200.0, 380.0), ("TEXT", "3 of 11", 2, 50.0, 400.0, 60.0, 390.0)]
    frame = spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "paper_id string, pos int, label string, text string, page int, l double, t double, r double, b double")
    assert [r["text"] for r in layout.furniture(frame, 800.0).collect()] == ["Running head"]
    assert sorted({r["text"] for r in layout.without_furniture(frame, 800.0).collect()}) == ["Body", "Moves"]


def test_captions_once(spark):
    once = "Table 2. " + "speeds of roads by hour of day " * 3
    rows = [("CAPTION", once + " " + once, 1), ("CAPTION", once + " Table 2. but quite another text follows here " + "z" * 80, 1), ("TEXT", once + " " + once, 1)]
    got = [r["text"] for r in layout.captions_once(items(spark, rows)).orderBy("pos").collect()]
    assert got[0] == once.strip() and got[1:] == [rows[1][1], rows[2][1]]


def test_html_that_is_malformed(spark):
    html = '<title>A &amp; B</title><script>x("<p>no</p>")</script><!-- <p>no</p> --><h1>Head<p>One <b>bold<br>line<p>Two<ul><li>Item</ul><footer>Foot</footer>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r["label"], r["text"]) for r in readers.html_items(pages).orderBy("pos").collect()]
    assert got == [("TITLE", "A & B"), ("SECTION_HEADER", "Head"), ("TEXT", "One bold line"), ("TEXT", "Two"), ("LIST_ITEM", "Item"), ("PAGE_FOOTER", "Foot")]


OVERVIEW = [("0", "Abstract", "We propose a model."), ("1", "1. Introduction", "The problem is hard. However"), ("2", "3. Flow", "Layers"), ("3", "3.1 Units", "Units"), ("4", "4. Experiments", "Accuracy 95.1% in table 2"), ("5", "5. Conclusion", "future work"), ("6", "References", "[1] problem")]


def overview_chunks(spark):
    rows = [(f"p_chunk_000{i}", "p", int(i), s, t, 10, "bibliography" if s == "References" else "content", None) for i, s, t in OVERVIEW]
    return spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index long, section string, raw_text string, raw_token_count long, section_type string, front_matter_type string")


def test_overview(spark):
    placed = overview.candidates(overview_chunks(spark))
    kinds = {r["chunk_index"]: r["category"] for r in placed.collect()}
    assert kinds == {0: "abstract", 1: "introduction", 2: "method", 3: "method", 4: "experiments", 5: "conclusion"}
    scores = {(r["role"], r["chunk_index"]): r["score"] for r in overview.role_scores(placed).collect()}
    assert scores["research_problem", 1] == 5 + 2 + 5 * 2 and scores["limitations", 5] == 5 + 9
    assert scores["main_results", 4] == 5 + 9 * 2 + min(2 / 5 * 8, 6)
    context = workspace.overview_context(overview_chunks(spark))
    assert [r["ord"] for r in context.orderBy("ord").collect()] == list(range(1, 7))


def test_catalog(spark, tmp_path, sf):
    store = catalog.Catalog(spark, str(tmp_path / "store"))
    papers = fx.papers(spark, sf).where("doc_id < 20").drop("text")
    chunks = fx.chunks(spark, sf).join(papers.select("paper_id"), "paper_id", "left_semi").withColumn("vector_id", F.lit(None).cast("long"))
    first = store.import_papers(papers, chunks)
    # the same papers again change nothing
    store.import_papers(papers, chunks)
    assert store.current() != first and store.table("chunks").count() == chunks.count() and store.table("documents").count() == papers.count()
    # a broken import leaves the old state
    now = store.current()
    with pytest.raises(catalog.CatalogError, match="neighbour"):
        store.import_papers(papers, chunks.where("chunk_index != 1"))
    assert store.current() == now
    content = store.table("chunks").where("section_type = 'content'")
    ids = catalog.written(content.select("chunk_id", F.row_number().over(catalog_window()).cast("long").alias("vector_id"), F.sha2(F.col("embedding_text").cast("binary"), 256).alias("text_sha256")))
    with pytest.raises(catalog.CatalogError, match="fit"):
        store.assign_vectors(ids.where("vector_id > 1"))
    with pytest.raises(catalog.CatalogError, match="unique"):
        store.assign_vectors(ids.withColumn("vector_id", F.lit(1).cast("long")))
    store.assign_vectors(ids)
    with pytest.raises(catalog.CatalogError, match="vectors"):
        store.import_papers(papers, chunks)
    # recovery: the journal's mapping is the stored one, or it is refused
    mapping = ids.select("vector_id", "chunk_id")
    folder = catalog.shared_folder(spark)
    mapping.write.parquet(folder)
    line = F.concat_ws("|", F.col("vector_id").cast("string"), "chunk_id")
    from sheaf.operators import dense

    mark = dense.fingerprint(mapping, line, "vector_id", "chunk_id").first()["fingerprint"]
    assert store.recover(store.table("chunks")) == "none"
    store.files.write_json("pending.json", {"mapping": folder, "fingerprint": "other"})
    with pytest.raises(catalog.CatalogError, match="changed"):
        store.recover(store.table("chunks"))
    store.files.write_json("pending.json", {"mapping": folder, "fingerprint": mark})
    assert store.recover(store.table("chunks")) == "published" and store.recover(store.table("chunks")) == "none"
    store.files.write_json("pending.json", {"mapping": folder, "fingerprint": mark})
    assert store.reset_vectors() == ids.count() and store.recover(store.table("chunks")) == "discarded"


def catalog_window():
    from pyspark.sql import Window

    return Window.orderBy("chunk_id")


def test_versions(spark, tmp_path):
    catalog.Files(spark, str(tmp_path / "a")).write_json("pointers/000000000001.json", {"version": 1, "schema_version": 9})
    with pytest.raises(catalog.CatalogError, match="version"):
        catalog.Catalog(spark, str(tmp_path / "a"))
    catalog.Files(spark, str(tmp_path / "b")).write_json("current.json", {"snapshot": "x", "schema_version": 4})
    with pytest.raises(catalog.CatalogError, match="older"):
        catalog.Catalog(spark, str(tmp_path / "b"))
    old = spark.createDataFrame([("c0", "p", "A B S T R A C T", 1, 1), ("c1", "p", "7. References", 2, 2), ("c2", "p", "Intro", 1, 1)], "chunk_id string, paper_id string, section string, page_start int, page_end int")
    blocks = spark.createDataFrame([("p", "abstract", "Front matter > Abstract", 1, 2, 0)], "paper_id string, block_type string, canonical_section string, page_start int, page_end int, block_index int")
    got = {r["chunk_id"]: (r["content_kind"], r["front_matter_type"], r["section_type"]) for r in catalog.migrate(old, 1, blocks).collect()}
    assert got == {"c0": ("front_matter", "abstract", "content"), "c1": ("body", None, "bibliography"), "c2": ("body", None, "content")}
    with pytest.raises(catalog.CatalogError):
        catalog.migrate(old, 7)


def test_workspace(spark, tmp_path, sf):
    paper = fx.chunks(spark, sf).groupBy("paper_id").count().orderBy(F.desc("count")).first()["paper_id"]
    chunks = fx.chunks(spark, sf).where(F.col("paper_id") == paper)
    parent = str(tmp_path / "w")
    name = workspace.create(chunks, parent, adaptors.HashEmbedder, "0" * 64)
    assert workspace.open_chunks(spark, parent, name).count() == chunks.count()
    text = chunks.where("section_type = 'content'").orderBy("chunk_index").first()
    found = workspace.search(spark, parent, name, text["embedding_text"], adaptors.HashEmbedder(), 2).orderBy("rank").first()
    assert found["chunk_id"] == text["chunk_id"] and found["score"] == pytest.approx(1, abs=1e-5)
    for bad in ("../x", "workspace_../" + "0" * 29, "workspace_" + "0" * 32):
        with pytest.raises(catalog.CatalogError):
            workspace.delete(spark, parent, bad)
    workspace.delete(spark, parent, name)
    assert not (tmp_path / "w" / name).exists()
    with pytest.raises(catalog.CatalogError, match="one paper"):
        workspace.create(fx.chunks(spark, sf), parent, adaptors.HashEmbedder, "0" * 64)


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "p", 0, "a", [1.0, 0.0]), ("c2", "p", 1, "b", [0.0, 1.0])], "chunk_id string, paper_id string, chunk_index long, embedding_text string, embedding array<float>")
    name = readers.write_artifact(rows, str(tmp_path), 2)
    assert readers.read_artifact(spark, name).count() == 2
    files = catalog.Files(spark, name)
    facts = files.read_json("manifest.json")
    for change in ({"fingerprint": "x"}, {"count": 3}, {"dimension": 3}):
        files.write_json("manifest.json", facts | change)
        with pytest.raises(catalog.CatalogError):
            readers.read_artifact(spark, name)
    with pytest.raises(catalog.CatalogError, match="not valid"):
        readers.write_artifact(rows.withColumn("embedding", F.array(F.lit(2.0), F.lit(0.0)).cast("array<float>")), str(tmp_path), 2)


def test_chunk_files(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"chunk_id":"c","paper_id":"p","chunk_index":0,"raw_text":"x"}\n\n')
    assert readers.read_chunks(spark, str(good)).count() == 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text("no json\n")
    with pytest.raises(Exception):
        readers.read_chunks(spark, str(bad)).collect()
    (tmp_path / "b.pdf").write_bytes(b"2")
    (tmp_path / "a.pdf").write_bytes(b"1")
    files = readers.pdf_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.pdf", "b.pdf"]
    got = readers.parse_files(files, lambda content: [{"label": "TEXT", "text": content.decode()}], "source_sha256 string, pos long, label string, text string")
    assert sorted(r["text"] for r in got.collect()) == ["1", "2"]


def test_models(spark):
    rows = spark.createDataFrame([(0, "some text"), (1, "other")], "i int, embedding_text string")
    assert all(len(r["embedding"]) == 8 for r in adaptors.embed(rows, lambda: adaptors.HashEmbedder(8)).collect())
    with pytest.raises(Exception, match="blank"):
        adaptors.embed(rows.withColumn("embedding_text", F.lit(" ")), adaptors.HashEmbedder).collect()

    class Fails:
        def rerank(self, query, passages):
            if query == "bad":
                raise RuntimeError("model")
            if query == "nan":
                return [float("nan")] * len(passages)
            return [len(p) for p in passages][: 1 if query == "few" else None]

    pairs = spark.createDataFrame([(0, "a", "good", "xx"), (0, "b", "good", "x"), (1, "a", "bad", "x"), (2, "a", "few", "x"), (2, "b", "few", "y"), (3, "a", "nan", "x"), (4, "a", "blank", " "), (4, "b", "blank", "x")], "qid long, chunk_id string, query string, passage string")
    assert sorted(map(tuple, adaptors.rerank(pairs, Fails).collect())) == [(0, "a", 2.0), (0, "b", 1.0)]

    class Client:
        def complete_json(self, system, user, schema):
            if "fails" in user:
                raise OSError
            return "{}"

    queries = spark.createDataFrame([(0, "works"), (1, "fails")], "qid long, query string")
    assert {r["qid"]: r["payload"] for r in adaptors.rewrite(queries, Client, "", {}).collect()} == {0: "{}", 1: None}
    assert adaptors.rerank(pairs.withColumn("passage", F.lit(" ")), Fails).count() == 0
    assert adaptors.extract_content({"choices": [{"message": {"content": " x "}}]}) == "x"
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": ""}}]}):
        with pytest.raises(ValueError):
            adaptors.extract_content(bad)


def test_streams_replay_to_the_same(spark, sf, tmp_path):
    target = str(tmp_path / "t")
    once = sorted(map(tuple, ingest.run_once(spark, f"{sf}/documents.parquet", target).collect()))
    assert sorted(map(tuple, ingest.run_once(spark, f"{sf}/documents.parquet", target).collect())) == once
    assert len(once) == fx.papers(spark, sf).count()


def test_broken_chunks_are_named(spark, sf):
    chunks = fx.chunks(spark, sf)
    assert chunking.violations(chunks).count() == 0
    bad = chunks.withColumn("section_type", F.lit("x")).withColumn("front_matter_type", F.lit("abstract"))
    assert {r["rule"] for r in chunking.violations(bad).collect()} == {"section type", "front matter type"}


def test_author_line_of_long_text_in_capitals(spark):
    """The names are those of the plain pattern, and a text of very many of them does not overflow the stack."""
    import random

    plain, draw = r"\b[A-Z][A-Za-z'’.-]{1,}(?:\s+[A-Z][A-Za-z'’.-]{1,})+\b", random.Random(5)
    parts = ["Jane", "DOE", "O'Neil", "A.", "B", "Né", "Jean-Né", "Jean-Aé", "x", "1", "Doe.", "D'", ",", "Foo_", "Mc-", "é"]
    rows = [("".join(draw.choice(parts) + draw.choice(["", " ", "  ", "\n", ", "]) for _ in range(draw.randint(1, 14))),) for _ in range(20_000)]
    texts = spark.createDataFrame(rows, "text string")
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    assert texts.where(found(plain) != found(layout.AUTHOR_NAME)).collect() == []
    long = spark.createDataFrame([("Ada LOVELACE " * 50_000 + ", Alan Turing",)], "text string")
    assert long.select(layout.author_line(F.col("text"))).first()[0]


def test_single_capitals_of_a_page_stay_apart(spark):
    """Only a layout's text layer draws letters apart; headings of HTML stand as they were written."""
    title = "A A A A reeder  B"
    pages = spark.createDataFrame([(1, f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>Text of it.</p></article></body></html>")], "page_id long, html string")
    done = layout.clean(readers.html_items(pages), trace=True)
    assert [r["text"] for r in done.items.orderBy("pos").collect()] == ["A A A A reeder B", "A A A A reeder B", "Text of it."]
    assert done.diagnostics.where("name = 'headings'").count() == 0
    placed = spark.createDataFrame([("p", 0, "SECTION_HEADER", "Q U I E T  A I R", 1)], "paper_id string, pos int, label string, text string, page int")
    assert [r["text"] for r in layout.clean(placed).items.collect()] == ["QUIET AIR"]
