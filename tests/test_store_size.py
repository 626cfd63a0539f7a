"""What an import writes and shuffles besides the store's own tables."""

import re

from pyspark.sql import functions as F

from sheaf import catalog
from sheaf.operators import chunking, dense, layout, lexical, store
from sheaf.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sources(spark):
    rows = [(f"p{i}", f"On p{i}", "made", "\n".join(f"keywords: word{k} of p{i} radar rain" if k == 1 else f"line {k} of p{i}" for k in range(i % 7 + 1))) for i in range(40)]
    return spark.createDataFrame(rows, "paper_id string, paper_title string, source string, text string")


def test_an_import_writes_no_terms_beside_its_segments(spark, tmp_path, monkeypatch):
    made, seen = sources(spark), []
    real = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, *more: seen.append(df.columns) or real(df, *more))
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    held.import_papers(made.drop("text"), fx.built(made).withColumn("vector_id", F.lit(None).cast("long")))
    assert not [c for c in seen if "columns" in c or "terms" in c]
    stored = held.table("lengths")
    assert held.table("postings").count() == lexical.postings(stored).count() > 0
    assert sorted(held.table("terms").collect()) == sorted(lexical.term_counts(stored).select(*held.table("terms").columns).collect())


def test_postings_filter_by_no_array(spark):
    """A filter by the array's size would sort a chunk's places again for every start."""
    rows = spark.createDataFrame([("content", "p", "c", 2, [["a"], [], ["b", "a", "b"]]), ("content", "p", "d", 0, [[], [], []])], "section_type string, paper_id string, id string, len int, columns array<array<string>>")
    assert "Filter" not in plan(lexical.postings(rows)).split("Generate")[1]
    assert sorted((r["term"], r["col"], r["positions"]) for r in lexical.postings(rows).collect()) == [("a", 0, [0]), ("a", 2, [1]), ("b", 2, [0, 2])]


def test_titled_chunks_meet_no_documents(spark):
    docs = spark.createDataFrame([("p", "Title"), ("q", None)], "paper_id string, paper_title string")
    rows = [("a", "p", "Own", "s", "x", "content"), ("b", "p", None, "s", "y", "content"), ("c", "q", None, None, "z", "content")]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, paper_title string, section string, raw_text string, section_type string")
    found = store.indexed_rows(chunks, docs)
    assert "isnull(paper_title" in plan(found) and "Union" in plan(found)
    assert sorted((r["chunk_id"], r["paper_title"], r["section"]) for r in found.collect()) == [("a", "Own", "s"), ("b", "Title", "s"), ("c", "", "")]


def test_block_places_move_no_texts(spark):
    items = fx.layout_items(sources(spark).select("paper_id", fx.items_of(F.col("text")).alias("items")))
    items = catalog.written(items)
    shown = plan(layout.blocks_of_papers(layout.front_matter_blocks(items)))
    below = shown[shown.rindex("Window [last") :].splitlines()[1]
    carried = re.findall(r"(?:\[|, )(pos|text|page)#\d+(?=,|\])", below)
    assert "pos" in carried and "text" not in carried


def test_numbered_chunks_equal_numbering_afterwards(spark):
    made = sources(spark)
    got = fx.built(made, numbered=True)
    content = fx.built(made).where("section_type = 'content'").select("paper_id", "chunk_index", "chunk_id")
    ids = dense.number_rows(content, "paper_id", "chunk_index").select("chunk_id", "vector_id")
    want = fx.built(made).join(ids, "chunk_id", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["section_type"] for r in got.collect()} == {"content", "bibliography"}
    assert {r["front_matter_type"] for r in got.collect()} >= {None, "abstract"}


def test_violations_count_ids_and_neighbours_in_one_grouping(spark):
    made = catalog.written(fx.built(sources(spark)).where("paper_id in ('p5', 'p6')"))
    doubled = made.unionByName(made.where("chunk_id = 'p5_chunk_0000'")).where("chunk_id != 'p6_chunk_0001'")
    found = chunking.violations(doubled)
    assert {r["rule"]: r["n"] for r in found.collect()} == {"chunk id": 1, "indexes": 2, "neighbour": 2}
    assert "LeftAnti" not in plan(found)


def test_postings_read_no_whole_array_for_each_term(spark):
    rows = spark.createDataFrame([("content", "p", "c", 4, [["b", "a", "b"], [], ["a"]])], "section_type string, paper_id string, id string, len int, columns array<array<string>>")
    made = lexical.postings(rows)
    assert "slice(" not in plan(made)
    assert [(r["term"], r["col"], r["positions"]) for r in made.collect()] == [("a", 0, [1]), ("a", 2, [0]), ("b", 0, [0, 2])]
