"""The store of the fixture tables over rows that come twice and documents without words."""

from sheaf.plans import fixtures as fx

SCHEMA = "doc_id long, text string, source string"
ROWS = [(1, "one line\nand another", "a"), (1, "one line\nand another", "a"), (2, "one line\nand another", "b"), (2, "one line\nand another", "b"), (3, "some other words", "c"), (4, "", "d"), (5, " \n ", "e"), (None, "some other words", "f")]


def test_a_row_that_comes_twice_is_one_paper(spark):
    found = fx.distinct_papers(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["source"], r["text"]) for r in found) == [(2, "b", "one line\nand another"), (3, "c", "some other words"), (4, "d", ""), (5, "e", " \n ")]


def test_the_store_takes_doubled_rows_and_blank_documents(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    held = fx.store(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in held.table("documents").collect()) == [2, 3, 4, 5]
    got = held.table("chunks").collect()
    assert sorted((r["raw_text"], r["vector_id"]) for r in got) == sorted((t, i + 1) for i, t in enumerate(r["raw_text"] for r in sorted(got, key=lambda r: r["chunk_id"])))
    assert {r["raw_text"] for r in got} == {"one line\nand another", "some other words"}
