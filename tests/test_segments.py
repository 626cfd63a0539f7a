"""Segments: imports of a few papers, replaced ones, merging, two writers at once, streams."""

import pytest
from pyspark.sql import functions as F

from sheaf import adaptors, catalog, segments
from sheaf.operators import lexical
from sheaf.plans import fixtures as fx

WORDS = "sparse flow radar rain dense model graph index query merge segment paper chunk term score".split()


_BUILT = {}


def documents(spark, ids, salt=0):
    """Papers p<id> whose text depends on the salt: as the store's documents and chunks, built once for all."""
    if spark not in _BUILT:
        rows = [(f"p{i}", s, "\n".join(" ".join(WORDS[(i * 7 + k * 3 + s + j * j) % len(WORDS)] for j in range(12 + (i + k) % 5)) for k in range(5))) for i in range(31) for s in range(10)]
        sources = spark.createDataFrame(rows, "name string, salt int, text string").select(F.format_string("%s/%d", "name", "salt").alias("paper_id"), F.hash("name").cast("long").alias("doc_id"), F.concat(F.lit("On "), F.split("text", " ")[0], F.col("salt")).alias("paper_title"), F.lit("made").alias("source"), "text")
        own = lambda df: df.withColumns({c: F.regexp_replace(c, "/[0-9]", "") for c in df.columns if c.endswith("_id") and c not in ("doc_id", "vector_id")})
        chunks = fx.built(sources).withColumn("vector_id", F.lit(None).cast("long"))
        _BUILT[spark] = [catalog.written(own(df.withColumn("salt", F.split("paper_id", "/")[1].cast("int"))).coalesce(1)) for df in (sources.drop("text"), chunks)]
    wanted = F.col("paper_id").isin([f"p{i}" for i in ids]) & (F.col("salt") == salt)
    return tuple(df.where(wanted).drop("salt") for df in _BUILT[spark])


def searched(spark, held):
    queries = spark.createDataFrame([(0, ["radar rain"]), (1, ["sparse", "dense model"]), (2, ["graph"]), (3, ["nothing here"]), (4, ["term"])], "qid long, texts array<string>")
    return [sorted((r["qid"], r["id"], round(r["score"], 12), r["rank"]) for r in lexical.search(held.index().of(kind), queries, 50).collect()) for kind in ("content", "bibliography")]


def contents(held):
    drop = {"documents": ["ingested_at", "updated_at"]}
    return {t: sorted(map(str, held.table(t).drop(*drop.get(t, [])).select(*sorted(set(held.table(t).columns) - set(drop.get(t, [])))).collect())) for t in ("documents", "chunks", "postings", "lengths", "terms")}


def put(spark, held, ids, salt=0, **more):
    return held.import_papers(*documents(spark, ids, salt), **more)


def test_imports_replacements_and_merging_equal_a_full_build(spark, tmp_path):
    held = catalog.Catalog(spark, str(tmp_path / "a"))
    put(spark, held, range(12))
    put(spark, held, range(12, 15))
    put(spark, held, [3, 4, 13], 5)
    put(spark, held, [4, 20], 9)
    whole = catalog.Catalog(spark, str(tmp_path / "b"))
    parts = [documents(spark, [i for i in range(15) if i not in (3, 4, 13)]), documents(spark, [3, 13], 5), documents(spark, [4, 20], 9)]
    whole.import_papers(parts[0][0].unionByName(parts[1][0]).unionByName(parts[2][0]), parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1]))
    want, hits = contents(whole), searched(spark, whole)
    assert any(hits) and contents(held) == want and searched(spark, held) == hits
    assert held.pointer()["totals"] == whole.pointer()["totals"] and len(held.pointer()["tombstones"]) == 2
    # four small segments are of one size
    assert held.compact()["postings"] == 4
    assert contents(held) == want and searched(spark, held) == hits
    state = held.pointer()
    assert state["tombstones"] == [] and all(len(state["tables"][t]) == 1 for t in want)
    assert held.compact() == {} and held.current() == f"{state['version']:012d}"
    # a merged segment is replaced from like any other
    put(spark, held, [0, 13], 7)
    assert held.table("documents").count() == 16 and held.compact(whole=True)["chunks"] == 2 and held.pointer()["tombstones"] == []
    gone = held.vacuum(0)
    assert gone and held.vacuum(0) == [] and held.table("chunks").count() == held.table("lengths").count()
    assert len(held.files.names("pointers")) == 1


def test_a_small_import_writes_little(spark, sf, tmp_path):
    held, root = catalog.Catalog(spark, str(tmp_path / "s")), tmp_path / "s"
    size = lambda: sum(f.stat().st_size for f in root.rglob("*.parquet"))
    sources = fx.papers(spark, sf)
    chunks = fx.built(sources).withColumn("vector_id", F.lit(None).cast("long"))
    held.import_papers(sources.drop("text"), chunks)
    first = size()
    few = sources.orderBy("paper_id").limit(max(1, sources.count() // 100)).select("paper_id")
    held.import_papers(sources.drop("text").join(few, "paper_id", "left_semi"), chunks.join(few, "paper_id", "left_semi"))
    assert size() - first < 0.05 * first


def interleaved(held, other):
    """Let ``other`` run after the import has written its segments, right before its first pointer."""
    create, done = held.files.create_json, []

    def late(name, value):
        if not done:
            done.append(other())
        return create(name, value)

    held.segments.files.create_json = late
    return done


def test_two_writers_at_once_are_both_kept(spark, tmp_path):
    one, two = (catalog.Catalog(spark, str(tmp_path / "s")) for _ in range(2))
    put(spark, one, range(4))
    interleaved(one, lambda: put(spark, two, [10, 2], 3))
    put(spark, one, [11, 3], 4)
    whole = catalog.Catalog(spark, str(tmp_path / "w"))
    put(spark, whole, [0, 1])
    put(spark, whole, [10, 2], 3)
    put(spark, whole, [11, 3], 4)
    assert contents(one) == contents(whole) and searched(spark, one) == searched(spark, whole) and one.pointer()["version"] == 3


def test_two_writers_of_one_paper_one_is_refused(spark, tmp_path):
    one, two = (catalog.Catalog(spark, str(tmp_path / "s")) for _ in range(2))
    put(spark, one, range(2))
    interleaved(one, lambda: put(spark, two, [5], 1))
    with pytest.raises(catalog.CatalogError, match="another writer imported"):
        put(spark, one, [5, 6], 2)
    assert {r["paper_id"] for r in two.table("documents").collect()} == {"p0", "p1", "p5"}
    # what was not pointed to goes when it is old
    assert any("chunks" in n for n in two.vacuum(0)) and two.table("chunks").count() == two.table("lengths").count()


def test_merging_beside_an_import(spark, tmp_path):
    one, two = (catalog.Catalog(spark, str(tmp_path / "s")) for _ in range(2))
    for k in range(4):
        put(spark, one, [k, k + 1], k)
    interleaved(one, lambda: put(spark, two, [2, 9], 8))
    assert one.compact()["chunks"] == 4
    whole = catalog.Catalog(spark, str(tmp_path / "w"))
    for k in range(4):
        put(spark, whole, [k, k + 1], k)
    put(spark, whole, [2, 9], 8)
    assert contents(one) == contents(whole) and searched(spark, one) == searched(spark, whole) and len(one.pointer()["tombstones"]) == 1


def test_vectors_and_imports_beside_each_other(spark, tmp_path):
    held, other = (catalog.Catalog(spark, str(tmp_path / "s")) for _ in range(2))
    put(spark, held, range(3))
    embedded = adaptors.embed(held.table("chunks").where("section_type = 'content'").select("chunk_id", "paper_id", "chunk_index", "embedding_text"), adaptors.HashEmbedder)
    interleaved(held, lambda: put(spark, other, [7]))
    with pytest.raises(catalog.CatalogError, match="try again"):
        held.publish_index(embedded, 64)
    assert held.recover() == "discarded" and held.table("chunks").where("vector_id is not null").count() == 0
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    interleaved(held, lambda: other.publish_index(adaptors.embed(other.table("chunks").where("section_type = 'content'").select("chunk_id", "paper_id", "chunk_index", "embedding_text"), adaptors.HashEmbedder), 64))
    with pytest.raises(catalog.CatalogError, match="has vectors"):
        put(spark, held, [0], 4)
    assert other.verify_index().count() == 0
    put(spark, other, [30])
    assert other.table("chunks").where("vector_id is null and section_type = 'content'").count() > 0


def test_a_batch_is_taken_once(spark, tmp_path):
    held = catalog.Catalog(spark, str(tmp_path / "s"))
    put(spark, held, [0], source=("q", 0))
    now = put(spark, held, [1], source=("q", 1))
    assert put(spark, held, [1], 3, source=("q", 1)) == now and put(spark, held, [5], source=("q", 0)) == now
    assert held.table("documents").count() == 2 and put(spark, held, [5], source=("other", 0)) != now


def test_which_segments_are_merged():
    mb = 1 << 20
    assert segments.runs([1, 1, 1]) == [] and segments.runs([1, 1, 1, 1]) == [(0, 4)]
    assert segments.runs([900 * mb, 1, 1, 1]) == [] and segments.runs([900 * mb, 3 * mb, 3 * mb, 3 * mb, 3 * mb]) == [(1, 5)]
    assert segments.runs([3 * mb, 1 * mb, 1 * mb, 1 * mb]) == [(0, 4)]
    assert segments.tier(1) == 0 and segments.tier(mb + 1) == 1 and segments.tier(4 * mb + 1) == 2


def test_only_one_of_several_creates_a_file(spark, tmp_path):
    files = catalog.Files(spark, str(tmp_path))
    assert [files.create_json("a/1.json", {"k": k}) for k in range(3)] == [True, False, False]
    assert files.read_json("a/1.json") == {"k": 0} and files.names("a") == ["1.json"] and files.names("none") == []
