"""BM25 against an independent full-text index; fusion, quotas and expansion on literal rows."""

import random
import sqlite3
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.config import Bm25
from sheaf.operators import answers, context, dense, fusion, lexical
from sheaf.plans import fixtures as fx

CHUNKS = [
    ("c1", "Sparse flow", "1. Introduction", "the quick brown fox zz zz zz jumps"),
    ("c2", "Sparse flow", "2. Method", "brown fox brown fox and Café society"),
    ("c3", "Other paper", "Fox brown", "nothing to see, brown. Fox"),
    ("c4", "Other paper", "Results", "lazy dog sleeps over_the fence"),
    ("c5", "Third", "Results", "quick dog"),
    ("c6", "Third", "Results", "unrelated words entirely"),
]
PHRASES = [["brown fox"], ["zz zz"], ["cafe"], ["quick", "dog"], ["fox brown"], ["over the"], ["missing"], ["results"], ["sparse flow", "results", "dog"]]


def frame(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id string, paper_title string, section string, raw_text string")


def test_bm25_equals_a_full_text_index(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, title, section, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?, ?, ?, ?)", CHUNKS)
    queries = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "qid long, texts array<string>")
    got = {}
    for r in lexical.search(lexical.index(frame(spark)), queries, 10).collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"], r["rank"]))
    for i, phrases in enumerate(PHRASES):
        match = " OR ".join(f'"{p}"' for p in phrases)
        want = db.execute("select id, bm25(t, 1.2, 0.8, 1.0) as s from t where t match ? order by s, id", (match,)).fetchall()
        mine = sorted(got.get(i, []), key=lambda x: x[2])
        assert [x[0] for x in mine] == [x[0] for x in want]
        assert [x[1] for x in mine] == pytest.approx([x[1] for x in want], abs=1e-12)


def test_terms_are_those_of_a_full_text_index(spark):
    """Every letter, number and mark of the basic plane between two letters; letters and cases newer than the index's tables are left out."""
    from sheaf.functions import text as X

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body, tokenize='unicode61 remove_diacritics 2')")
    db.execute("create virtual table v using fts5vocab('t', 'instance')")
    codes = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c))[0] in "LNPSZ" or 0x300 <= c <= 0x36F]
    texts = {c: f"Tiếng{chr(c)}Việt re\u0301sume\u0301" for c in codes}
    db.executemany("insert into t(rowid, body) values (?, ?)", texts.items())
    want = {}
    for doc, term in db.execute("select doc, term from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    rows = spark.createDataFrame(list(texts.items()), "c long, body string").select("c", X.tokens(F.col("body")).alias("terms"))
    wrong = [r["c"] for r in rows.collect() if r["terms"] != want[r["c"]]]
    known = [c for c in wrong if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn" and not 0x13A0 <= c <= 0x13FF]
    assert len(known) < 3 and want[0xE9][-1] == "resume" and not any(c < 0x250 and c not in (0x130,) for c in wrong)


def test_phrases_on_a_larger_text(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", "rare"]
    rows = [(f"c{i:03d}", "t", rng.choice(words), " ".join(rng.choices(words, [9, 7, 5, 3, 2, 1], k=40))) for i in range(200)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, title, section, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?, ?, ?, ?)", rows)
    phrases = [["a a b"], ["rare a"], ["a rare a", "b c"], ["d e d"], ["a b c d"], ["rare rare"], ["a missing"]]
    queries = spark.createDataFrame(list(enumerate(phrases)), "qid long, texts array<string>")
    got = {}
    for r in lexical.search(lexical.index(frame(spark, rows)), queries, 1000).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], {})[r["id"]] = r["score"]
    for i, texts in enumerate(phrases):
        match = " OR ".join(f'"{p}"' for p in texts)
        want = dict(db.execute("select id, bm25(t, 1.2, 0.8, 1.0) from t where t match ?", (match,)).fetchall())
        assert got.get(i, {}) == pytest.approx(want, abs=1e-9)


def test_repartitioning_changes_nothing(spark):
    queries = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "qid long, texts array<string>")
    one, many = (sorted(map(tuple, lexical.search(lexical.index(frame(spark).repartition(n)), queries, 3).collect())) for n in (1, 7))
    assert one == many


def test_blank_and_repeated_keywords(spark):
    queries = spark.createDataFrame([(0, ["fox", " fox ", ""]), (1, ["fox"]), (2, []), (3, [" "])], "qid long, texts array<string>")
    rows = lexical.search(lexical.index(frame(spark)), queries, 10, Bm25(title_weight=1.0)).collect()
    by = {q: [(r["id"], r["score"]) for r in rows if r["qid"] == q] for q in range(4)}
    assert by[0] == by[1] and by[0] and not by[2] and not by[3]


def test_scope_keeps_statistics_of_all(spark):
    chunks = frame(spark).withColumn("paper_id", F.col("paper_title"))
    queries = spark.createDataFrame([(0, ["dog"], "Third")], "qid long, texts array<string>, paper_id string")
    scoped = lexical.search_scoped(lexical.index(chunks), queries, 5).collect()
    free = {r["id"]: r["score"] for r in lexical.search(lexical.index(chunks), queries, 5).collect()}
    assert [(r["id"], r["score"]) for r in scoped] == [("c5", free["c5"])] and len(free) == 2


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[10] = vectors[20]
    stored = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(vectors)], "vector_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in (10, 20, 30)], "qid long, embedding array<float>")
    got = {}
    for r in dense.search(stored, queries, 7).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["vector_id"]
    for q in (10, 20, 30):
        scores = vectors.astype(float) @ vectors[q].astype(float)
        assert [got[q][k] for k in range(1, 8)] == (np.lexsort((np.arange(300), -scores))[:7] + 1).tolist()
    assert dense.search(stored.limit(0), queries, 3).count() == 0 and dense.search(stored, queries.limit(0), 3).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BATCH_QUERIES", 7)
    monkeypatch.setattr(dense, "SCORED_ROWS", 16)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (200, 4)).astype(np.float32)  # many ties
    stored = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(vectors)], "vector_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(20)], "qid long, embedding array<float>")
    got = {}
    for r in dense.search(stored, queries, 9).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["vector_id"]
    for q in range(20):
        scores = vectors.astype(float) @ vectors[q].astype(float)
        assert [got[q][k] for k in range(1, 10)] == (np.lexsort((np.arange(200), -scores))[:9] + 1).tolist()


def test_numbering_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    assert sorted((r["k"], r["vector_id"]) for r in dense.number_rows(rows, "k").collect()) == [(i, i + 1) for i in range(1000)]


ROUTES = [("dense_original", "chunk_1", 1, 1.0), ("dense_original", "chunk_2", 2, 1.0), ("dense_rewrite", "chunk_2", 1, 1.0), ("dense_rewrite", "chunk_3", 2, 1.0), ("bm25_original", "chunk_1", 1, 0.7), ("bm25_rewrite", "chunk_2", 1, 1.0)]


@pytest.fixture
def fused(spark):
    hits = spark.createDataFrame([(0, r, c, k, 0.5, w) for r, c, k, w in ROUTES], "qid long, route string, chunk_id string, rank int, raw_score double, weight double")
    return fusion.fuse(hits, 10)


def test_fusion(fused):
    rows = {r["chunk_id"]: r for r in fused.collect()}
    assert {c: r["pre_rank"] for c, r in rows.items()} == {"chunk_2": 1, "chunk_1": 2, "chunk_3": 3}
    assert rows["chunk_2"]["fused_score"] == pytest.approx(1 / 12 + 1 / 11 + 1 / 11) and rows["chunk_1"]["fused_score"] == pytest.approx(1 / 11 + 0.7 / 11)
    assert [s["route"] for s in rows["chunk_1"]["sources"]] == ["dense_original", "bm25_original"]


def test_reranking(spark, fused):
    scores = spark.createDataFrame([(0, "chunk_2", 0.10), (0, "chunk_1", 0.95), (0, "chunk_3", 0.50)], "qid long, chunk_id string, rerank_score double")
    order = lambda df: [r["chunk_id"] for r in df.orderBy("rank").collect()]
    assert order(fusion.rerank(fused, scores, 40)) == ["chunk_1", "chunk_3", "chunk_2"]
    # the tail keeps its place behind the candidates
    assert order(fusion.rerank(fused, scores, 2)) == ["chunk_1", "chunk_2", "chunk_3"]
    assert order(fusion.rerank(fused, None, 40)) == order(fusion.rerank(fused, scores.limit(0), 40)) == ["chunk_2", "chunk_1", "chunk_3"]


def test_quota_and_target(spark, fused):
    chunks = spark.createDataFrame([("chunk_1", "paper_target"), ("chunk_2", "paper_target"), ("chunk_3", "paper_other")], "chunk_id string, paper_id string")
    assert fusion.best_paper(fused, chunks).first()["paper_id"] == "paper_target"
    refs = spark.createDataFrame([(0, "ref_1", 1), (0, "ref_2", 2)], "qid long, chunk_id string, rank int")
    ranked = fusion.rerank(fused, None, 40)
    for search, limit, want in ((True, None, ["chunk_2", "chunk_1", "chunk_3", "ref_1", "ref_2"]), (False, None, ["chunk_2", "chunk_1"]), (True, 3, ["chunk_2", "ref_1", "ref_2"]), (True, 1, ["ref_1"])):
        plans = spark.createDataFrame([(0, search)], "qid long, search_bibliography boolean")
        got = fusion.quota(ranked, refs, plans, 2 if not search else 3, 5, limit).orderBy("final_rank").collect()
        assert [r["chunk_id"] for r in got] == want and [r["final_rank"] for r in got] == list(range(1, len(want) + 1))


def test_ranks_keep_gaps_of_unknown_vectors(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 99, 0.8, 2), (0, 2, 0.7, 3)], "qid long, vector_id long, score double, rank int")
    chunks = spark.createDataFrame([("a", 1, "content"), ("b", 2, "content")], "chunk_id string, vector_id long, section_type string")
    assert sorted((r["chunk_id"], r["rank"]) for r in fusion.dense_route(hits, chunks, "dense_original", 1.0).collect()) == [("a", 1), ("b", 3)]


ROWS = [("c1", 1, "3.2 Method", 10), ("c2", 2, "3.2 Method", 10), ("c3", 3, "3.2 Method", 10), ("c4", 4, "3.2 Method", 10), ("r1", 5, "4. Results", 300), ("n1", 6, None, 10), ("n2", 7, None, 10)]


def expand(spark, seeds, width=1, budget=256):
    chunks = spark.createDataFrame([(c, "paper-a", s, i, f"text {c}", n, 1, 2, "content") for c, i, s, n in ROWS], "chunk_id string, paper_id string, section string, chunk_index long, raw_text string, raw_token_count long, page_start int, page_end int, section_type string")
    frame = spark.createDataFrame([(0, c, float(p)) for c, p in seeds], "qid long, chunk_id string, priority double")
    return [(r["evidence_id"], r["chunk_ids"], r["seeds"], r["tokens"]) for r in context.expand(frame, chunks, width, budget).orderBy("ord").collect()]


def test_expansion(spark):
    assert expand(spark, [("c2", 0.9)]) == [("E1", "c1,c2,c3", "c2", 30)]
    assert expand(spark, [("c2", 0.9), ("c3", 0.8)]) == [("E1", "c1,c2,c3,c4", "c2,c3", 40)]
    # too large a group is skipped and a later one still fits
    assert expand(spark, [("r1", 0.9), ("c2", 0.5)]) == [("E1", "c1,c2,c3", "c2", 30)]
    # windows that only touch stay apart, and so do chunks without a section
    assert [x[1] for x in expand(spark, [("c1", 0.9), ("c2", 0.8)], width=0)] == ["c1", "c2"]
    assert [x[1] for x in expand(spark, [("n1", 0.9), ("n2", 0.8)])] == ["n1", "n2"]
    assert expand(spark, [("r1", 0.9)]) == []


def test_rules_of_routing(spark):
    cases = {"Which works does it cite?": True, "参考文献有哪些": True, "[15] 是哪篇论文？": True, "作者是否引用了 Graph WaveNet": True, "和基线有什么区别": False, "what baseline is used": False, "如何构建图": False, "What is shown?": None}
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string")
    assert [r[0] for r in frame.orderBy("i").select(answers.bibliography_rule(F.col("q"))).collect()] == list(cases.values())


@pytest.mark.parametrize(
    "payload, status, keywords",
    [
        ('{"semantic_query":" x ","lexical_keywords_en":[" A ","a","","B","C"],"search_bibliography":false}', "success", ["A", "B"]),
        ('{"semantic_query":null,"lexical_keywords_en":[],"search_bibliography":true}', "success", []),
        ('{"semantic_query":"x","lexical_keywords_en":[],"search_bibliography":"yes"}', "fallback", []),
        ('{"semantic_query":"x","lexical_keywords_en":[],"search_bibliography":true,"k":1}', "fallback", []),
        ('{"semantic_query":"x","lexical_keywords_en":[1],"search_bibliography":true}', "fallback", []),
        ("not json", "fallback", []),
        (None, "fallback", []),
    ],
)
def test_rewrite_payloads(spark, payload, status, keywords):
    row = answers.rewrite_plan(spark.createDataFrame([(0, " how  so ", payload)], "qid long, query string, payload string"), 2).first()
    assert (row["status"], row["keywords"], row["original_query"]) == (status, keywords, "how so")


@pytest.mark.parametrize(
    "answer, cites, lacking, problem",
    [(" As [E1]. ", [" E1 ", "E1"], False, None), ("x", ["E9"], False, "unknown citation"), ("[E2]", ["E1"], False, "label not cited"), ("[E9]", ["E1"], False, "unknown label"), ("x", [], False, "no citation"), ("x", [], True, None), (" ", ["E1"], False, "blank answer")],
)
def test_answer_checks(spark, answer, cites, lacking, problem):
    frame = spark.createDataFrame([(answer, cites, lacking)], "a string, c array<string>, i boolean")
    assert frame.select(answers.answer_problem(F.col("a"), F.col("c"), F.col("i"), F.array(F.lit("E1"), F.lit("E2")))).first()[0] == problem


def test_states(spark):
    queries = spark.createDataFrame([(0, "what does this paper do", 0), (1, "what does this paper do", 1), (2, "x", 0), (3, "this paper", 0)], "qid long, query string, n_context int")
    evidence = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (3, "a"), (3, "a")], "qid long, paper_id string")
    state = lambda **o: [r["status"] for r in answers.status(queries, evidence, **o).orderBy("qid").collect()]
    assert state() == ["ambiguous_paper", "ready", "insufficient_evidence", "ready"] and set(state(enabled=False)) == {"disabled"}


def test_fixture_chunks_are_whole(spark, sf):
    chunks = fx.chunks(spark, sf)
    assert chunks.where(F.col("raw_token_count") > fx.BUDGET).count() == 0
    words = chunks.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("raw_text", r"\s+", " ")), " ")))).first()[0]
    texts = fx.papers(spark, sf).select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0]
    assert words == texts


def test_digest_trees_name_what_differs(spark, monkeypatch):
    monkeypatch.setattr(dense, "GROUP", 10)
    rng = np.random.default_rng(4)
    one = {f"k{i}": int(v) for i, v in enumerate(rng.integers(0, 50, 400))}
    other = {k: v for k, v in one.items() if k not in ("k7", "k300")} | {"k5": 99, "k399": -1, "new": 3, "k0": None}
    frames = [spark.createDataFrame(sorted(d.items()), "k string, v long") for d in (one, other)]
    value = F.coalesce(F.col("v").cast("string"), F.lit("none"))
    want = {**{k: "changed" for k in ("k5", "k399", "k0")}, **{k: "removed" for k in ("k7", "k300")}, "new": "added"}
    for depth in (1, 2, 3):
        trees = tuple(dense.digest_tree(f.repartition(n), "k", value, depth) for f, n in zip(frames, (3, 5), strict=True))
        assert {r["k"]: r["change"] for r in dense.differences(*frames, "k", value, trees, depth).collect()} == want
        # the roots are one row each, and only branches that differ are gone down
        assert all(t.where("level = 0").count() == 1 for t in trees) and dense.tree_differences(*trees, depth).count() <= len(want)
        assert trees[0].groupBy("level").count().where(f"level < {depth} and count > {10**depth}").count() == 0
    assert dense.differences(frames[0], frames[0], "k", value).count() == 0
    none = frames[0].limit(0)
    assert dense.differences(none, none, "k", value).count() == 0 and dense.differences(none, frames[0], "k", value).where("change = 'added'").count() == 400


def test_fingerprints_of_many_levels(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(dense, "GROUP", 4)
    rows = [(i, f"text {i * i}") for i in range(150)]
    digests = [hashlib.sha256(t.encode()).hexdigest() for _, t in rows]
    while len(digests) > 1:
        digests = [hashlib.sha256("".join(digests[i : i + 4]).encode()).hexdigest() for i in range(0, len(digests), 4)]
    frame = spark.createDataFrame(rows, "i int, t string").repartition(6)
    assert dense.fingerprint(frame, F.col("t"), "i").first()["fingerprint"] == digests[0]
    assert dense.fingerprint(frame.limit(0), F.col("t"), "i").count() == 1


def test_fingerprint_of_two_levels_has_no_third(spark, monkeypatch):
    """As the queries' SQL has it: the second level takes all that is left, also with more than GROUP of them."""
    import hashlib

    monkeypatch.setattr(dense, "GROUP", 4)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(i, f"text {i * i}") for i in range(150)]
    lines = [digest(t) for _, t in rows]
    want = digest("".join(digest("".join(lines[i : i + 4])) for i in range(0, len(lines), 4)))
    frame = spark.createDataFrame(rows, "i int, t string").repartition(6)
    assert dense.fingerprint(frame, F.col("t"), "i", levels=2).first()["fingerprint"] == want
    assert dense.fingerprint(frame.limit(0), F.col("t"), "i", levels=2).first()["fingerprint"] == digest("")


def test_index_and_search_do_not_shuffle_the_index(spark, tmp_path):
    """Postings stay with their chunks, and phrases go to the chunks: no exchange below the join."""
    from sheaf.operators import chunking

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan(lexical.postings(lexical.analysed(frame(spark))))
    stored = lexical.index(frame(spark))
    questions = spark.createDataFrame([(1, ["sparse flow"]), (2, ["flow"])], "qid int, texts array<string>")
    anchored = lexical.written(lexical.anchors(stored, lexical.phrases(questions)))
    met = plan(lexical.occurrences(stored, anchored, anchored.count()))
    assert "BroadcastHashJoin" in met and "hashpartitioning" not in met


def test_words_of_a_long_item(spark):
    """Windows of a long item are those of plain Python; a check of results, which were the same before."""
    from sheaf.operators import chunking

    words = [f"w{i}" for i in range(1000)]
    item = spark.createDataFrame([([("S", " ".join(words), 1000, 1)],)], "items array<struct<section:string,text:string,tokens:int,page:int>>")
    parts = item.select(chunking.split_oversize(F.col("items"), 96).alias("p")).first()["p"]
    assert [p["text"] for p in parts] == [" ".join(words[i : i + 96]) for i in range(0, 1000, 96)]


def test_terms_in_order_stay_in_the_row(spark, sf):
    """No term is shuffled to put a chunk's terms in order."""
    from sheaf.plans import retrieval

    shown = retrieval.QUERIES["tokenize"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in shown and "Repartition" not in shown


def test_equal_sums_are_ranked_by_id(spark):
    # the same terms in another order: the second sum is larger by its last bit
    rows = [(1, r, c, k, w) for c, x, y in (("a", 1, 5), ("b", 5, 1)) for r, k, w in (("dense_original", 1, 0.8), ("dense_rewrite", x, 1.2), ("bm25_rewrite", y, 1.2))]
    hits = spark.createDataFrame(rows, "qid int, route string, chunk_id string, rank int, weight double").withColumn("raw_score", F.lit(1.0))
    fused = fusion.fuse(hits, 60)
    scores = {r["chunk_id"]: r["fused_score"] for r in fused.collect()}
    assert scores["a"] < scores["b"]
    assert [r["chunk_id"] for r in fused.orderBy("pre_rank").collect()] == ["a", "b"]
    scored = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "qid int, chunk_id string, rerank_score double")
    assert [r["chunk_id"] for r in fusion.rerank(fused, scored, 10).orderBy("rank").collect()] == ["a", "b"]
