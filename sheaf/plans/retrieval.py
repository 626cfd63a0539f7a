"""Queries: papers, chunks, lexical and dense search, fusion, reranking and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf import adaptors, catalog
from sheaf.config import Chunking, Settings
from sheaf.functions import text as X
from sheaf.functions import vector as V
from sheaf.operators import answers, chunking, dense, fusion, lexical, store
from sheaf.plans import fixtures as fx
from sheaf.plans.fixtures import QUERIES_SQL, TERMS_SQL, bm25_sql, with_chunks
from sheaf.sources import readers

S = Settings()
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query("papers_dedup_by_hash", "SELECT 'paper_' || substr(sha256(text), 1, 16) AS paper_id, max(doc_id) AS doc_id, count(*) AS n_copies, sha256(text) AS source_sha256 FROM documents GROUP BY text")
def papers_dedup(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.groupBy(chunking.paper_id(F.col("text")).alias("paper_id"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("chunk_build", with_chunks() + "SELECT chunk_id, paper_id, chunk_index, section, section_type, CAST(raw_token_count AS BIGINT) AS raw_token_count, page_start, page_end, sha256(raw_text) AS text_sha256 FROM chunks")
def chunk_build(spark, d):
    return fx.built(fx.papers(spark, d)).select("chunk_id", "paper_id", "chunk_index", "section", "section_type", "raw_token_count", "page_start", "page_end", F.sha2(F.col("raw_text").cast("binary"), 256).alias("text_sha256"))


@query("chunk_links", with_chunks() + "SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_index)")
def chunk_links(spark, d):
    return fx.chunks(spark, d).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query("chunk_links_derived", ORACLE["chunk_links"])
def chunk_links_derived(spark, d):
    return chunking.links(fx.chunks(spark, d))


@query("chunk_diagnostics", with_chunks() + "SELECT paper_id, count(*) AS n_chunks, max(raw_token_count) AS max_tokens, count(*) FILTER (raw_token_count > 96) AS over_limit, count(*) FILTER (page_end > page_start) AS cross_page FROM chunks GROUP BY paper_id")
def chunk_diagnostics(spark, d):
    return chunking.diagnostics(fx.chunks(spark, d), fx.BUDGET)


@query("chunk_integrity_violations", with_chunks() + "SELECT 'page range' AS rule, count(*) AS n FROM chunks WHERE page_end > 3 HAVING count(*) > 0 UNION ALL SELECT 'indexes', count(*) FROM (SELECT paper_id FROM chunks WHERE chunk_index <> 1 GROUP BY paper_id HAVING max(chunk_index) > 1) HAVING count(*) > 0 UNION ALL SELECT 'neighbour', CAST(sum(CASE WHEN chunk_index IN (0, 2) THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT chunk_index, max(chunk_index) OVER (PARTITION BY paper_id) AS m FROM chunks) WHERE m >= 1 HAVING count(*) > 0")
def chunk_violations(spark, d):
    # every chunk 1 is taken out and pages are checked against a cap of 3, so rules are broken
    broken = fx.chunks(spark, d).where("chunk_index != 1").withColumn("page_end", F.when(F.col("page_end") > 3, F.lit(0)).otherwise(F.col("page_end")))
    return chunking.violations(broken)


@query("chunk_tokens_bpe")
def chunk_tokens_bpe(spark, d):
    """Chunks of all documents under the budget of a public tokenizer; tests hold them against plain Python."""
    import public_tokenizers

    sources = fx.papers(spark, d).select("paper_id", "paper_title", "source", fx.items_of(F.col("text")).alias("items"))
    chunks = chunking.TokenChunker(Chunking(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))).chunk(sources)
    return chunks.select("chunk_id", "section", "raw_token_count", "embedding_token_count", F.sha2(F.col("raw_text").cast("binary"), 256).alias("sha"))


@query("embedding_text", with_chunks() + "SELECT chunk_id, embedding_text, sha256(embedding_text) AS sha, CAST(len(string_split(trim(regexp_replace(embedding_text, '\\s+', ' ', 'g')), ' ')) AS BIGINT) AS embedding_token_count FROM chunks WHERE section_type = 'content'")
def embedding_text(spark, d):
    chunks = fx.chunks(spark, d).withColumn("vector_id", F.lit(None).cast("long"))
    inputs = store.embedding_inputs(chunks)
    return inputs.select("chunk_id", "embedding_text", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("sha"), X.word_count(F.col("embedding_text")).cast("long").alias("embedding_token_count"))


@query("section_histogram", with_chunks() + "SELECT section AS value, count(*) AS n FROM chunks GROUP BY section")
def section_histogram(spark, d):
    return store.histogram(fx.chunks(spark, d), "section")


@query("row_counts", with_chunks() + "SELECT 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'documents', count(*) FROM papers")
def row_counts(spark, d):
    return store.row_counts(documents=fx.papers(spark, d), chunks=fx.chunks(spark, d))


@query("import_summary", with_chunks() + "SELECT paper_id, count(*) AS n_chunks, count(*) FILTER (section = 'Abstract') AS n_front_matter, count(*) FILTER (section_type = 'bibliography') AS n_bibliography FROM chunks GROUP BY paper_id")
def import_summary(spark, d):
    return store.import_summary(fx.chunks(spark, d))


@query("section_lookup", with_chunks() + "SELECT c.chunk_id, c.paper_id, c.section, c.chunk_index, 'doc-' || p.doc_id AS source_filename FROM chunks c JOIN papers p USING (paper_id) WHERE section_type = 'content' AND section = '1. Introduction'")
def section_lookup(spark, d):
    documents = fx.papers(spark, d).select("paper_id", F.concat(F.lit("doc-"), "doc_id").alias("source_filename"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), "doc_id")
    wanted = documents.select("paper_id", F.lit("1. Introduction").alias("section"))
    return store.in_section(fx.chunks(spark, d), documents, wanted).select("chunk_id", "paper_id", "section", "chunk_index", "source_filename")


@query("front_matter_chunks", with_chunks() + "SELECT chunk_id, chunk_index, 'abstract' AS front_matter_type FROM chunks WHERE section = 'Abstract'")
def front_matter_chunks(spark, d):
    return store.front_matter(fx.chunks(spark, d)).select("chunk_id", "chunk_index", "front_matter_type")


def _newest(spark, d):
    return fx.papers(spark, d).select("paper_id", "doc_id").orderBy(F.desc("doc_id")).first()["paper_id"]


@query("paper_lookup", with_chunks() + "SELECT paper_id, doc_id, paper_title FROM papers ORDER BY doc_id DESC LIMIT 1")
def paper_lookup(spark, d):
    """One paper by its id: that of the newest document."""
    return store.document(fx.store(spark, d).table("documents"), _newest(spark, d)).select("paper_id", "doc_id", "paper_title")


@query("paper_chunks", with_chunks() + "SELECT chunk_id, chunk_index, section FROM chunks WHERE paper_id = (SELECT paper_id FROM papers ORDER BY doc_id DESC LIMIT 1)")
def paper_chunks(spark, d):
    """The chunks of one paper, in order."""
    return store.chunks_of(fx.chunks(spark, d), _newest(spark, d)).select("chunk_id", "chunk_index", "section")


@query("tokenize", with_chunks(TERMS_SQL) + "SELECT id, col, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(term, ' ' ORDER BY pos)) AS sha FROM terms GROUP BY id, col")
def tokenize(spark, d):
    rows = lexical.listed(fx.chunks(spark, d))
    return rows.select("id", "col", F.size("terms").cast("long").alias("n"), F.sha2(F.array_join("terms", " ").cast("binary"), 256).alias("sha"))


@query("corpus_stats", with_chunks(TERMS_SQL) + "SELECT section_type, count(*) AS n_chunks, round(avg(len), 6) AS avgdl, CAST(sum(len) AS BIGINT) AS n_terms FROM lens GROUP BY section_type")
def corpus_stats(spark, d):
    sizes = fx.store(spark, d).index().lengths
    return sizes.groupBy("section_type").agg(F.count("*").alias("n_chunks"), F.round(F.avg("len"), 6).alias("avgdl"), F.sum("len").cast("long").alias("n_terms"))


def _index(spark, d, section_type="content"):
    """The stored index of a section type; no text is read."""
    return fx.store(spark, d).index().of(section_type)


@query("posting_counts", with_chunks(TERMS_SQL) + "SELECT section_type, term, count(DISTINCT id) AS df, CAST(count(*) AS BIGINT) AS n FROM terms GROUP BY ALL")
def posting_counts(spark, d):
    held = fx.store(spark, d).index()
    counts = held.postings.groupBy("section_type", "term").agg(F.sum(F.size("positions")).alias("n"))
    return held.terms.join(counts, ["section_type", "term"]).select("section_type", "term", "df", "n")


def _hits(rows):
    return rows.select("qid", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


NUMBERED_SQL = "numbered AS (SELECT row_number() OVER (ORDER BY paper_id, chunk_index) AS vector_id, * FROM chunks WHERE section_type = 'content')"
HITS_SQL = "SELECT qid, id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM b"
PHRASE = "SELECT qid, 0 AS pid, ts FROM qs WHERE len(ts) > 0"
GROUP = "SELECT qid, n AS pid, [word] AS ts FROM kws"


WINDOWS = """SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY n) AS pid, string_split(phrase, ' ') AS ts FROM (
  SELECT qid, array_to_string(list_slice(ts, n, n + 3), ' ') AS phrase, min(n) AS n FROM (SELECT qid, ts, unnest(range(1, greatest(len(ts) - 2, 2))) AS n FROM qs WHERE len(ts) > 0) GROUP BY ALL)"""


@query("bm25_phrase", with_chunks(TERMS_SQL, QUERIES_SQL, bm25_sql("b", "content", WINDOWS, 10)) + HITS_SQL)
def bm25_phrase(spark, d):
    """Every run of four words of each question, as one query of alternatives."""
    words = X.tokens(F.col("query"))
    runs = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 3), lambda i: F.array_join(F.slice(words, i, 4), " "))).otherwise(F.array(F.array_join(words, " ")))
    questions = fx.query_texts(spark, d).select("qid", runs.alias("texts"))
    return _hits(lexical.search(_index(spark, d), questions, S.retrieval.bm25_original_top_k))


@query("bm25_full_question", with_chunks(TERMS_SQL, QUERIES_SQL, bm25_sql("b", "content", PHRASE, 10)) + HITS_SQL)
def bm25_full_question(spark, d):
    questions = fx.query_texts(spark, d).select("qid", F.array("query").alias("texts"))
    return _hits(lexical.search(_index(spark, d), questions, S.retrieval.bm25_original_top_k))


@query("bm25_keyword_group", with_chunks(TERMS_SQL, QUERIES_SQL, bm25_sql("b", "content", GROUP, 20)) + HITS_SQL)
def bm25_keyword_group(spark, d):
    questions = fx.query_texts(spark, d).select("qid", F.col("keywords").alias("texts"))
    return _hits(lexical.search(_index(spark, d), questions, S.retrieval.bm25_rewrite_top_k))


# the paper in whose reference list a question's words occur most
SCOPE_SQL = "scope AS (SELECT qid, paper_id FROM (SELECT k.qid, t.paper_id, count(*) AS n FROM kws k JOIN terms t ON t.term = k.word GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, paper_id) = 1)"


def _scopes(spark, d):
    from pyspark.sql import Window

    words = fx.query_texts(spark, d).select("qid", F.explode("keywords").alias("term"))
    counts = fx.store(spark, d).index().postings.join(words, "term").groupBy("qid", "paper_id").agg(F.sum(F.size("positions")).alias("n"))
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "paper_id")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("qid", "paper_id")


@query("bibliography_phrase_scoped", with_chunks(TERMS_SQL, QUERIES_SQL, SCOPE_SQL, bm25_sql("b", "bibliography", "SELECT qid, 0 AS pid, [word] AS ts FROM kws WHERE n = 1", 5, "scope")) + HITS_SQL)
def bibliography_phrase_scoped(spark, d):
    questions = fx.query_texts(spark, d).select("qid", F.slice("keywords", 1, 1).alias("texts")).join(_scopes(spark, d), "qid")
    return _hits(lexical.search_scoped(_index(spark, d, "bibliography"), questions, S.retrieval.rewrite.bibliography_top_k))


# words common enough to occur in reference lists
COMMON_SQL = "common AS (SELECT qid, word, row_number() OVER (PARTITION BY qid ORDER BY length(word), word) AS n FROM (SELECT DISTINCT qid, unnest(ts) AS word FROM qs) QUALIFY n <= 3)"


@query("bibliography_keywords_scoped", with_chunks(TERMS_SQL, QUERIES_SQL, SCOPE_SQL, COMMON_SQL, bm25_sql("b", "bibliography", "SELECT qid, n AS pid, [word] AS ts FROM common", 5, "scope")) + HITS_SQL)
def bibliography_keywords_scoped(spark, d):
    return _hits(lexical.search_scoped(_index(spark, d, "bibliography"), _common(spark, d).join(_scopes(spark, d), "qid"), S.retrieval.rewrite.bibliography_top_k))


def _common(spark, d):
    short = F.array_sort(F.transform(F.array_distinct(X.tokens(F.col("query"))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return fx.query_texts(spark, d).select("qid", F.transform(F.slice(short, 1, 3), lambda x: x["w"]).alias("texts"))


@query("vector_validate", "SELECT vec_id + 1 AS vector_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-7 THEN 'not unit' END AS problem FROM embeddings WHERE problem IS NOT NULL")
def vector_validate(spark, d):
    rows = fx.vectors(spark, d)
    return rows.select("vector_id", V.problem(F.col("embedding"), 64, 1e-7).alias("problem")).where("problem is not null")


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3 / (3 * sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))))), 6) AS total FROM embeddings")
def vector_normalize(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", V.normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))




@query("vector_assign_ids", with_chunks(NUMBERED_SQL) + "SELECT vector_id, chunk_id, sha256(embedding_text) AS text_sha256 FROM numbered")
def vector_assign_ids(spark, d):
    return fx.numbered(spark, d).select("vector_id", "chunk_id", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("text_sha256"))


@query("vector_state", with_chunks(NUMBERED_SQL) + "SELECT count(*) AS n_content, count(*) FILTER (vector_id <= (SELECT count(*) FROM embeddings)) AS n_assigned, min(vector_id) AS min_id, least(max(vector_id), (SELECT count(*) FROM embeddings)) AS max_id FROM numbered")
def vector_state(spark, d):
    n = fx.table(spark, d, "embeddings").count()
    chunks = fx.numbered(spark, d).withColumn("vector_id", F.when(F.col("vector_id") <= n, F.col("vector_id")))
    return dense.state(chunks)


@query("artifact_roundtrip", "SELECT vec_id + 1 AS vector_id, 'v' || vec_id AS chunk_id, sha256('text ' || vec_id) AS text_sha256, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def artifact_roundtrip(spark, d):
    """Vectors written with records and a manifest, read back and checked against both."""
    number = F.col("vec_id").cast("string")
    rows = fx.table(spark, d, "embeddings").select(F.concat(F.lit("v"), number).alias("chunk_id"), F.lit("p").alias("paper_id"), F.col("vec_id").alias("chunk_index"), F.concat(F.lit("text "), number).alias("embedding_text"), "embedding")
    stored = readers.read_artifact(spark, readers.write_artifact(rows, catalog.shared_folder(spark), 64))
    return stored.select("vector_id", "chunk_id", "text_sha256", F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x), 5).alias("total"))


@query("index_published", with_chunks(NUMBERED_SQL) + "SELECT vector_id, chunk_id, sha256(embedding_text) AS text_sha256 FROM numbered")
def index_published(spark, d):
    """A store whose index was cut short after the swap, recovered, verified and rebuilt; a problem ends the query."""
    held = catalog.Catalog(spark, catalog.shared_folder(spark))
    sources, chunks = fx.papers(spark, d).drop("text"), fx.chunks(spark, d)
    held.import_papers(sources, chunks.withColumn("vector_id", F.lit(None).cast("long")), chunkless=True)
    content = held.table("chunks").where("section_type = 'content'").select("chunk_id", "paper_id", "chunk_index", "embedding_text")
    embedded = adaptors.embed(content, adaptors.HashEmbedder)
    held.publish_index(embedded, 64, stop="swap")
    if held.recover() != "published" or held.verify_index().limit(1).count():
        raise catalog.CatalogError("the index does not fit")
    held.rebuild_index(embedded, 64)
    if held.verify_index().limit(1).count():
        raise catalog.CatalogError("the rebuilt index does not fit")
    return held.table("vectors").select("vector_id", "chunk_id", "text_sha256")


@query("score_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda x: x::DOUBLE)))), 9) AS score FROM embeddings")
def score_sigmoid(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x)
    return fx.table(spark, d, "embeddings").select("vec_id", F.round(V.sigmoid(total), 9).alias("score"))


@query("rewrite_offline", "WITH" + QUERIES_SQL.rstrip() + " SELECT q.qid, trim(regexp_replace(q.query, '\\s+', ' ', 'g')) AS original_query, trim(q.query) AS semantic_query, coalesce(k.words, '') AS keywords, 'success' AS status FROM qs q LEFT JOIN (SELECT qid, string_agg(word, ',' ORDER BY n) AS words FROM kws GROUP BY qid) k ON k.qid = q.qid")
def rewrite_offline(spark, d):
    """Plans without a model: the question and its longest words."""
    plans = answers.rewrite_plan(adaptors.rewrite_offline(fx.query_texts(spark, d), fx.KEYWORDS), fx.KEYWORDS)
    return plans.select("qid", "original_query", "semantic_query", F.array_join("keywords", ",").alias("keywords"), "status")


@query("dense_topk", "SELECT q.vec_id AS qid, v.vec_id + 1 AS vector_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20")
def dense_topk(spark, d):
    queries = fx.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.search(fx.vectors(spark, d), queries, S.retrieval.dense_top_k).select("qid", "vector_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_lookup", with_chunks(NUMBERED_SQL) + "SELECT vector_id, chunk_id FROM numbered WHERE vector_id IN (SELECT vec_id + 1 FROM embeddings WHERE label = 1)")
def vector_lookup(spark, d):
    ids = fx.table(spark, d, "embeddings").where("label = 1").select((F.col("vec_id") + 1).alias("vector_id"))
    return store.by_vector_ids(fx.numbered(spark, d), ids.union(ids)).select("vector_id", "chunk_id")


def _fingerprint_sql(line: str) -> str:
    return with_chunks(NUMBERED_SQL) + f", l AS (SELECT vector_id - 1 AS n0, sha256({line}) AS x FROM numbered), b AS (SELECT n0 // 1000 AS block, sha256(string_agg(x, '' ORDER BY n0)) AS x FROM l GROUP BY 1) SELECT sha256(string_agg(x, '' ORDER BY block)) AS fingerprint FROM b"


@query("input_fingerprint", _fingerprint_sql("chunk_id || '|' || sha256(embedding_text)"))
def input_fingerprint(spark, d):
    line = F.concat("chunk_id", F.lit("|"), F.sha2(F.col("embedding_text").cast("binary"), 256))
    return dense.fingerprint(fx.chunks(spark, d).where("section_type = 'content'").select("paper_id", "chunk_index", "chunk_id", "embedding_text"), line, "paper_id", "chunk_index", levels=2)


@query("assignment_fingerprint", _fingerprint_sql("vector_id || '|' || chunk_id"))
def assignment_fingerprint(spark, d):
    return dense.fingerprint(fx.numbered(spark, d).select("vector_id", "chunk_id"), F.concat_ws("|", "vector_id", "chunk_id"), "vector_id", levels=2)


_CHANGES_SQL = "CASE WHEN chunk_index = 1 THEN 'removed' WHEN chunk_index = 2 THEN 'changed' END"


@query("index_diff", with_chunks() + f"SELECT chunk_id, {_CHANGES_SQL} AS change FROM chunks WHERE paper_id LIKE 'paper_0%' AND chunk_index IN (1, 2) UNION ALL SELECT chunk_id || '*', 'added' FROM chunks WHERE paper_id LIKE 'paper_1%' AND chunk_index = 0")
def index_diff(spark, d):
    """Two stores' chunks compared by digest trees: what was changed, taken away or added to the second."""
    chunks = fx.chunks(spark, d).select("chunk_id", "paper_id", "chunk_index", "embedding_text")
    touched = F.col("paper_id").startswith("paper_0")
    other = chunks.where(~touched | (F.col("chunk_index") != 1)).withColumn("embedding_text", F.when(touched & (F.col("chunk_index") == 2), F.lit("other")).otherwise(F.col("embedding_text")))
    more = chunks.where(F.col("paper_id").startswith("paper_1") & (F.col("chunk_index") == 0)).withColumn("chunk_id", F.concat("chunk_id", F.lit("*")))
    return dense.differences(chunks, other.unionByName(more), "chunk_id", F.sha2(F.col("embedding_text").cast("binary"), 256))


@query("dense_tiled", "SELECT q.vec_id AS qid, v.vec_id + 1 AS vector_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS BIGINT) AS rank FROM embeddings q, embeddings v QUALIFY rank <= 5")
def dense_tiled(spark, d):
    """The five nearest vectors of every vector, in tiles of 128 queries by 200 vectors or, of a larger table, a quarter by a third up to a tile's size."""
    queries = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    n = queries.count()
    found = dense.search(fx.vectors(spark, d), queries, 5, batch=min(max(128, -(-n // 4)), dense.TILE_QUERIES), tile=min(max(200, -(-n // 3)), dense.TILE_VECTORS))
    return found.select("qid", "vector_id", F.col("rank").cast("long").alias("rank"))


@query("artifact_staleness", with_chunks() + "SELECT chunk_id, CASE WHEN section_type = 'bibliography' THEN 'unknown chunk' WHEN chunk_index = 1 THEN 'no vector' ELSE 'text changed' END AS problem FROM chunks WHERE section_type = 'bibliography' OR chunk_index IN (1, 2)")
def artifact_staleness(spark, d):
    chunks = fx.chunks(spark, d)
    sha = F.sha2(F.when(F.col("chunk_index") == 2, F.lit("other")).otherwise(F.col("embedding_text")).cast("binary"), 256)
    artifact = chunks.where("section_type = 'bibliography' or chunk_index != 1").select("chunk_id", sha.alias("text_sha256"))
    return dense.staleness(chunks, artifact)


@query("mapping_equality", with_chunks(NUMBERED_SQL) + "SELECT vector_id, chunk_id AS actual, CASE WHEN vector_id % 10 <> 0 THEN chunk_id || '*' END AS expected FROM numbered WHERE vector_id % 5 = 0")
def mapping_equality(spark, d):
    actual = fx.numbered(spark, d).select("vector_id", "chunk_id")
    changed = F.when(F.col("vector_id") % 5 == 0, F.concat("chunk_id", F.lit("*"))).otherwise(F.col("chunk_id"))
    return dense.mapping_differences(actual, actual.where("vector_id % 10 != 0").withColumn("chunk_id", changed))


def _routes(spark, d):
    r, chunks = S.retrieval, fx.numbered(spark, d)
    vectors, texts = fx.vectors(spark, d), fx.query_texts(spark, d)
    content, index = chunks.select("chunk_id", "section_type", "vector_id"), _index(spark, d)
    questions = texts.select("qid", F.array("query").alias("texts"))
    lexical_hits = lambda q, k: lexical.search(index, q, k).withColumnRenamed("id", "chunk_id")
    return fusion.pool(
        fusion.dense_route(dense.search(vectors, fx.query_vectors(spark, d), r.dense_top_k), content, "dense_original", r.dense_original_weight),
        fusion.dense_route(dense.search(vectors, fx.query_vectors(spark, d, 40), r.dense_top_k), content, "dense_rewrite", r.dense_rewrite_weight),
        fusion.route(lexical_hits(questions, r.bm25_original_top_k), "bm25_original", r.bm25_original_weight),
        fusion.route(lexical_hits(texts.select("qid", F.col("keywords").alias("texts")), r.bm25_rewrite_top_k), "bm25_rewrite", r.bm25_rewrite_weight),
    ), chunks


def _fused(spark, d):
    """Fused hits, stored, and the numbered chunks."""
    hits, chunks = _routes(spark, d)
    return catalog.written(fusion.fuse(hits, S.retrieval.rrf_k)), chunks


def _dense_sql(name: str, shift: int) -> str:
    return f"{name} AS (SELECT b.item_id AS qid, v.vec_id + 1 AS vector_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id + {shift}, embeddings v QUALIFY rank <= 20)"


FUSED_SQL = with_chunks(
    TERMS_SQL, QUERIES_SQL, NUMBERED_SQL, _dense_sql("d1", 0), _dense_sql("d2", 40),
    bm25_sql("b1", "content", "SELECT qid, 0 AS pid, ts FROM qs WHERE len(ts) > 0", 10), bm25_sql("b2", "content", GROUP, 20),
    """hits AS (
  SELECT qid, 0 AS place, 'dense_original' AS route, chunk_id, rank, 0.8 AS w, score FROM d1 JOIN numbered USING (vector_id)
  UNION ALL SELECT qid, 1, 'dense_rewrite', chunk_id, rank, 1.2, score FROM d2 JOIN numbered USING (vector_id)
  UNION ALL SELECT qid, 2, 'bm25_original', id, rank, 0.6, score FROM b1
  UNION ALL SELECT qid, 3, 'bm25_rewrite', id, rank, 1.2, score FROM b2),
fused AS (
  SELECT qid, chunk_id, sum(w / (60 + rank)) AS fused_score, string_agg(route || ':' || rank, ',' ORDER BY place) AS sources,
         row_number() OVER (PARTITION BY qid ORDER BY round(sum(w / (60 + rank)), 12) DESC, chunk_id) AS pre_rank
  FROM hits GROUP BY qid, chunk_id)
""",
)
MASS_SQL = "mass AS (SELECT qid, paper_id, sum(fused_score) AS mass FROM fused JOIN chunks USING (chunk_id) GROUP BY ALL), best AS (SELECT qid, paper_id, mass FROM mass QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(mass, 12) DESC, paper_id) = 1)"
RERANK_SQL = """
reranked AS (
  SELECT f.qid, f.chunk_id, f.fused_score, f.pre_rank,
         CASE WHEN f.pre_rank <= 40 THEN len(list_intersect(list_distinct(q.ts), regexp_extract_all(lower(strip_accents('Title: ' || c.paper_title || chr(10) || 'Section: ' || c.section || chr(10) || c.raw_text)), '[\\p{L}\\p{N}\\p{Co}]+')))::DOUBLE / greatest(len(list_distinct(q.ts)), 1) END AS rerank_score
  FROM fused f JOIN qs q USING (qid) JOIN chunks c USING (chunk_id)),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN pre_rank <= 40 THEN 0 ELSE 1 END, rerank_score DESC NULLS LAST, round(fused_score, 12) DESC, chunk_id) AS rank FROM reranked)
"""


@query("rrf_fusion", FUSED_SQL + "SELECT qid, chunk_id, round(fused_score, 9) AS fused_score, CAST(pre_rank AS BIGINT) AS pre_rank FROM fused")
def rrf_fusion(spark, d):
    hits, _ = _routes(spark, d)
    return fusion.fuse(hits, S.retrieval.rrf_k).select("qid", "chunk_id", F.round("fused_score", 9).alias("fused_score"), F.col("pre_rank").cast("long").alias("pre_rank"))


@query("rrf_sources", FUSED_SQL + "SELECT qid, chunk_id, sources FROM fused")
def rrf_sources(spark, d):
    hits, _ = _routes(spark, d)
    shown = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["route"], s["rank"])), ",")
    return fusion.fuse(hits, S.retrieval.rrf_k).select("qid", "chunk_id", shown.alias("sources"))


@query("best_paper_by_evidence", FUSED_SQL + "," + MASS_SQL + "SELECT qid, paper_id, round(mass, 9) AS mass FROM best")
def best_paper(spark, d):
    fused, chunks = _fused(spark, d)
    return fusion.best_paper(fused, chunks).select("qid", "paper_id", F.round("mass", 9).alias("mass"))


def _reranked(spark, d):
    fused, chunks = _fused(spark, d)
    scores = fusion.overlap_scores(fused, fx.query_texts(spark, d), chunks, S.reranking.candidate_top_k)
    return fusion.rerank(fused, scores, S.reranking.candidate_top_k), fused, chunks


@query("rerank_order", FUSED_SQL + "," + RERANK_SQL + "SELECT qid, chunk_id, round(rerank_score, 9) AS rerank_score, CAST(rank AS BIGINT) AS rank FROM final")
def rerank_order(spark, d):
    ranked, _, _ = _reranked(spark, d)
    return ranked.select("qid", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query("rerank_fallback", FUSED_SQL + "SELECT qid, chunk_id, CAST(pre_rank AS BIGINT) AS rank FROM fused")
def rerank_fallback(spark, d):
    hits, _ = _routes(spark, d)
    return fusion.rerank(fusion.fuse(hits, S.retrieval.rrf_k), None, S.reranking.candidate_top_k).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("rerank_passage", with_chunks() + "SELECT chunk_id, sha256('Title: ' || paper_title || chr(10) || 'Section: ' || section || chr(10) || raw_text) AS sha FROM chunks")
def rerank_passage(spark, d):
    return fx.chunks(spark, d).select("chunk_id", F.sha2(X.passage(F.col("paper_title"), F.col("section"), F.col("raw_text")).cast("binary"), 256).alias("sha"))


QUOTA_SQL = FUSED_SQL + "," + MASS_SQL + "," + RERANK_SQL + "," + COMMON_SQL + "," + bm25_sql("rb", "bibliography", "SELECT qid, n AS pid, [word] AS ts FROM common", 5, "best") + """,
plans AS (SELECT qid, qid % 2 = 0 AS sb FROM qs),
bib AS (SELECT rb.* FROM rb JOIN plans USING (qid) WHERE sb),
lim AS (SELECT p.qid, 5 + CASE WHEN sb THEN 5 ELSE 0 END AS l, least(coalesce(n, 0), 5) AS nb FROM plans p LEFT JOIN (SELECT qid, count(*) AS n FROM bib GROUP BY qid) USING (qid)),
quota AS (
  SELECT qid, chunk_id, section_type, fused_score, pre_rank, rerank_score, score, r AS route_rank, row_number() OVER (PARTITION BY qid ORDER BY k, r) AS final_rank FROM (
    SELECT f.qid, f.chunk_id, 'content' AS section_type, f.fused_score, f.pre_rank, f.rerank_score, NULL::DOUBLE AS score, 0 AS k, f.rank AS r FROM final f JOIN lim USING (qid) WHERE f.rank <= l - nb
    UNION ALL SELECT b.qid, b.id, 'bibliography', 0.0, NULL, NULL, b.score, 1, b.rank FROM bib b JOIN lim USING (qid) WHERE b.rank <= nb))
"""


def _quota(spark, d):
    ranked, fused, chunks = _reranked(spark, d)
    target = fusion.best_paper(fused, chunks).select("qid", "paper_id")
    found = lexical.search_scoped(_index(spark, d, "bibliography"), _common(spark, d).join(target, "qid"), S.retrieval.rewrite.bibliography_top_k).withColumnRenamed("id", "chunk_id")
    plans = fx.query_texts(spark, d).select("qid", (F.col("qid") % 2 == 0).alias("search_bibliography"))
    return fusion.quota(ranked, found, plans, S.reranking.final_top_k, S.retrieval.rewrite.bibliography_top_k), ranked


@query("final_quota", QUOTA_SQL + "SELECT qid, chunk_id, section_type, round(fused_score, 9) AS fused_score, CAST(final_rank AS BIGINT) AS final_rank FROM quota")
def final_quota(spark, d):
    return _quota(spark, d)[0].select("qid", "chunk_id", "section_type", F.round("fused_score", 9).alias("fused_score"), F.col("final_rank").cast("long").alias("final_rank"))


RECORD = "rank long, chunk_id string, vector_id long, paper_id string, paper_title string, section string, content_kind string, front_matter_type string, section_type string, page_start int, page_end int, raw_text string, pre_rerank_rank long, rerank_score double, fused_score double, source_matches array<struct<route:string,query:string,rank:int,raw_score:double,effective_weight:double>>"


@query("retrieval_json", QUOTA_SQL + """,
words AS (SELECT qid, string_agg(word, ' OR ' ORDER BY n) AS words FROM kws GROUP BY qid),
matches AS (
  SELECT h.qid, h.chunk_id, string_agg(CASE route WHEN 'dense_rewrite' THEN '' WHEN 'bm25_rewrite' THEN words ELSE query END, chr(10) ORDER BY place) AS asked, round(sum((place + 1) * score), 6) AS checked
  FROM hits h JOIN qs USING (qid) LEFT JOIN words USING (qid) GROUP BY ALL)
SELECT q.qid, CAST(final_rank AS BIGINT) AS rank, q.chunk_id, n.vector_id, c.paper_id, c.paper_title, c.section, CASE WHEN c.section = 'Abstract' THEN 'front_matter' ELSE 'body' END AS content_kind, CASE WHEN c.section = 'Abstract' THEN 'abstract' END AS front_matter_type, q.section_type, c.page_start, c.page_end,
       substr(c.raw_text, 1, 500) AS raw_text, CAST(q.pre_rank AS BIGINT) AS pre_rerank_rank, round(q.rerank_score, 9) AS rerank_score, round(q.fused_score, 9) AS fused_score, CASE q.section_type WHEN 'bibliography' THEN 'bm25_bibliography:' || route_rank ELSE f.sources END AS sources,
       CASE q.section_type WHEN 'bibliography' THEN w.words ELSE m.asked END AS asked, CASE q.section_type WHEN 'bibliography' THEN round(5 * q.score, 6) ELSE m.checked END AS checked
FROM quota q JOIN chunks c USING (chunk_id) LEFT JOIN words w ON w.qid = q.qid LEFT JOIN matches m ON m.qid = q.qid AND m.chunk_id = q.chunk_id LEFT JOIN numbered n ON n.chunk_id = q.chunk_id LEFT JOIN fused f ON f.qid = q.qid AND f.chunk_id = q.chunk_id""")
def retrieval_json(spark, d):
    """The records as JSON, read again: what each route searched for, and the sum of its scores by the routes' places."""
    final, ranked = _quota(spark, d)
    plans = fx.query_texts(spark, d).select("qid", F.col("query").alias("original_query"), F.lit(None).cast("string").alias("semantic_query"), "keywords")
    records = fusion.to_json(fusion.detailed(final, ranked).join(fx.chunks(spark, d).select(*fusion.RECORD_COLUMNS), "chunk_id").join(plans, "qid"))
    asked = F.array_join(F.transform("source_matches", lambda x: F.coalesce(x["query"], F.lit(""))), "\n").alias("asked")
    places = F.create_map(*(F.lit(v) for i, r in enumerate([*fusion.ROUTES, "bm25_bibliography"]) for v in (r, float(i + 1))))
    checked = F.round(F.aggregate("source_matches", F.lit(0.0), lambda t, x: t + x["raw_score"] * F.element_at(places, x["route"])), 6).alias("checked")
    shown = F.array_join(F.transform("source_matches", lambda x: F.concat_ws(":", x["route"], x["rank"])), ",").alias("sources")
    parsed = records.select("qid", F.from_json("json", RECORD).alias("r")).select("qid", "r.*")
    return parsed.select("qid", *(c for c in parsed.columns if c not in ("qid", "rerank_score", "fused_score", "source_matches")), F.round("rerank_score", 9).alias("rerank_score"), F.round("fused_score", 9).alias("fused_score"), shown, asked, checked)


@query("quota_without_reranking", FUSED_SQL + "SELECT qid, chunk_id, CAST(pre_rank AS BIGINT) AS final_rank FROM fused WHERE pre_rank <= 50")
def quota_without_reranking(spark, d):
    """With reranking off, the size of the fused list limits the result."""
    hits, _ = _routes(spark, d)
    ranked = fusion.rerank(fusion.fuse(hits, S.retrieval.rrf_k), None, S.reranking.candidate_top_k)
    plans = fx.query_texts(spark, d).select("qid", F.lit(False).alias("search_bibliography"))
    none = ranked.limit(0).select("qid", "chunk_id", "rank")
    return fusion.quota(ranked, none, plans, S.retrieval.fused_top_k, S.retrieval.rewrite.bibliography_top_k).select("qid", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))
