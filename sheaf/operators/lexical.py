"""Positional inverted index and BM25 over phrases, natively.

The index is three tables, stored with the chunks and read by every search: ``postings`` (a row
per term, chunk and column, with the term's places), ``lengths`` (each chunk's terms in order,
by column, and their number) and ``terms`` (how many chunks have a term).  All are divided by
section type; the text is passed over once (``analysed``), for ``lengths``, and the other two
are made of the terms there.  A chunk's rows stay where the chunk is: nothing is shuffled to build
the index but the counts of terms.

A phrase occurs where its terms stand one after the other; occurrences may overlap and never
span columns.  Only places of a phrase's rarest term are looked at, and the others are compared
there, in the chunk's own row.  The score of a phrase p in a document D is

    -idf(p) * f * (k1 + 1) / (f + k1 * (1 - b + b * |D| / avgdl)),

with f the sum of column weight times occurrences and idf = ln((N - n + 0.5) / (n + 0.5)),
replaced by 1e-6 where it is not positive.  Lower is better.

The phrases of the questions go to the chunks, a block of them at a time, so what is shuffled
is found occurrences, once, and not the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.config import Bm25
from sheaf.functions import text as X
from sheaf.storage import written

COLUMNS = ("paper_title", "section", "raw_text")
LEAST_IDF = 1e-6
#: Phrases that are sent to all workers at once, about.
BLOCK_PHRASES = 100_000


@dataclass(frozen=True)
class Index:
    """The three tables of an index, whole or of one section type, and what is known of the lengths' totals."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    #: section type -> number of chunks and sum of their lengths.
    totals: dict[str, tuple[int, int]] | None = None

    def of(self, section_type: str) -> Index:
        part = F.col("section_type") == section_type
        totals = None if self.totals is None else {section_type: self.totals.get(section_type, (0, 0))}
        return Index(self.postings.where(part), self.lengths.where(part), self.terms.where(part), totals)


def _owned(chunks: DataFrame) -> DataFrame:
    """Chunks as they are indexed; without papers and types they are content of one paper."""
    lacking = [c for c in ("paper_id", "section_type") if c not in chunks.columns]
    return chunks.withColumns({c: F.lit("content" if c == "section_type" else "") for c in lacking}) if lacking else chunks


def analysed(chunks: DataFrame) -> DataFrame:
    """section_type, paper_id, id, len, columns (their terms in order) of each chunk: the only pass over the text."""
    columns = F.array(*(X.tokens(F.col(c)) for c in COLUMNS))
    rows = _owned(chunks).select("section_type", "paper_id", F.col("chunk_id").alias("id"), columns.alias("columns"))
    return rows.select("section_type", "paper_id", "id", F.size(F.flatten("columns")).alias("len"), "columns")


def listed(chunks: DataFrame) -> DataFrame:
    """id, col, terms: the terms of each indexed column that has any, in order; they stay in the chunk's row."""
    columns = F.array(*(X.tokens(F.col(c)) for c in COLUMNS))
    return chunks.select(F.col("chunk_id").alias("id"), F.posexplode(columns).alias("col", "terms")).where(F.size("terms") > 0)


def ordered(rows: DataFrame) -> DataFrame:
    """Postings dealt by ranges of term and chunk, and sorted within."""
    return rows.repartitionByRange("term", "id").sortWithinPartitions("section_type", "term", "id")


def postings(rows: DataFrame) -> DataFrame:
    """section_type, paper_id, term, id, col, positions of analysed chunks.

    A chunk's terms are put together within its row, so nothing is shuffled to group them.
    """
    places = F.flatten(F.transform("columns", lambda ts, c: F.transform(ts, lambda t, i: F.struct(t.alias("term"), c.alias("col"), i.alias("pos")))))
    rows = rows.select("section_type", "paper_id", "id", F.sort_array(places).alias("p"))
    first = lambda i: (i == 0) | (F.get("p", i)["term"] != F.get("p", i - 1)["term"]) | (F.get("p", i)["col"] != F.get("p", i - 1)["col"])
    starts = F.filter(F.sequence(F.lit(0), F.size("p") - 1), first)
    rows = rows.withColumn("starts", F.when(F.size("p") > 0, starts).otherwise(F.expr("cast(array() as array<int>)")))
    # by numbers, for a slice reads the whole array, and that for every term
    group = lambda s, k: F.struct(F.get("p", s)["term"].alias("term"), F.get("p", s)["col"].alias("col"), F.transform(F.sequence(s, F.coalesce(F.get("starts", k + 1), F.size("p")) - 1), lambda i: F.get("p", i)["pos"]).alias("positions"))
    # an inner explode would filter by the size of its array, and sort the places again for every start
    rows = rows.select("section_type", "paper_id", "id", F.explode_outer(F.transform("starts", group)).alias("t")).where("t is not null")
    return rows.select("section_type", "paper_id", "t.term", "id", "t.col", "t.positions")


def lengths(rows: DataFrame) -> DataFrame:
    """section_type, paper_id, id, number of terms over all indexed columns, and the columns' terms in order."""
    return rows.select("section_type", "paper_id", "id", "len", "columns")


def term_counts(rows: DataFrame) -> DataFrame:
    """section_type, term, df (chunks that have it) of analysed chunks."""
    distinct = F.array_distinct(F.flatten("columns"))
    return rows.select("section_type", F.explode_outer(distinct).alias("term")).where("term is not null").groupBy("section_type", "term").agg(F.count("*").alias("df"))


def summed(counts: DataFrame) -> DataFrame:
    """Counts of several segments put together; what has been taken back altogether is gone."""
    return counts.groupBy("section_type", "term").agg(F.sum("df").alias("df")).where("df != 0")


def totals(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """section type -> number of chunks and sum of their lengths: one row per type."""
    return {r["section_type"]: (r["n"], r["total"]) for r in rows.groupBy("section_type").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}


def index(chunks: DataFrame) -> Index:
    """An index that is not stored, for a few chunks."""
    rows = analysed(chunks)
    return Index(postings(rows), lengths(rows), term_counts(rows))


def stats(sizes: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return sizes.agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avgdl"))


def phrases(queries: DataFrame) -> DataFrame:
    """qid, pid, phrase (its terms) of queries (qid, texts): each text one phrase; blank ones dropped, equal ones once."""
    texts = queries.select("qid", F.posexplode(X.first_seen(F.col("texts"))).alias("pid", "text"))
    return texts.select("qid", "pid", X.tokens(F.col("text")).alias("phrase")).where(F.size("phrase") > 0)


def anchors(stored: Index, wanted: DataFrame) -> DataFrame:
    """qid, pid, phrase, term, off, df: each phrase with its rarest term; phrases with a term that no chunk has are dropped."""
    by = Window.partitionBy("qid", "pid")
    longer = wanted.select("qid", "pid", "phrase", F.posexplode("phrase").alias("off", "term"))
    # the semi-join comes before the counts of several segments are added up
    known = longer.join(stored.terms.join(longer.select("term").distinct(), "term", "left_semi").select("term", "df"), "term")
    ranked = known.withColumn("n", F.row_number().over(by.orderBy("df", "off"))).withColumn("have", F.count("*").over(by))
    return ranked.where("n = 1 and have = size(phrase)").select("qid", "pid", "phrase", "term", "off", "df")


def occurrences(stored: Index, anchored: DataFrame, count: int) -> DataFrame:
    """qid, pid, df, id, paper_id, len, col of every occurrence of anchored phrases, ``count`` of them."""
    columns = stored.lengths.select("id", "paper_id", "len", F.posexplode("columns").alias("col", "ts"))
    places = columns.select("*", F.posexplode("ts").alias("pos", "term"))
    start, blocks = F.col("pos") - F.col("off"), max(1, -(-count // BLOCK_PHRASES))
    out = None
    for block in range(blocks):
        part = anchored.where(F.pmod(F.xxhash64("qid", "pid"), F.lit(blocks)) == block) if blocks > 1 else anchored
        met = places.join(F.broadcast(part), "term").where((start >= 0) & (F.slice("ts", F.greatest(start, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")))
        met = met.select("qid", "pid", "df", "id", "paper_id", "len", "col")
        out = met if out is None else out.unionByName(met)
    return out


def scores(stored: Index, queries: DataFrame, settings: Bm25 = Bm25(), scope: DataFrame | None = None) -> DataFrame:
    """qid, id, score of all chunks with any phrase of the query; with a ``scope`` (qid, paper_id) of its paper's only.

    Phrases of one term have the stored count of chunks as df; the others' occurrences are stored
    and counted.  Statistics are of all chunks in any case.
    """
    anchored = written(anchors(stored, phrases(queries)))
    counts = {r["single"]: r["count"] for r in anchored.groupBy((F.size("phrase") == 1).alias("single")).count().collect()}
    within = lambda rows: rows if scope is None else rows.join(scope, ["qid", "paper_id"])
    tally = [F.count_if(F.col("col") == i).alias(f"n{i}") for i in range(len(COLUMNS))]
    ones = [(F.col("col") == i).cast("long").alias(f"n{i}") for i in range(len(COLUMNS))]
    key = ("qid", "pid", "id", "paper_id", "len")
    rows = within(occurrences(stored, anchored.where("size(phrase) = 1"), counts.get(True, 0))).select(*key, "df", *ones)
    if counts.get(False):
        found = written(occurrences(stored, anchored.where("size(phrase) > 1"), counts[False]).groupBy(*key).agg(*tally))
        spread = found.groupBy("qid", "pid").agg(F.count("*").alias("df"))
        rows = rows.unionByName(within(found.join(spread, ["qid", "pid"])))
    # dealt once, by what both groupings have in common
    once = rows.select("qid", "pid", "id", "len", "df", *(f"n{i}" for i in range(len(COLUMNS)))).repartition("qid", "id")
    summed_up = once.groupBy("qid", "pid", "id", "len", "df").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(COLUMNS))))
    f = sum((F.lit(float(w)) * F.col(f"n{i}") for i, w in enumerate((settings.title_weight, settings.section_weight, settings.text_weight))), F.lit(0.0))
    joined = summed_up.withColumn("f", f)
    if stored.totals is None:
        joined, n_chunks, mean = joined.join(F.broadcast(stats(stored.lengths))), F.col("n_chunks"), F.col("avgdl")
    else:
        n, total = (sum(t[i] for t in stored.totals.values()) for i in (0, 1))
        n_chunks, mean = F.lit(n), F.lit(total / n if n else 0.0)
    raw = F.log((n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(LEAST_IDF)
    k1, b = settings.k1, settings.b
    part = -idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / mean))
    return joined.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k lowest scores of each query: qid, id, score, rank; equal scores by id."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 12), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(stored: Index, queries: DataFrame, k: int, settings: Bm25 = Bm25()) -> DataFrame:
    """BM25 of queries (qid, texts) over an index: the k best per query."""
    return top(scores(stored, queries, settings), k)


def search_scoped(stored: Index, queries: DataFrame, k: int, settings: Bm25 = Bm25()) -> DataFrame:
    """As search, for queries (qid, texts, paper_id): hits of that paper only, statistics of all chunks."""
    queries = written(queries)
    return top(scores(stored, queries, settings, queries.select("qid", "paper_id")), k)
