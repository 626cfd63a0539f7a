"""Interaction audit of text filters: what each removes in every order of application.

Words are counted relationally: texts are exploded to words, words are aggregated per document
and word, and those per document to totals and distinct ones.  The other flags are joined to
these counts from outside, so that documents without any word stay.  A document's five failures
make one of 32 patterns; per part the patterns are counted in 32 conditional columns (and again
for good and for toxic documents), and every order's steps are sums of these.

A text is moved once.  Rows with one document id, source and text are one row with a count
before that, and the word counts are aggregated where the texts lie, so neither very common
words nor repeated rows meet in one task.  Equal texts meet by digest, dealt under salts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import group_value, materialize, salted_join, shared_dir

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
#: Limits of the filters: words, percent of distinct words, percent of capitals, characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, text: a null text is empty and a null source the part ''."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def word_counts(rows: DataFrame) -> DataFrame:
    """doc_id, part, digest, words, different: of texts with any word; exploded, by word, then by document.

    Texts are dealt by document first, so both aggregations take place where they lie.
    """
    texts = rows.groupBy("doc_id", "part", "digest").agg(F.first("text").alias("text"))
    words = texts.select("doc_id", "part", "digest", F.explode(F.split("text", SPACE)).alias("word")).where("word != ''")
    by_word = words.groupBy("doc_id", "part", "digest", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "part", "digest").agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, copies, pattern: bit k is set where the document fails the k-th filter; rows that agree in id, part and text are one with a count.

    Under E a document fails if its text stands under any smaller id; a null id is larger than
    all others, and rows that share the id and the text do not fail each other.  An empty text
    has no words: it fails A, and none of B, C and D.
    """
    rows = named(docs)
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    light = rows.select("doc_id", "part", "digest", (100 * capitals > MOST_CAPITALS * F.length("text")).alias("C"), F.col("text").rlike(MARKS).alias("D"))
    light = light.groupBy("doc_id", "part", "digest", "C", "D").agg(F.count("*").alias("copies"))
    counts = word_counts(rows)
    same = reduce(lambda a, b: a & b, (light[k].eqNullSafe(counts[k]) for k in ("doc_id", "part", "digest")))
    words, different = (F.coalesce(counts[c], F.lit(0)) for c in ("words", "different"))
    joined = light.join(counts, same, "left").select(*(light[c] for c in light.columns), (words < LEAST_WORDS).alias("A"), (100 * different < LEAST_DISTINCT * words).alias("B"))
    # a few numbers per document, read several times from here on; equal digests carry equal texts
    counted = materialize(joined, f"{shared_dir(docs.sparkSession)}/counted")
    first = group_value(counted, "digest", ("doc_id", "part"), F.min("doc_id"), F.min, "first_id")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("first_id").isNotNull())
    bits = [F.col("A"), F.col("B"), F.col("C"), F.col("D"), copy]
    return first.select("doc_id", "part", "copies", sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0)).alias("pattern"))


def judged(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, copies, pattern, good, toxic; of a document with several labels any counts.  Rows of one id are dealt under salts."""
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = marks.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    met = salted_join(flagged.where("doc_id IS NOT NULL"), known, "doc_id", ("part", "pattern"), how="left")
    rest = flagged.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return met.unionByName(rest).select("part", "copies", "pattern", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def pattern_counts(rows: DataFrame) -> DataFrame:
    """part and three arrays of 32 numbers: documents (n), good ones and toxic ones by pattern, from 32 conditional columns each."""
    kinds = {"n": "copies", "good": "copies * good", "toxic": "copies * toxic"}
    wide = rows.groupBy("part").agg(*(F.expr(f"sum(CASE WHEN pattern = {p} THEN {value} ELSE 0 END) AS {kind}_{p}") for kind, value in kinds.items() for p in range(PATTERNS)))
    return wide.select("part", *(F.array(*(f"{kind}_{p}" for p in range(PATTERNS))).alias(kind) for kind in kinds))


def steps(counts: DataFrame) -> DataFrame:
    """One row per part, order and step; what a step does depends on its filter and on which came before."""
    n = len(FILTERS)
    cases = [(f, before) for f in range(n) for before in range(PATTERNS) if not before >> f & 1]
    listed = ", ".join(f"named_struct('f', {1 << f}, 'b', {before})" for f, before in cases)

    def sums(kind: str, fits: str, name: str) -> Column:
        """For each case (filter c.f, filters before it c.b) the sum of the counts of the patterns p that fit it."""
        return F.expr(f"transform(array({listed}), c -> aggregate(filter(sequence(0, {PATTERNS - 1}), p -> {fits}), 0L, (t, p) -> t + {kind}[p])) AS {name}")

    lost = "(p & c.f) != 0 AND (p & c.b) = 0"
    shared = counts.select(
        "part",
        sums("n", "(p & (c.f | c.b)) = 0", "kept"),
        sums("n", lost, "removed"),
        sums("n", "(p & c.f) != 0 AND (p & c.b) != 0", "redundant"),
        sums("n", "p = c.f", "unique_fails"),
        sums("good", lost, "good_lost"),
        sums("toxic", lost, "toxic_lost"),
    )
    # a set of k filters comes before the filter in k! (n - 1 - k)! orders
    weights = [(f, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())) for f, before in cases]
    places = ", ".join("array(" + ", ".join(f"named_struct('i', {i}, 'w', {w})" for i, (g, w) in enumerate(weights) if g == f) + ")" for f in range(n))
    shares = F.expr(f"transform(array({places}), of -> aggregate(of, 0L, (t, x) -> t + x.w * removed[x.i])) AS shares")
    orders = list(permutations(range(n)))
    at = [cases.index((f, sum(1 << x for x in order[:k]))) for order in orders for k, f in enumerate(order)]
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    flat = shared.select("*", shares).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))).alias("i"))
    placed = flat.withColumn("order", F.get(F.split(F.lit(",".join("".join(FILTERS[x] for x in o) for o in orders)), ","), F.floor(F.col("i") / n).cast("int"))).withColumn("at", F.get(numbers(at), F.col("i")))
    mine = F.get("shares", F.get(numbers([f for f, _ in cases]), F.col("at")))
    each = [F.get(c, F.col("at")).alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    return placed.select("part", F.col("order").alias("filter_order"), (F.col("i") % n + 1).cast("int").alias("step"), *each, mine.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there: 600 rows for each part, zeros included.

    A null text is empty and a null source the part ''.  Null ids, empty texts and repeated rows
    are judged as ``flags`` says, each row counting once;
    labels without a document or an id have no effect; a text of any length counts whole; only
    ``doc_id``, ``source`` and ``text`` are looked at.  An empty table gives no rows.
    """
    return steps(pattern_counts(judged(flags(docs), labels)))


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: the five filters over all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY 1),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    len(w.words) < 200 AS a,
    100 * len(list_distinct(w.words)) < 50 * len(w.words) AS b,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d,
    w.doc_id > m.first_id AS e
  FROM w JOIN m ON w.text = m.text LEFT JOIN l ON w.doc_id = l.doc_id),
t AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM x p, x q, x r, x s, x u
  WHERE p.f NOT IN (q.f, r.f, s.f, u.f) AND q.f NOT IN (r.f, s.f, u.f) AND r.f NOT IN (s.f, u.f) AND s.f <> u.f),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substring(filter_order, step, 1) AS mine, substring(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (
  SELECT t.part, k.filter_order, k.step, k.mine, t.n, t.good, t.toxic,
    CASE k.mine WHEN 'A' THEN t.a WHEN 'B' THEN t.b WHEN 'C' THEN t.c WHEN 'D' THEN t.d ELSE t.e END AS fails,
    (t.a AND contains(k.before, 'A')) OR (t.b AND contains(k.before, 'B')) OR (t.c AND contains(k.before, 'C')) OR (t.d AND contains(k.before, 'D')) OR (t.e AND contains(k.before, 'E')) AS gone,
    CAST(t.a AS INTEGER) + CAST(t.b AS INTEGER) + CAST(t.c AS INTEGER) + CAST(t.d AS INTEGER) + CAST(t.e AS INTEGER) AS failures
  FROM t, k),
g AS (
  SELECT part, filter_order, step, mine,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM g
"""
