"""Benchmark decontamination by winnowed k-gram fingerprints.

Training and benchmark texts are fingerprinted alike: of the k-gram hashes in every window of
``window - k + 1`` consecutive k-grams the smallest is kept (the rightmost of equals).  A span
of ``window`` words that both share holds at least one k-gram that both keep, so a join of
the fingerprints meets every such span.  Each hit is then extended to the windows of ``window``
words around it; those that the benchmark has are compared word by word, and a run of them is
a shared passage.  Windows are looked up by hash and name the items that have them, so a k-gram
that very many items begin with costs no more than another.  Benchmark items with fewer words
are one window as a whole: documents are also looked up by the hashes of runs of those lengths.

The benchmark is cut into pieces (long items overlap by a window less one word) and the pieces
are dealt into blocks of about ``block_words`` words.  A block's index is the broadcast side of
the join; this bound keeps it small whatever the benchmark's size.  With one block a document's
row is answered where it lies.  With more, the documents are written once with a row number,
each block is applied on its own and writes the rows it hits, and these meet at the end, so
neither the driver nor a worker ever holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import HashCache, alnum_words, gram_hashes, materialize, shared_dir, text_of, trimmed

WINDOW = 13
GRAM = 5
#: Words of the benchmark that one block holds, about (100 MB in a worker).
BLOCK_WORDS = 500_000
#: Words of an item that one piece holds at most, besides the overlap.
PIECE_WORDS = 4_096

_CACHE = HashCache()


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the k-grams kept: the rightmost minimum of each ``span`` consecutive hashes."""
    if len(grams) < span or span < 1:
        return np.zeros(0, np.int64)
    turned = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    at = np.arange(len(turned)) + turned.argmin(axis=1)
    kept = np.zeros(len(grams), bool)
    kept[len(grams) - 1 - at] = True
    return np.flatnonzero(kept)


class Index:
    """Fingerprints and windows of one block of pieces of items.

    ``words`` are the word hashes of all pieces, one after another; ``windows`` the sorted
    hashes of the distinct windows, each with a place in ``words`` where it stands and the
    number of the list of items that have it.  Windows with the same items share a list.
    """

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int, k: int):
        self.window, self.k, self.span = window, k, window - k + 1
        cache = HashCache()
        arrays = [cache.array(words.split()) for _, words in pieces]
        names = sorted({name for name, _ in pieces}, key=lambda x: (x is None, x or ""))
        number = {name: i for i, name in enumerate(names)}
        self.names = names
        self.words = np.concatenate([np.zeros(0, np.uint64), *arrays])
        base = np.cumsum([0, *map(len, arrays)])
        grams: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}  # size -> hashes, places, item
        for (name, _), words, at in zip(pieces, arrays, base.tolist(), strict=False):
            size = min(window, len(words))
            if not size:
                continue
            if size == window:
                own = gram_hashes(words, k)
                grams.append(own[winnow(own, self.span)])
            hashes = gram_hashes(words, size)
            found.setdefault(size, []).append((hashes, at + np.arange(len(hashes)), number[name]))
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.lists: list[tuple[int, ...]] = []
        lists: dict[tuple[int, ...], int] = {}
        #: size of window -> hashes, places, numbers of lists
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            hashes, places = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            items = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
            order = np.lexsort((items, hashes))
            hashes, places, items = hashes[order], places[order], items[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            owners = np.empty(len(first), np.int64)
            for i, (x, y) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True)):
                own_items = tuple(dict.fromkeys(items[x:y].tolist()))
                if own_items not in lists:
                    lists[own_items] = len(self.lists)
                    self.lists.append(own_items)
                owners[i] = lists[own_items]
            self.tables[size] = hashes[first], places[first], owners

    def _stand(self, words: np.ndarray, starts: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of windows of the text those that the block has, word by word, and the numbers of their lists."""
        known, places, owners = self.tables[size]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        fine = np.flatnonzero(known[at] == hashes)
        starts, at = starts[fine], at[fine]
        same = np.ones(len(starts), bool)
        for q in range(size):
            same &= words[starts + q] == self.words[places[at] + q]
        return starts[same], owners[at[same]]

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of hit words (start, end), merged, and the numbers of the items with occurring windows."""
        runs: list[tuple[int, int]] = []
        lists: set[int] = set()
        n = len(words)
        for size in self.tables:
            if n < size:
                continue
            if size == self.window:
                grams = gram_hashes(words, self.k)
                kept = winnow(grams, self.span)
                met = kept[_member(grams[kept], self.keys)]
                if not len(met):
                    continue
                # every window that holds a k-gram met
                starts = np.unique((met[:, None] - np.arange(self.span)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= n - size)]
                hashes = np.concatenate([gram_hashes(words[x : y + size], size) for x, y in _ranges(starts)]) if len(starts) else np.zeros(0, np.uint64)
            else:
                starts, hashes = np.arange(n - size + 1), gram_hashes(words, size)
            starts, owners = self._stand(words, starts, hashes, size)
            runs += [(x, y + size) for x, y in _ranges(starts)]
            lists.update(owners.tolist())
        return merge(runs), {item for x in lists for item in self.lists[x]}


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def pieces(benchmark: DataFrame, window: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """name, words, n: the items' words in pieces that overlap by a window less one word; items without words give none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, counts = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                words = alnum_words(text.as_py())
                for at in range(0, max(1, len(words) - window + 1) if words else 0, piece_words):
                    part = words[at : at + piece_words + window - 1]
                    names.append(name)
                    parts.append(b" ".join(part))
                    counts.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array(counts, pa.int64())], names=["name", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(cut, "name string, words binary, n long")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Add to each document: n_words, runs ([start, end) of hit words, merged), items (ids as strings, sorted).

    A null text has no words.  Items without words never occur; repeated item ids count
    once, and so do null ids, as one null at the end of items.  Repeated documents and null
    doc_ids are separate rows; texts and items of any length count whole; an empty table of
    documents gives no rows, an empty benchmark no hits.  Columns of ``docs`` other than
    doc_id, text and those named by ``keep`` are dropped.
    """
    frame, spark = text_of(docs, *keep), docs.sparkSession
    folder = folder or shared_dir(spark)
    bench = materialize(pieces(benchmark, window).withColumn("row", F.monotonically_increasing_id()), f"{folder}/pieces")
    blocks = max(1, -(-(bench.agg(F.sum("n").alias("n")).first()["n"] or 0) // block_words))
    if blocks == 1:
        return _applied(frame, spark.sparkContext.broadcast(_collected(bench)), window, k, None)
    # rows get numbers that a later pass sees again
    frame = materialize(frame.withColumn("__row", F.monotonically_increasing_id()), f"{folder}/rows")
    block_of = F.pmod(F.xxhash64("row"), F.lit(blocks))
    hits = []
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(_collected(bench.where(block_of == b)))
        hits.append(materialize(_applied(frame.select("__row", "text"), shared, window, k, b), f"{folder}/hits{b}"))
        shared.unpersist()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    # one row a document: the first pass has all of them, for their words
    joined = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    schema = T.StructType([T.StructField("__row", T.LongType()), *HITS.fields])
    return frame.join(joined.mapInArrow(_merged, schema), "__row").drop("__row")


def _collected(bench: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r["name"], bytes(r["words"])) for r in bench.select("name", "words").collect()]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs merged, items once each."""
    for batch in batches:
        runs = [[list(x) for x in merge(list(map(tuple, row)))] for row in batch.column("runs").to_pylist()]
        items = [_sorted(row) for row in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("n_words"), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], names=["__row", "n_words", "runs", "items"])


def _sorted(names) -> list[str | None]:
    return sorted(set(names), key=lambda x: (x is None, x or ""))


def _applied(frame: DataFrame, shared, window: int, k: int, number: int | None) -> DataFrame:
    """The frame without its text in a numbered pass, with what one block hits; passes after the first give rows with hits only."""
    fields = [f for f in frame.schema.fields if number is None or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(shared.value, window, k)
            counts, runs, items = [], [], []
            for text in batch.column("text"):
                words = _CACHE.array(alnum_words(text.as_py()))
                got, found = index.hits(words)
                counts.append(len(words))
                runs.append([list(r) for r in got])
                items.append(_sorted(index.names[x] for x in found))
            kept = [f.name for f in fields]
            columns = [*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "runs", "items"])
            yield out.take(pa.array([i for i, r in enumerate(runs) if r], pa.int64())) if number else out

    return frame.mapInArrow(trimmed(run), T.StructType([*fields, *HITS.fields]))


def contaminated(hits: DataFrame) -> DataFrame:
    """n_hit and the decision: at least a twentieth of the words are hit."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r[1] - r[0])
    hits = hits.withColumn("n_hit", n_hit)
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = [c for c in docs.columns if c != "text"]
    boxed = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("text"), *(F.col(f"`{c}`") for c in own)).alias("own"))
    left = contaminated(find(boxed, benchmark, keep=("own",), **options)).where("not contaminated")
    return left.select(*(F.when(~F.col("own.text"), F.col("text")).alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of every document that stand inside benchmark windows."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = contaminated(find(docs, bench))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH lowered AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id::VARCHAR, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
windows AS (
  SELECT DISTINCT id AS item, least(13, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS w
  FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM words WHERE side = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
spans AS (
  SELECT id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w
  FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(ws) >= m)),
hits AS (SELECT s.id, s.i, s.m, b.item FROM spans s JOIN windows b ON b.m = s.m AND b.w = s.w),
counts AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT w.id::BIGINT AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN counts c ON c.id = w.id LEFT JOIN items i ON i.id = w.id WHERE side = 'd'
"""
