"""Exact inner-product search and the vector table's life: ids, checks, fingerprints.

A few query vectors are sent to the workers and scored against all stored vectors: each task
keeps the k best per query of what it has seen, and one window merges what the tasks kept, so at
most tasks * queries * k rows are shuffled.  More queries than BATCH_QUERIES are searched in
tiles: queries and vectors are dealt into blocks, each pair of blocks meets in one group, and
the groups' k best are merged in two steps.  Each side is read once, and nothing goes through
the driver.  Scores of all pairs are quadratic work; what is shuffled is the vectors once per
TILE_QUERIES queries, in their own type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import vector as V
from sheaf.storage import shared_folder, written

#: Query vectors that are sent to all workers at most, and that a tile holds, about: a vector is copied once per so many queries.
BATCH_QUERIES, TILE_QUERIES = 4096, 1 << 14
#: Stored vectors of a tile, about, and how many tiles' results the first merge puts together.
TILE_VECTORS, MERGED = 1 << 18, 16
#: Stored vectors and queries that are scored at once.
SCORED_ROWS, SCORED_QUERIES = 1024, 2048
#: Digests that one group of a digest tree joins at most, about.
GROUP = 1000


def search(vectors: DataFrame, queries: DataFrame, k: int, batch: int | None = None, tile: int = TILE_VECTORS) -> DataFrame:
    """qid, vector_id, score, rank: the k largest inner products; equal ones by vector_id.

    ``vectors``: vector_id, embedding.  ``queries``: qid (each once), embedding.
    """
    wanted = queries.select("qid", "embedding")
    count = wanted.count()
    batch = batch or (BATCH_QUERIES if count <= BATCH_QUERIES else TILE_QUERIES)
    # a few more than are sent to all workers are two blocks at least
    blocks = max(1 if count <= min(batch, BATCH_QUERIES) else 2, -(-count // batch))
    if blocks == 1:
        out = _pass(vectors, wanted.collect(), k)
    else:
        out = _tiles(vectors, wanted, k, blocks, max(1, -(-vectors.count() // tile)))
        part = Window.partitionBy("qid", "part").orderBy(F.desc("score"), "vector_id")
        out = out.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= k).select("qid", "vector_id", "score")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vector_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tiles(vectors: DataFrame, queries: DataFrame, k: int, rows: int, columns: int) -> DataFrame:
    """qid, vector_id, score, part: the k best of each tile; ``part`` numbers MERGED tiles of a query.

    In a tile the queries come first, then the vectors, batch by batch.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    asked = queries.select(dealt(rows, "qid", "embedding").alias("i"), every(columns).alias("j"), F.lit(0).alias("side"), F.col("qid").alias("id"), F.col("embedding").alias("v"))
    given = vectors.select(dealt(columns, "vector_id").alias("j"), every(rows).alias("i"), F.lit(1).alias("side"), F.col("vector_id").alias("id"), F.col("embedding").alias("v"))
    met = asked.unionByName(given).repartition("i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, matrix, best, names = None, [], [], None, None

        def kept() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best):
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.concatenate(ids), n)), pa.array(names.ravel()), pa.array(best.ravel()), pa.array(np.full(best.size, here[1] // MERGED, np.int32))], names=["qid", "vector_id", "score", "part"])

        for whole in batches:
            where = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "side")], 1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                tile, side = tuple(where[start, :2].tolist()), where[start, 2]
                if tile != here:
                    yield from kept()
                    here, ids, matrix, best, names = tile, [], [], None, None
                for at in range(start, end, SCORED_ROWS):
                    part = whole.slice(at, min(SCORED_ROWS, end - at))
                    block = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                    numbers = part.column("id").to_numpy(zero_copy_only=False)
                    if side == 0:
                        ids.append(numbers)
                        matrix.append(block)
                    elif matrix:
                        if best is None:
                            matrix = [np.concatenate(matrix)]
                            best, names = np.zeros((len(matrix[0]), 0)), np.zeros((len(matrix[0]), 0), np.int64)
                        best, names = bettered(best, names, matrix[0], block, numbers, k)
        yield from kept()

    return met.mapInArrow(run, "qid long, vector_id long, score double, part int")


def best_of(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest scores, equal ones by name; only those that reach the k-th are sorted."""
    width = scores.shape[1]
    if width <= k:
        return np.lexsort((names, -scores), axis=1)
    least = np.partition(scores, width - k, axis=1)[:, width - k]
    out = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores):
        some = np.flatnonzero(row >= least[i])
        out[i] = some[np.lexsort((names[i, some], -row[some]))[:k]]
    return out


def bettered(best: np.ndarray, names: np.ndarray, wanted: np.ndarray, block: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each wanted vector and their names, after a block of vectors; only rows that the block reaches are merged."""
    full = best.shape[1] == k
    out = [best, names] if full else [np.empty((len(wanted), min(k, best.shape[1] + len(numbers))), x.dtype) for x in (best, names)]
    for at in range(0, len(wanted), SCORED_QUERIES):
        scores = wanted[at : at + SCORED_QUERIES] @ block.T
        rows = np.flatnonzero(scores.max(axis=1) >= best[at : at + SCORED_QUERIES].min(axis=1)) if full and k and len(numbers) else np.arange(len(scores))
        both = np.concatenate([best[at + rows], scores[rows]], 1)
        named = np.concatenate([names[at + rows], np.broadcast_to(numbers, (len(rows), len(numbers)))], 1)
        order = best_of(both, named, k)
        out[0][at + rows], out[1][at + rows] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
    return out[0], out[1]


def _pass(vectors: DataFrame, batch: list, k: int) -> DataFrame:
    ids = np.array([r["qid"] for r in batch], np.int64)
    matrix = np.array([r["embedding"] for r in batch], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, wanted = shared.value
        best_ids, best = np.zeros((len(qids), 0), np.int64), np.zeros((len(qids), 0))
        for whole in batches:
            for at in range(0, whole.num_rows if len(qids) else 0, SCORED_ROWS):
                part = whole.slice(at, SCORED_ROWS)
                block = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                numbers = part.column("vector_id").to_numpy(zero_copy_only=False)
                best, best_ids = bettered(best, best_ids, wanted, block, numbers, k)
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(best_ids.ravel()), pa.array(best.ravel())], names=["qid", "vector_id", "score"])

    return vectors.select("vector_id", "embedding").mapInArrow(run, "qid long, vector_id long, score double")


def number_rows(rows: DataFrame, *order: str, first: int = 1, name: str = "vector_id", size: str | None = None) -> DataFrame:
    """Numbers rows in the given order without putting them all in one task.

    Rows are dealt out by range, counted per range and numbered within; the driver gets one
    count per range.  With ``size``, a column, each row takes so many numbers and gets the first of them.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    takes = F.lit(1) if size is None else F.col(size)
    counts = sorted(ranged.groupBy("__range").agg(F.sum(takes)).collect())
    starts, total = [], first
    for place, n in counts:
        starts.append((place, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "__range int, __start long")
    by = Window.partitionBy("__range").orderBy(*order)
    within = F.row_number().over(by) - 1 if size is None else F.sum(takes).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - takes
    return ranged.withColumn("__n", within).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__start") + F.col("__n")).drop("__range", "__n", "__start")


def invalid(vectors: DataFrame, dimension: int) -> DataFrame:
    """vector_id and problem of every vector that can't be stored."""
    found = vectors.select("vector_id", V.problem(F.col("embedding"), dimension).alias("problem"))
    return found.where("problem is not null")


def state(chunks: DataFrame) -> DataFrame:
    """One row: content chunks, assigned ones, least and greatest id."""
    content = chunks.where("section_type = 'content'")
    return content.agg(F.count("*").alias("n_content"), F.count("vector_id").alias("n_assigned"), F.min("vector_id").alias("min_id"), F.max("vector_id").alias("max_id"))


def fingerprint(rows: DataFrame, line: Column, *order: str, levels: int | None = None) -> DataFrame:
    """One row: the digest over all rows' digests in order.

    Rows are digested apart, then the digests of a thousand in a row, and so on, twice at
    least, until one is left: no group has more than a thousand.  With ``levels`` the last of
    them takes all digests that are left, read one by one in their order.
    """
    level = number_rows(rows.select(*order, F.sha2(line.cast("binary"), 256).alias("digest")), *order, first=0, name="at").select("at", "digest")
    most, times = level.agg(F.max("at")).first()[0], 0
    while times < (levels - 1 if levels else 2) or (levels is None and most):
        level = level.groupBy(F.floor(F.col("at") / GROUP).alias("at")).agg(joined("at").alias("digest"))
        most, times = (most or 0) // GROUP, times + 1
    if levels:
        level = level.repartition(1).sortWithinPartitions("at").mapInArrow(_digest_of_digests, "digest string")
    return level.agg(F.coalesce(F.min("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("fingerprint"))


def _digest_of_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the digest of a partition's digests in order, none held longer than its batch."""
    total, some = hashlib.sha256(), False
    for batch in batches:
        for value in batch.column("digest").to_pylist():
            total.update(value.encode())
            some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], names=["digest"])


def joined(order: str) -> Column:
    """The digest of a group's digests in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), "").cast("binary"), 256)


def depth_of(count: int) -> int:
    """How many levels below the root a tree over so many rows has, with about GROUP rows below each of its lowest."""
    depth = 1
    while GROUP ** (depth + 1) < count:
        depth += 1
    return depth


def digest_tree(rows: DataFrame, key: str, value: Column, depth: int, folder: str | None = None) -> DataFrame:
    """level, bucket, digest: a tree of digests over the rows' keys, which are each there once; written.

    A key's place is its hash, so a row that comes or goes changes its own branch only.  Level 0
    is the root; a bucket's parent is the bucket divided by GROUP.
    """
    digest = F.sha2(F.concat_ws("|", F.col(key).cast("string"), value).cast("binary"), 256)
    level = rows.select(place_of(F.col(key), depth).alias("bucket"), F.col(key).cast("string").alias("k"), digest.alias("digest")).groupBy("bucket").agg(joined("k").alias("digest"))
    levels = [written(level)]
    for _ in range(depth):
        levels.append(written(levels[-1].groupBy(F.floor(F.col("bucket") / GROUP).alias("bucket")).agg(joined("bucket").alias("digest"))))
    numbered = [frame.select(F.lit(depth - n).alias("level"), "bucket", "digest") for n, frame in enumerate(levels)]
    every = numbered[0]
    for frame in numbered[1:]:
        every = every.unionByName(frame)
    place = folder or shared_folder(rows.sparkSession)
    every.write.partitionBy("level").parquet(place)
    return rows.sparkSession.read.schema("bucket long, digest string, level int").parquet(place)


def place_of(key: Column, depth: int) -> Column:
    """A key's bucket in the lowest level of a tree."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(GROUP**depth))


def tree_differences(one: DataFrame, other: DataFrame, depth: int) -> DataFrame:
    """bucket: where the lowest levels of two trees differ, found from the roots down.

    A level is read below buckets that differ only; equal trees are told apart by their roots.
    """
    spark = one.sparkSession
    differ = spark.createDataFrame([(0,)], "bucket long")
    for level in range(depth + 1):
        # what differs one level up: as many rows as changes, at most
        sides = [t.where(F.col("level") == level).join(differ.select(F.col("bucket").alias("up")), F.floor(F.col("bucket") / GROUP if level else F.lit(0)) == F.col("up"), "left_semi").select("bucket", "digest") for t in (one, other)]
        both = sides[0].withColumnRenamed("digest", "a").join(sides[1].withColumnRenamed("digest", "b"), "bucket", "full_outer")
        differ = written(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket"))
        if not differ.limit(1).count():
            return differ
    return differ


def differences(one: DataFrame, other: DataFrame, key: str, value: Column, trees: tuple[DataFrame, DataFrame] | None = None, depth: int | None = None) -> DataFrame:
    """key, change (added, removed, changed): how ``other`` differs from ``one``.

    ``trees``: the digest trees of both, of ``depth``, where they are known; rows are compared in
    the buckets that differ only.
    """
    depth = depth or depth_of(one.count())
    first, second = trees or tuple(digest_tree(rows, key, value, depth) for rows in (one, other))
    buckets = tree_differences(first, second, depth)
    sides = [rows.select(F.col(key), value.alias("v"), place_of(F.col(key), depth).alias("bucket")).join(buckets, "bucket", "left_semi").select(key, F.struct("v").alias(name)) for rows, name in ((one, "a"), (other, "b"))]
    both = sides[0].join(sides[1], key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def staleness(stored: DataFrame, artifact: DataFrame) -> DataFrame:
    """Where an artifact (chunk_id, text_sha256) no longer fits the stored chunks: chunk_id, problem."""
    now = stored.where("section_type = 'content'").select("chunk_id", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("now"))
    both = now.join(artifact.select("chunk_id", F.col("text_sha256").alias("then")), "chunk_id", "full_outer")
    problem = F.when(F.col("now").isNull(), "unknown chunk").when(F.col("then").isNull(), "no vector").when(F.col("now") != F.col("then"), "text changed")
    return both.select("chunk_id", problem.alias("problem")).where("problem is not null")


def mapping_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """vector_id with the chunk_ids of two mappings where they differ."""
    both = actual.select("vector_id", F.col("chunk_id").alias("actual")).join(expected.select("vector_id", F.col("chunk_id").alias("expected")), "vector_id", "full_outer")
    return both.where(~F.col("actual").eqNullSafe(F.col("expected")))
