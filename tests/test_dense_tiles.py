"""Tiles of a search: how often a vector is copied, and results as plain Python's."""

import numpy as np
from pyspark.sql import functions as F

from sheaf.operators import dense


def test_copies_of_vectors_grow_with_tiles_of_many_queries(spark, monkeypatch):
    made = []
    real = dense._tiles
    monkeypatch.setattr(dense, "_tiles", lambda v, q, k, rows, columns: made.append((rows, columns)) or real(v, q, k, rows, columns))
    monkeypatch.setattr(dense, "_pass", lambda *a: 1 / 0)
    vectors = spark.range(20_000).select(F.col("id").alias("vector_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    dense.search(vectors, vectors.select(F.col("vector_id").alias("qid"), "embedding"), 1)
    assert made == [(2, 1)]


def test_bettered_equals_sorting_all(monkeypatch):
    monkeypatch.setattr(dense, "SCORED_QUERIES", 3)
    rng = np.random.default_rng(1)
    wanted, vectors = rng.integers(-3, 4, (8, 4)).astype(float), rng.integers(-3, 4, (50, 4)).astype(float)
    numbers = rng.permutation(50).astype(np.int64)
    best, names = np.zeros((8, 0)), np.zeros((8, 0), np.int64)
    for at in range(0, 50, 4):
        best, names = dense.bettered(best, names, wanted, vectors[at : at + 4], numbers[at : at + 4], 6)
    scores = wanted @ vectors.T
    for i in range(8):
        order = np.lexsort((numbers, -scores[i]))[:6]
        assert names[i].tolist() == numbers[order].tolist() and best[i].tolist() == scores[i][order].tolist()
