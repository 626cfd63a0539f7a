"""Operator 13 against numpy over all rows at once, and awkward vectors."""

import math

import numpy as np
import pytest

from sheaf.llm import queries, whitening
from tests.llm.fixtures import table


def frame(spark, vectors, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(vectors)), vectors, strict=True)), "vec_id long, embedding array<double>")


def by_the_book(vectors, steps=64, components=16):
    """Per usable vector: deviation and whitened components; n and the shares, all in one process."""
    x = [[math.floor(steps * c) + 1_000_000 for c in v] for v in vectors]
    once = sorted(set(map(tuple, x)))
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in once])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    white = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x]) @ axes / np.sqrt(values)
    return n, deviation, white, values / np.trace(centred.T @ centred / n)


def test_query_equals_numpy(spark, sf):
    stored = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect())
    n, deviation, white, shares = by_the_book([v for _, v in stored])
    got = {}
    for r in queries.QUERIES["op13_whitening"](spark, sf).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == {i for i, _ in stored} and all(set(g) == set(range(1, 17)) for g in got.values())
    assert all(r["n"] == n and r["identity_error"] <= 1e-9 for g in got.values() for r in g.values())
    for k in range(16):
        mine = np.array([got[i][k + 1]["whitened"] for i, _ in stored])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine, sign * white[:, k], atol=1e-6)
        assert got[stored[0][0]][k + 1]["explained"] == pytest.approx(shares[k], rel=1e-9)
    assert [got[i][1]["deviation"] for i, _ in stored] == deviation


def test_copies_count_once_and_bad_vectors_are_dropped(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 3)).tolist()
    odd = [None, [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0], [], [1.0] * 2]
    rows = frame(spark, base + [base[0]] * 200 + odd, [*range(239), None, *range(240, 246)]).repartition(7)
    model = whitening.fit(rows)
    n, deviation, white, shares = by_the_book(base, components=3)
    assert model.n == n == 40 and model.rank == 3 and model.identity_error < 1e-9
    out = whitening.whiten(rows, model).collect()
    assert len(out) == 240 * 3 and sum(r["vec_id"] is None for r in out) == 3
    assert sorted({r["deviation"] for r in out}) == sorted(set(deviation))
    assert np.allclose([r["explained"] for r in sorted(out, key=lambda r: (r["vec_id"] or -1, r["component"])) if r["vec_id"] == 5], shares)


def test_merging_equals_one_pass():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (1000, 5)) + 10**6
    whole = whitening.moments(x)
    parts = [whitening.moments(p) for p in np.split(x, [1, 10, 400, 401])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == whole.n and merged.sums == whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-12, atol=1e-6)
    assert np.allclose(merged.scatter / 1000, np.cov(x.T, bias=True))


def test_packing_is_exact_and_told_apart_by_width():
    x = np.array([[0, -1, 32767], [-32768, 5, 6], [32768, 0, 0], [2**40, -(2**62), 1], [0, 0, 0]])
    packed = whitening.pack(x)
    assert (whitening.unpack(packed) == x).all() and [p[0] for p in packed] == [0, 0, 1, 2, 0]


def test_no_rows_one_row_and_huge_values(spark):
    empty = frame(spark, [])
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    one = frame(spark, [[1.0, 2.0]] * 3)
    rows = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(rows) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in rows)
    huge = frame(spark, [[1e300, 0.0], [-1e300, 1.0], [0.5, 3.0]])
    model = whitening.fit(huge)
    rows = whitening.whiten(huge, model).collect()
    assert len(rows) == 6 and any(r["deviation"] is None for r in rows) and all(r["whitened"] is None or math.isfinite(r["whitened"]) for r in rows)


def test_extra_columns_and_other_names(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, np.eye(4).tolist()).withColumnsRenamed({"vec_id": "name", "embedding": "v"}).withColumns({"n": F.lit(1), "component": F.lit("x"), "key": F.lit(2), "vector": F.lit(None)})
    model = whitening.fit(rows, "v", components=2)
    out = whitening.whiten(rows, model, "name", "v")
    assert out.columns == ["name", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 8
