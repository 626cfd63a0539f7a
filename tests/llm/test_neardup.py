import random
from collections import defaultdict

import numpy as np

from sheaf.llm import neardup


def brute(rows, k):
    """doc_id -> (set size, component) by comparing every pair that shares a shingle."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        if doc_id is not None:
            w = (text or "").encode().lower().split()
            sets[doc_id].append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, group in sets.items() for s in group]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {(i, len(s)): find(i) for i, s in flat}


def mutated(rng, words, rate):
    return [rng.choice("abcdefgh") * 3 + str(rng.randrange(10**6)) if rng.random() < rate else w for w in words]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", neardup.F.lit("clash"))
    return neardup.near_duplicates(frame.repartition(3), **options).collect()


def test_groups_around_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for size, length in ((60, 150), (30, 60), (12, 400), (3, 9)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        rows += [" ".join(mutated(rng, base, rng.choice((0, 0.01, 0.02, 0.04, 0.08)))) for _ in range(size)]
    passage = [f"p{i}" for i in range(60)]
    rows += [" ".join([f"x{rng.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(20)]
    rng.shuffle(rows)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(rows)]
    for k in (4, 5):
        want = brute(rows, k)
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in run(spark, rows, shingle=k)}
        assert got == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "two one"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "three words more"), (8, "three  words more"), (None, "a b c d e f"), (9, "one two"), (9, "one two"), (10, "x " * 3000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, rows, shingle=4)), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 3, 6, True), (7, 3, 6, False), (7, 1, 6, False), (8, 1, 6, False), (None, 3, None, True), (9, 1, 3, False), (9, 1, 3, False), (10, 1, 10, True)]
    assert got == sorted(want, key=str)
    assert run(spark, [(1, "x")][:0] or [(1, None)]) and neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (None, None, "z", 3)], "doc_id long, text string, node string, kept int")
    got = neardup.keep_one(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, frame.where("doc_id is null or doc_id = 1").collect()))


def test_rows_of_one_id_with_other_texts_stay(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "quite another text of six words", "z"), (2, "a b c d e f", "w"), (0, "quite another text of six words", "v"), (3, None, "n"), (3, "", "e"), (None, "a b c d e f", "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("row", neardup.F.lit(1)).withColumn("number", neardup.F.lit("clash"))
    got = neardup.keep_one(frame)
    assert got.columns == frame.columns
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (0, "quite another text of six words"), (3, ""), (None, "a b c d e f")], key=str)


def test_bayes_bound_is_the_posterior():
    needed = dict(neardup.needed_matches(112, 16, 0.8, 1e-6))
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in needed.items():
        for matches, pruned in ((m - 1, True), (m, False)):
            if matches < 0:
                continue
            dense = grid**matches * (1 - grid) ** (n - matches)
            assert (dense[grid > 0.8].sum() / dense.sum() < 1e-6) == pruned


def test_components_of_a_path(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(neardup.components(links, str(tmp_path / "c")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hot_keys_and_wide_buckets_change_nothing(spark, monkeypatch):
    from sheaf.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "MOST_HOT", 10**9)
    original = neardup.across
    monkeypatch.setattr(neardup, "across", lambda *a, **k: original(*a, **k, tile=4, wide=2))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [" ".join(mutated(rng, base, rng.choice((0, 0.01, 0.03, 0.06)))) for _ in range(70)]
    boiler = [f"b{i}" for i in range(40)]
    rows += [" ".join(boiler + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice((4, 30, 40)))]) for _ in range(60)]
    rows += [rows[0]] * 10 + [None, "", "short one"] * 4
    rows = [(i, t) for i, t in enumerate(rows)]
    want = brute(rows, 5)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in run(spark, rows)}
    assert got == want


def test_dissimilar_texts_of_one_bucket_move_in_proportion(spark, tmp_path):
    """Vertices that share one band and nothing else: no tile is made for them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    n, hashes = 3000, neardup.BANDS * neardup.ROWS
    signs = rng.integers(0, 1 << 16, (n, hashes), np.uint16)
    signs[:, :4] = 7
    active = spark.createDataFrame([(i, s.tobytes(), b"") for i, s in enumerate(signs)], "id long, signature binary, items binary")
    shared = active.select("id", F.explode(neardup.band_keys(neardup.BANDS, neardup.ROWS)).alias("key")).join(active.select(F.explode(neardup.band_keys(neardup.BANDS, neardup.ROWS)).alias("key")).groupBy("key").count().where("count > 1"), "key").select("key", "id")
    roots = spark.createDataFrame([], "id long, root long")
    folder = str(tmp_path / "wide")
    assert neardup.across(shared, roots, active, hashes, neardup.ROWS, 80, 1e-6, folder).count() == 0
    assert spark.read.parquet(f"{folder}/placed").count() == n
    # the bucket is cut by the members' other bands, which nobody shares
    assert spark.read.parquet(f"{folder}/mixed-finer").count() == 0


def test_texts_of_megabytes_and_null_ids(spark):
    long = " ".join(f"t{i}" for i in range(600_000))
    rows = [(1, long), (2, long + " more"), (3, "a b c"), (None, "a b c"), (None, long), (4, "A B  C")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in run(spark, rows)), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (None, None), (None, None), (4, 3)], key=str)


def test_a_hub_with_the_largest_id(spark, tmp_path, monkeypatch):
    """All neighbours of the largest id stand under one key after the first step."""
    from sheaf.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    links = spark.createDataFrame([(i, 5000) for i in range(1, 400)] + [(700, 701)], "a long, b long")
    got = dict(neardup.components(links, str(tmp_path / "hub")).collect())
    assert got == {**{i: 1 for i in range(1, 400)}, 5000: 1, 700: 700, 701: 700}


def signed(spark, rows):
    """Vertices with given signatures, and the buckets that several share."""
    from pyspark.sql import functions as F

    active = spark.createDataFrame([(i, s.tobytes(), items.tobytes()) for i, s, items in rows], "id long, signature binary, items binary")
    keys = active.select("id", F.explode(neardup.band_keys(neardup.BANDS, neardup.ROWS)).alias("key"))
    return active, keys.join(keys.groupBy("key").count().where("count > 1"), "key").select("key", "id")


def test_a_component_with_others_in_many_buckets_meets_them_bucket_by_bucket(spark, tmp_path):
    rng = np.random.default_rng(5)
    hashes, rows = neardup.BANDS * neardup.ROWS, []
    n, per = 60, 20
    for i in range(n):
        # pairs of members of one component, each with a band of its own that a few others share
        own = rng.integers(0, 1 << 16, hashes).astype(np.uint16)
        items = np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64))
        mate = rng.integers(0, 1 << 16, hashes).astype(np.uint16)
        mate[:4] = own[:4]
        rows += [(i, own, items), (500 + i, mate, np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64)))]
        for k in range(per):
            other = rng.integers(0, 1 << 16, hashes).astype(np.uint16)
            other[:4] = own[:4]
            # the first of each is truly like its member
            rows.append((1000 + i * per + k, own if k == 0 else other, items if k == 0 else np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64))))
    active, shared = signed(spark, rows)
    roots = spark.createDataFrame([(i + k, 0) for i in range(n) for k in (0, 500)], "id long, root long")
    for wide in (100, 10_000):
        folder = str(tmp_path / str(wide))
        found = neardup.across(shared, roots, active, hashes, neardup.ROWS, 80, 1e-6, folder, wide=wide)
        pairs = {frozenset(p) for p in found.collect()}
        assert pairs == {frozenset((i, 1000 + i * per)) for i in range(n)}
        # by bucket a member meets the others of its own, not those of all buckets
        most = spark.read.parquet(f"{folder}/inner").groupBy("major").count().agg({"count": "max"}).first()[0]
        assert most == (2 if wide == 100 else 2 * n)


def test_a_pair_that_shares_a_wide_bucket_alone_is_found(spark, tmp_path):
    rng = np.random.default_rng(11)
    n, hashes = 60, neardup.BANDS * neardup.ROWS
    signs = rng.integers(0, 1 << 16, (n, hashes), np.uint16)
    signs[:, : neardup.ROWS] = 7
    # two of them agree in three rows of every band and in one whole band
    signs[1] = np.where(np.arange(hashes) % neardup.ROWS < neardup.ROWS - 1, signs[0], signs[1])
    signs[1, : neardup.ROWS] = 7
    common = np.arange(1, 9, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(1 << 20, 1 << 62, 32).astype(np.uint64)])) for _ in range(n)]
    sets[1] = np.sort(np.concatenate([sets[0][:-2], rng.integers(1 << 20, 1 << 62, 2).astype(np.uint64)]))
    active, shared = signed(spark, list(zip(range(n), signs, sets, strict=True)))
    assert shared.select("key").distinct().count() == 1
    roots = spark.createDataFrame([], "id long, root long")
    found = neardup.across(shared, roots, active, hashes, neardup.ROWS, 80, 1e-6, str(tmp_path / "alone"), wide=5)
    assert [frozenset(r) for r in found.collect()] == [frozenset((0, 1))]
    # common shingles are among the most frequent, so they make no bucket
    assert spark.read.parquet(str(tmp_path / "alone/finer")).select("id").distinct().count() == 2


def test_rarest_shingles_lose_no_pair(spark, tmp_path):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(1, 40), rng.randrange(1, 30))) for _ in range(40)]
    sets += [sorted({*s[1:], rng.randrange(1, 40)}) for s in sets]
    members = spark.createDataFrame([(i, i, np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)], "id long, root long, items binary")
    by = {}
    for r in neardup.rarest(members, 80, str(tmp_path / "r")).collect():
        by.setdefault(r["key"], set()).add(r["id"])
    met = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert near and near <= met
