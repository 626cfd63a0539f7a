"""MinHash near-duplicate detection with sequential Bayesian verification.

1.  Every text becomes its set of word shingles (64-bit hashes), a digest of the set, and a
    MinHash signature.  Texts with equal sets are one vertex, named by their smallest doc_id,
    so copies never meet in pairs.
2.  Signatures are cut into bands; vertices with an equal band share a bucket.  The member of
    a bucket that shares most buckets, over all bands, is its pivot: the text that a group of
    near copies stems from.  Every other member is paired with it (linear in the bucket).
3.  Pairs are verified: the signatures are compared batch by batch and a pair is pruned as soon
    as the posterior probability of reaching the threshold falls below ``miss``; survivors are
    verified exactly on the full sets.  Links are closed to components.
4.  Where members of a bucket then lie in several components, those outside its largest one
    are compared with that component's members and with each other, verified likewise.  This
    runs in tiles of bounded size.  A first pass has signatures only and names the vertices
    with a partner that no batch prunes; full sets go to these alone, and of them a tile gives
    only links that join what was apart before.  A bucket with very many members outside its
    largest component is cut first, exactly: by each member's rarest shingles, so many of them
    that two sets which share none of these can't be similar enough.  Then components are
    closed again.

With these bands (28 of 4 rows) a pair at similarity 0.8 shares no bucket with probability
4e-7, at 0.9 with 1e-13; the Bayesian test loses less than ``miss`` more.

No join brings a hot key to one task: rows of keys with very many rows (at most MOST_HOT keys)
meet a broadcast copy of the key's one light row, and full sets of pivots are dealt under salts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import SALTS, HashCache, gram_hashes, hot_keys, materialize, mix, salted_join, shared_dir, small_batches, space_words, spread_join, text_of, trimmed
from sheaf.operators.dense import number_rows

SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS = 28, 4
BATCH, MISS = 16, 1e-6
#: Members of a component that one tile compares with at most as many others.
TILE = 128
#: A bucket is cut by its members' rarest shingles when more of its members than this lie outside its largest component:
#: tiles would then hold more copies of a member than there are bands.
WIDE = BANDS // 2 * TILE
#: Rows and bytes of an Arrow batch, about; rows with full sets are large.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_CACHE = HashCache()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    words = _CACHE.array(space_words(text))
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return mix(gram_hashes(words, len(words)) + np.uint64(k - len(words)))
    return np.unique(gram_hashes(words, k))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n].astype(np.uint32) | np.uint32(1))[:, None], seeds[n:].astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The MinHash signature: for each of n permutations of 32-bit values the smallest one, folded to 16 bits.

    Two different minima agree in 16 bits once in 65,536 times, which only adds candidates.
    """
    small = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(factors[0]), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(low, (small[at : at + 2048] * factors[0] + factors[1]).min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def needed_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is pruned) for each batch.

    With a uniform prior the posterior of the similarity after m of n matches is
    Beta(m + 1, n - m + 1); a pair is pruned when its mass above the threshold is under ``miss``.
    """
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        # P(Beta(m + 1, n - m + 1) > t) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, -1
        while m < n:
            p = math.exp(math.lgamma(n + 2) - math.lgamma(m + 2) - math.lgamma(n + 1 - m) + (m + 1) * math.log(threshold) + (n - m) * math.log(1 - threshold))
            if total + p >= miss:
                break
            total, m = total + p, m + 1
        out.append((n, m + 1))
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Of pairs of signatures (rows of a and b) the numbers of those that no batch prunes."""
    left, matches, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in needed:
        matches += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        fine = matches >= least
        left, matches, before = left[fine], matches[fine], n
    return left


def nodes(docs: DataFrame, shingle: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null for an empty one), signature."""
    factors = _multipliers(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signs = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle)
                counts.append(len(found))
                keys.append(digest(found) if len(found) else None)
                signs.append(signature(found, factors).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "node", "signature"])

    return text_of(docs).mapInArrow(trimmed(run), "doc_id long, n_shingles long, node binary, signature binary")


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def with_sets(vertices: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """id, signature and full set of the vertices (id) that share a bucket with others."""
    wanted = reps.join(vertices, "id").select("id", "node", "signature")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
                found = shingle_set(text.as_py(), shingle)
                if len(found) and digest(found) == node:
                    keep.append(i)
                    out.append(found.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("node"), rows.column("signature"), pa.array(out, pa.binary())], names=["id", "node", "signature", "items"])

    texts = text_of(docs)
    full = wanted.join(texts, wanted["id"] == texts["doc_id"]).select("id", "node", "signature", "text")
    if repeated:
        # of equal rows of one doc_id one is enough
        full = full.dropDuplicates()
    full = full.mapInArrow(trimmed(sets), "id long, node binary, signature binary, items binary")
    # rows of one doc_id and one set are one
    return (full.dropDuplicates(["id", "node"]) if repeated else full).drop("node")


def _signatures(column, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hashes)


def verify(pairs: DataFrame, active: DataFrame, hashes: int, percent: int, miss: float) -> DataFrame:
    """Of the pairs (p, m), links (a, b) that pass the Bayesian test and then the exact one.

    A vertex may be ``p``, the pivot, of very many pairs: those of hot pivots are dealt under
    salts, each with a copy of the pivot's row.  Full sets move for survivors of the first test.
    """
    needed = needed_matches(hashes, BATCH, percent / 100, miss)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = survivors(_signatures(batch.column("sp"), hashes), _signatures(batch.column("sm"), hashes), needed) if batch.num_rows else []
            yield batch.select(["p", "m", "salt"]).take(pa.array(left, pa.int64()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xp, xm = batch.column("xp"), batch.column("xm")
            fine = [i for i in range(batch.num_rows) if similar(np.frombuffer(xp[i].as_py(), np.uint64), np.frombuffer(xm[i].as_py(), np.uint64), percent)]
            yield batch.select(["p", "m"]).take(pa.array(fine, pa.int64()))

    hot = hot_keys(pairs.groupBy("p").agg(F.count("*").alias("n")), "p", pairs.count())

    def parted(frame: DataFrame) -> DataFrame:
        if hot is None:
            return frame.withColumn("parts", F.lit(1))
        return frame.join(F.broadcast(hot.withColumn("parts", F.lit(SALTS))), "p", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def sides(column: str, short: str) -> tuple[DataFrame, DataFrame]:
        own = parted(active.select(F.col("id").alias("p"), F.col(column).alias(f"{short}p")))
        pivots = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
        return pivots, active.select(F.col("id").alias("m"), F.col(column).alias(f"{short}m"))

    salted = parted(pairs).withColumn("salt", F.pmod(F.xxhash64("m"), F.col("parts"))).drop("parts")
    pivots, members = sides("signature", "s")
    first = salted.join(members, "m").join(pivots, ["p", "salt"]).select("p", "m", "salt", "sp", "sm").mapInArrow(trimmed(likely), "p long, m long, salt long")
    pivots, members = sides("items", "x")
    second = first.join(members, "m").join(pivots, ["p", "salt"]).select("p", "m", "xp", "xm").mapInArrow(trimmed(exact), "p long, m long")
    return second.select(F.least("p", "m").alias("a"), F.greatest("p", "m").alias("b"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """id -> root, the smallest id of its component, for all vertices with links (a, b).

    Alternates two contractions until nothing changes: every vertex's larger neighbours are tied
    to its smallest one, then its smaller neighbours and itself.  Each step is a grouped
    minimum (combined before the shuffle) and a join; rounds grow with the logarithm of the
    longest path.  Every round is written, so lineage stays short.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{folder}/edges0")
    turn = 0
    while True:
        turn += 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = hot_keys(least, "u", 2 * edges.count())
        large = spread_join(both, least.select("u", F.least("u", "m").alias("m")), "u", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{folder}/large{turn}")
        # the largest id of a group may have one smaller neighbour for each other member
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, lower.select("u", "m"), "u", hot_keys(lower, "u", large.count())).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        following = materialize(small, f"{folder}/edges{turn}")
        # done when the edges are stars already: no vertex is both a root and a member
        if following.select("u").join(following.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0 and following.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        edges = following
    return following.select(F.col("u").alias("id"), F.col("v").alias("root")).union(following.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mixed(placed: DataFrame) -> DataFrame:
    """key, major (root of its largest part), n, outs (members outside it) of the buckets with members of several components."""
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    return whole.where("roots > 1").select("key", F.col("most.root").alias("major"), "n", (F.col("n") - F.col("most.n")).alias("outs"))


def rarest(members: DataFrame, percent: int, folder: str) -> DataFrame:
    """key, id, root: buckets of the members (id, root, items) that share one of their rarest shingles.

    Of n shingles, in one order for all, the rarest first, all but the ceil(percent * n / 100) - 1
    most frequent are taken.  Two sets with percent * union <= 100 * intersection share a shingle
    among those taken of both, so no similar pair is lost.  Shingles of one member only come
    first and make no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column("items")[i].as_py(), np.int64)
                one = lambda value, n=len(found): pa.array(np.full(n, value), pa.int64())
                yield pa.RecordBatch.from_arrays([one(batch.column(c)[i].as_py()) for c in ("id", "root", "part")] + [one(len(found)), pa.array(found)], names=["id", "root", "part", "size", "shingle"])

    # a repeated id may have several sets
    each = materialize(members.withColumn("part", F.xxhash64("items")).mapInArrow(trimmed(run), "id long, root long, part long, size long, shingle long"), f"{folder}/wide-shingles")
    counts = materialize(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/wide-counts")
    met = spread_join(each, counts, "shingle", hot_keys(counts, "shingle", each.count()))
    own = Window.partitionBy("id", "part")
    placed = met.withColumn("place", F.row_number().over(own.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(own))
    return placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).select(F.xxhash64("shingle").alias("key"), "id", "root").distinct()


def across(shared: DataFrame, roots: DataFrame, active: DataFrame, hashes: int, rows: int, percent: int, miss: float, folder: str, tile: int = TILE, wide: int = WIDE) -> DataFrame:
    """Links between components that have members in one bucket.

    ``shared``: key, id of every bucket with several members.  For each bucket with several
    components its members outside the largest are compared with all of that component and
    with each other; a component with more than ``wide`` such others, in all its buckets
    together, has only its members in the bucket compared.  Tiles of at most ``tile`` by ``tile`` vertices hold a part of both sides.
    """
    needed = needed_matches(hashes, BATCH, percent / 100, miss)
    placed = materialize(shared.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), f"{folder}/placed")
    mixed = materialize(_mixed(placed), f"{folder}/mixed")
    total = placed.count()
    cut = mixed.where(F.col("outs") > wide)
    if cut.limit(1).count():
        members = spread_join(placed, cut.select("key"), "key", hot_keys(cut, "key", total)).select("id", "root").distinct()
        finer = rarest(members.join(active.select("id", "items"), "id"), percent, folder)
        kept = spread_join(placed, mixed.where(F.col("outs") <= wide).select("key"), "key", hot_keys(mixed, "key", total))
        placed = materialize(kept.select("key", "id", "root").unionByName(finer), f"{folder}/finer")
        mixed = materialize(_mixed(placed), f"{folder}/mixed-finer")
        total = placed.count()
    within = materialize(spread_join(placed, mixed.select("key", "major"), "key", hot_keys(mixed, "key", total)), f"{folder}/within")
    outs = within.where("root != major")
    majors = materialize(outs.select("major", "id").distinct().groupBy("major").agg((F.count("*") > wide).alias("many")), f"{folder}/majors")
    # a component that meets very many others, a few in each bucket, meets them bucket by bucket
    unit = F.when(F.col("many"), F.xxhash64("key", "major")).otherwise(F.col("major")).alias("major")
    outer = salted_join(outs, majors, "major", ("id", "key")).select(unit, "id", "root").distinct()
    members = placed.select("id", "root").distinct()
    heavy = hot_keys(members.groupBy("root").agg(F.count("*").alias("n")), "root", total)
    whole = spread_join(members, majors.where("NOT many").select(F.col("major").alias("root")), "root", heavy).select(F.col("root").alias("major"), "id", "root")
    parts = salted_join(within.where("root = major"), majors.where("many"), "major", ("id", "key")).select(unit, "id", "root").distinct()
    outer = materialize(outer, f"{folder}/outer")
    inner = materialize(whole.union(parts), f"{folder}/inner")
    majors = outer.groupBy("major").agg(F.count("*").alias("outs"))
    counts = inner.groupBy("major").agg(F.count("*").alias("ins")).join(majors, "major")
    counts = counts.select("major", F.ceil((F.col("ins") + F.col("outs")) / tile).cast("int").alias("blocks"), F.ceil(F.col("outs") / tile).cast("int").alias("chunks"))
    some = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = inner.withColumn("outer", F.lit(False)).union(outer.withColumn("outer", F.lit(True)))
    # one component may have most members
    sides = salted_join(both, counts, "major", ("id",))
    place = F.struct("major", "i", "j")
    members = sides.withColumn("i", some("blocks", 0)).select("major", "i", every("chunks").alias("j"), F.lit(False).alias("outer"), "id", "root")
    outers = sides.where("outer").withColumn("j", some("chunks", 1)).select("major", every("blocks").alias("i"), "j", "outer", "id", "root")
    tiles = members.union(outers).select(place.alias("tile"), "outer", "id", "root")

    def sides_of(group: list[dict]) -> tuple[list[dict], list[dict], np.ndarray, np.ndarray, np.ndarray]:
        a, b = ([r for r in group if r["outer"] == x] for x in (True, False))
        sa, sb = (np.frombuffer(b"".join(r["signature"] for r in x), np.uint16).reshape(-1, hashes) for x in (a, b))
        return a, b, sa, sb, np.array([r["root"] for r in b], np.int64)

    def likely(group: list[dict]) -> list[dict]:
        """The rows with a partner, in another component, that no batch of signatures prunes."""
        a, b, sa, sb, rb = sides_of(group)
        out, met = [], np.zeros(len(b), bool)
        for x, row in enumerate(a):
            others = np.flatnonzero(rb != row["root"])
            left = others[survivors(np.broadcast_to(sa[x], (len(others), hashes)), sb[others], needed)]
            met[left] = True
            if len(left):
                out.append(row)
        return out + [b[y] for y in np.flatnonzero(met).tolist()]

    def links(group: list[dict]) -> list[dict]:
        """Exact links that join what the tile has not joined yet."""
        a, b, sa, sb, rb = sides_of(group)
        names = {r["root"]: r["root"] for r in group}

        def root(x: int) -> int:
            while names[x] != x:
                names[x] = x = names[names[x]]
            return x

        sets_b = [np.frombuffer(r["items"], np.uint64) for r in b]
        found = []
        for x, row in enumerate(a):
            others = np.flatnonzero(rb != row["root"])
            items = np.frombuffer(row["items"], np.uint64)
            for y in others[survivors(np.broadcast_to(sa[x], (len(others), hashes)), sb[others], needed)].tolist():
                ra, rother = root(row["root"]), root(b[y]["root"])
                if ra != rother and similar(items, sets_b[y], percent):
                    found.append({"a": row["id"], "b": b[y]["id"]})
                    names[ra] = rother
        return found

    def by_tile(frame: DataFrame, judge, schema: pa.Schema, ddl: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, group = None, []
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if row["tile"] != here:
                        out += judge(group)
                        here, group = row["tile"], []
                    group.append(row)
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in out], schema)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in judge(group)], schema)

        return frame.repartition("tile").sortWithinPartitions("tile").mapInArrow(trimmed(run), ddl)

    # the planner does not know how many rows the copies are, so it must not take them for few
    light = tiles.hint("merge").join(active.select("id", "signature"), "id")
    spot = pa.struct([("major", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])
    near = by_tile(light, likely, pa.schema([("tile", spot), ("outer", pa.bool_()), ("id", pa.int64()), ("root", pa.int64())]), "tile struct<major:long,i:int,j:int>, outer boolean, id long, root long")
    near = materialize(near, f"{folder}/near")
    return by_tile(near.join(active, "id"), links, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def band_keys(bands: int, rows: int):
    """The bucket keys of a signature, one a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * 2 * rows + 1, F.lit(2 * rows))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    A text without words (or null) has an empty set and is linked with nothing.  Rows with one
    doc_id are one document: they take the smallest component_id of any of them.  Rows with a
    null doc_id are linked with nothing, and have a null component_id and kept true.  Texts of
    any length count whole; other columns are left out; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return _near_duplicates(docs, shingle, percent, bands, rows, miss, folder or shared_dir(docs.sparkSession))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, miss: float, folder: str) -> DataFrame:
    hashes = bands * rows
    all_nodes = materialize(nodes(docs, shingle, hashes), f"{folder}/nodes")
    named = all_nodes.where("doc_id is not null and node is not null")
    reps = materialize(named.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("n")), f"{folder}/reps")
    vertices = reps.count()
    buckets = reps.select("id", F.explode(band_keys(bands, rows)).alias("key"))
    sizes = materialize(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/sizes")
    hot = hot_keys(sizes, "key", bands * vertices)
    shared = materialize(spread_join(buckets, sizes, "key", hot), f"{folder}/shared")
    degrees = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    repeated = bool(named.groupBy("doc_id").count().where("count > 1").limit(1).count())
    active = materialize(with_sets(degrees.select("id"), reps, docs, shingle, repeated), f"{folder}/active")
    pivots = shared.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("most")).select("key", F.col("most.id").alias("pivot"))
    pivots = materialize(pivots, f"{folder}/pivots")
    stars = materialize(spread_join(shared, pivots, "key", hot).where("id != pivot").select(F.col("pivot").alias("p"), F.col("id").alias("m")).distinct(), f"{folder}/stars")
    links = verify(stars, active, hashes, percent, miss)
    if repeated:
        # the sets of a doc_id that has several belong together
        several = named.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("doc_id")
        same = named.join(several, "doc_id").join(reps.select("node", "id"), "node").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a != b").distinct()
        links = links.union(same)
    roots = materialize(components(links, f"{folder}/first"), f"{folder}/roots")
    more = across(shared.select("key", "id"), roots, active, hashes, rows, percent, miss, folder)
    final = materialize(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), f"{folder}/second"), f"{folder}/final")
    where = reps.select("node", "id").join(final, "id", "left").select("node", F.coalesce("root", "id").alias("component_id"))
    # very many copies share a node; rows without one meet no one
    found = spread_join(named.select("doc_id", "n_shingles", "node"), where, "node", hot_keys(reps, "node", all_nodes.count()))
    alone = all_nodes.where("doc_id is null or node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group left, with their own columns.

    Rows that share doc_id and text are one document, and one of them stays if it is kept; rows
    that share a doc_id but not the text are documents of their own (null: empty).  Of a group
    the smallest doc_id stays.  Rows with a null doc_id all stay; an empty table gives no rows.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        verdict = near_duplicates(named, **options).where("kept").select("doc_id")
        return named.join(verdict, "doc_id", "left_semi").select(*own).unionByName(unnamed)
    # documents are numbered in order of id and text's digest
    keyed = named.select(F.struct(*own).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    once = keyed.groupBy("doc_id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"), F.first("text").alias("text"))
    numbered = number_rows(once, "doc_id", "digest", name="number")
    verdict = near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), **options).where("kept").select(F.col("doc_id").alias("number"))
    kept = numbered.join(verdict, "number", "left_semi")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)).unionByName(unnamed)


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least_reached AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id, s.doc_id <= coalesce(l.y, s.doc_id) AS kept
FROM sets s LEFT JOIN least_reached l ON l.x = s.doc_id
"""
