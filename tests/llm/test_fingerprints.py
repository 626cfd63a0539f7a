import hashlib

import numpy as np
import xxhash

from sheaf.llm import fingerprints as P
from tests.llm.fixtures import AWKWARD, documents, empty, texts


def test_gear_hash_by_the_book():
    data = np.frombuffer(b"content defined chunking of bytes" * 3, np.uint8)
    want, h = [], 0
    for b in data:
        h = ((h << 1) + int(P._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert P.gear_hashes(data).tolist() == want


def test_chunks_cover_the_text_within_their_sizes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        data = rng.integers(97, 123, n, np.uint8).tobytes()
        ends = P.boundaries(data)
        sizes = np.diff([0, *ends])
        assert sum(sizes) == n and (not n or (sizes[:-1] >= P.LEAST).all() and (sizes <= P.MOST).all())
    assert P.boundaries(b"a" * 1000) and max(np.diff([0, *P.boundaries(b"a" * 1000)])) <= P.MOST


def test_an_insertion_changes_few_chunks():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghij "), 6000))
    a, b = P.chunk_weights(text), P.chunk_weights(text[:3000] + "inserted" + text[3000:])
    assert P.containment(a, b) > 0.9 and P.from_string(P.to_string(a)) == a


def gear_boundaries(data):
    """Chunk ends byte by byte."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(P._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        mask = int(P._STRICT) if size < P.NORMAL else int(P._LOOSE)
        if size == P.MOST or size >= P.LEAST and h & mask == 0:
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if start < len(data) else [])


def test_boundaries_and_fingerprints_byte_by_byte():
    rng = np.random.default_rng(7)
    samples = [rng.integers(97, 123, n, np.uint8).tobytes() for n in (0, 1, 15, 16, 17, 100, 1000, 20_000)] + [b"a" * 3000, b"ab" * 700, "Grüße 好 ".encode() * 400]
    for data in samples:
        assert P.boundaries(data) == gear_boundaries(data)
        text = data.decode("utf-8", "ignore")
        own, start = {}, 0
        for end in gear_boundaries(text.encode()):
            own[f"{xxhash.xxh3_64_intdigest(text.encode()[start:end]) >> 16:012x}"] = end - start
            start = end
        assert P.to_string(P.chunk_weights(text)) == ",".join(f"{d}:{n}" for d, n in sorted(own.items()))
    a, b = {1: 10, 2: 30, 3: 60}, {2: 30, 3: 60, 9: 5}
    assert P.containment(a, b) == 0.9 and P.containment({}, {}) == 1 and P.containment({}, a) == P.containment(a, {}) == 0


def test_one_id_for_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PARTITION_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {rng.integers(0, 60)} " * int(rng.integers(1, 9))) for i in range(300)] + [(2**63 - 1, "last"), (-(2**63) + 5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r["text"]: r["h"] for r in docs.select("text", P.F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = sorted(((i, len(t), hashlib.sha256(P.edit(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)), key=str)
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in P.compare_with_next(docs).collect()), key=str)
    assert got == want
    sizes = P.ordered_ranges(docs).where("not guest").groupBy(P.F.spark_partition_id()).count().collect()
    # equal rows stay together, others of one id do not
    assert max(r["count"] for r in sizes) < 40 and len(sizes) > 15


def test_a_text_of_megabytes(spark):
    text = "Grüße an alle, content defined " * 170_000
    rows = P.compare_with_next(documents(spark, [text, "short"])).orderBy("doc_id").collect()
    assert rows[0]["n_chars"] == len(text) and rows[0]["fingerprint"] == P.to_string(P.chunk_weights(text))


def test_contract_columns(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "PARTITION_ROWS", 30)
    docs = texts(spark, sf)
    ids = sorted(docs, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = P.op1(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text, after = docs[r["doc_id"]], docs[following[r["doc_id"]]]
        changed = P.edit(text, after)
        own = P.chunk_weights(text)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == P.to_string(own) and r["edited_fingerprint"] == P.to_string(P.chunk_weights(changed))
        assert r["near_edited"] == P.containment(own, P.chunk_weights(changed)) and r["near_next"] == P.containment(own, P.chunk_weights(after))
    middle = [r["near_edited"] for r in rows if r["n_chars"] > 500]
    assert 0.4 < np.median(middle) < 0.55


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PARTITION_ROWS", 3)
    docs = documents(spark, AWKWARD, place=1, guest=True, fingerprint="clash").repartition(4)
    rows = {r["doc_id"]: r for r in P.compare_with_next(docs).collect()}
    assert len(rows) == len(AWKWARD)
    for i, text in enumerate(AWKWARD, 1):
        after = AWKWARD[i - 2] or ""
        assert rows[i]["edited_sha256"] == hashlib.sha256(P.edit(text or "", after).encode()).hexdigest()
    repeated = docs.where("doc_id > 12").union(docs.where("doc_id > 12")).union(docs.where("doc_id = 1").withColumn("doc_id", P.F.lit(None).cast("long")))
    assert P.compare_with_next(repeated).count() == 5
    assert P.compare_with_next(empty(spark)).count() == 0
    assert {r["fingerprint"] for r in P.fingerprint(documents(spark, ["same", "same"])).collect()} == {P.to_string(P.chunk_weights("same"))}
