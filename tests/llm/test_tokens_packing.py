import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import packing, tokens
from tests.llm.fixtures import AWKWARD, documents, empty, texts


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(tokens.default_tokenizer())


def plain(coder, text):
    return [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_units_give_the_ids_of_whole_texts(coder):
    rng = random.Random(5)
    pieces = ["a", "B", "é", ".", ",", "\n", " ", "  ", "'s", "1", "*", "\t", "\x01", "́", "好", "<|endoftext|>", " ", "\x1c", "word"]
    every = [t or "" for t in AWKWARD] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for at in range(0, len(every), 300):
        part = every[at : at + 300]
        ids, offsets = coder.encode(part)
        for i, text in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == plain(coder, text), text


def test_shards_round_trip(spark, sf, coder):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op3(spark, sf).collect())
    at, want = 0, []
    for doc_id, text in sorted(texts(spark, sf).items()):
        ids = np.array(plain(coder, text), "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_starts_of_many_files(spark):
    rows = [(i % 37, i % 37, (i * 7) % 11) for i in range(500) if i % 37 != 5]
    index = spark.createDataFrame(rows, "doc_id long, shard int, n_tokens long").repartition(3)
    sums = {}
    for _, shard, n in rows:
        sums[shard] = sums.get(shard, 0) + n
    want = {s: sum(n for t, n in sums.items() if t < s) for s in sums}
    for block in (1, 4, 1000):
        assert dict(tokens.shard_starts(index, block).collect()) == want
    assert tokens.shard_starts(index.limit(0)).count() == 0


def test_shards_of_awkward_rows(spark, tmp_path, coder):
    docs = documents(spark, AWKWARD, shard=7, file="clash").withColumn("doc_id", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 5, 4).otherwise(F.col("doc_id"))).repartition(3)
    got = tokens.read_shards(tokens.write_shards(docs, str(tmp_path / "s"), length=16, batch_sequences=4), 4).collect()
    assert len(got) == len(AWKWARD)
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert min(got, key=lambda r: r["start"])["doc_id"] is None
    assert tokens.read_shards(tokens.write_shards(empty(spark), str(tmp_path / "e"))).count() == 0


def test_sequences_are_views_of_the_file(tmp_path):
    path = str(tmp_path / "one.arrow")
    with open(path, "wb") as sink:
        writer = tokens.ShardWriter(sink, np.dtype(np.uint16), 8, 3)
        for n in (5, 30, 20, 2):
            writer.add(np.arange(n))
        writer.close()
    reader = tokens.ShardReader(f"file://{path}", 3)
    want = np.concatenate([np.arange(n) for n in (5, 30, 20, 2)])
    assert reader.ids(3, 50).tolist() == want[3:53].tolist()
    ids, mask = reader.sequence(7)
    assert ids.tolist() == [*want[56:].tolist(), *[0] * 7] and reader.unpack(mask).tolist() == [True, *[False] * 7]
    assert not any(x.flags.owndata for i in (0, 4, 7) for x in (*reader.batch(i // 3), *reader.sequence(i)))


def check_pieces(rows, sizes, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(sizes)
    for doc_id, spans in by_doc.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == sizes[doc_id]
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0  # whole, or a power of two that needs no padding


def test_packing(spark, sf, coder):
    rows = packing.op5(spark, sf).collect()
    ids = {i: plain(coder, t) for i, t in texts(spark, sf).items()}
    check_pieces(rows, {i: len(x) for i, x in ids.items()})
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_packing_of_awkward_rows(spark, coder):
    docs = documents(spark, AWKWARD, start=1, length="clash").repartition(3)
    check_pieces(packing.pack(docs, capacity=64, block_sequences=4).collect(), {i: len(plain(coder, t or "")) for i, t in enumerate(AWKWARD, 1)}, 64)
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize(("partitions", "fan"), [(32, 64), (211, 64), (211, 5)])
def test_rests_of_partitions_are_packed_together(spark, sf, coder, partitions, fan):
    frame = spark.read.parquet(f"{sf}/documents.parquet").repartition(partitions)
    rows = packing.pack(frame, fan=fan).collect()
    check_pieces(rows, {i: len(plain(coder, t)) for i, t in texts(spark, sf).items()})
    sums = {}
    for r in rows:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    short = [n for n in sums.values() if n < 1024]
    # one run of short sequences in all: the bits of one number under 1024
    assert len(short) == len(set(short)) <= 10 and sum(n for n in sums.values()) // 1024 == len(sums) - len(short)


def test_packing_of_null_and_repeated_ids_and_megabytes(spark, coder):
    every = ["same text", "same text", None, "", "Grüße an alle " * 350_000]
    docs = documents(spark, every).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id"))).withColumn("ids", F.lit(1)).repartition(3)
    rows = packing.pack(docs).collect()
    sizes = [len(plain(coder, t or "")) for t in every]
    assert sum(r["length"] for r in rows) == sum(sizes)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == sum(sizes[i] for i in (0, 1, 3))
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == sizes[4] and all(r["doc_tokens"] == sizes[4] for r in rows if r["doc_id"] == 5)


def test_a_block_balances_cost():
    rng = random.Random(1)
    pieces = [(i, 0, rng.randint(1, 63)) for i in range(400)]
    n = sum(p[2] for p in pieces) // 64
    filled, rest = packing.pack_block(pieces, 64, n)
    assert all(sum(p[2] for p in s) == 64 for s in filled)
    assert sum(p[2] for p in rest) == sum(p[2] for p in pieces) - 64 * n
    cost = [sum(p[2] ** 2 for p in s) for s in filled]
    dealt = [sum(p[2] ** 2 for p in pieces[i::n]) for i in range(n)]
    assert np.std(cost) < np.std(dealt)
