"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of the text; a chunk ends where masked bits of the hash are
zero, with a strict mask before the normal chunk size and a loose one after it, so sizes stay
near normal and boundaries depend on nearby content only.  The fingerprint is the set of chunk
digests, each with the chunk's length as its weight: an insertion or a move changes the chunks
around it and no others.  Containment of one fingerprint in another is the weight of the
digests they share over the weight of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import mix, text_of, trimmed

#: Chunk sizes in bytes.
LEAST, NORMAL, MOST = 16, 48, 256
STRICT_BITS, LOOSE_BITS = 6, 4
#: Rows that one partition of the ordered pass should hold at most, and most partitions.
PARTITION_ROWS, MOST_PARTITIONS = 4_000, 20_000

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """hash[i] = (hash[i - 1] << 1) + gear[byte i] in 32 bits, so of the last 32 bytes; by doubling."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks of the data, the last one its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = (h[loose] & _STRICT == 0).tolist()
    ends, start = [], 0
    for at, hard in zip((loose + 1).tolist(), strict, strict=True):
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= NORMAL or hard and at - start >= LEAST:
            ends.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(text: str) -> dict[int, int]:
    """Digest (48 bits) -> length of each distinct chunk of the text."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data):
        out[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return out


def to_string(weights: dict[int, int]) -> str:
    """``digest:length`` (digest in 12 hex digits) sorted by digest, comma-joined."""
    return ",".join([f"{d:012x}:{n}" for d, n in sorted(weights.items())])


def from_string(fingerprint: str) -> dict[int, int]:
    return {int(x[:12], 16): int(x[13:]) for x in fingerprint.split(",") if x}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's weight that is in b; of two empty fingerprints 1, of one empty 0."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([to_string(chunk_weights(t)) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


class Ranges:
    """Ranges of descending doc_id; an id with more rows than ``limit`` has ranges of its own, cut by the texts' hashes."""

    def __init__(self, cuts: list[int], hot: dict[int, int], limit: int):
        edges = {*cuts, *hot, *(i + 1 for i in hot if i < 2**63 - 1)}
        self.cuts = np.array(sorted(edges), np.int64)
        self.parts = np.ones(len(self.cuts) + 1, np.int64)  # by plain range, the largest ids first
        for doc_id, n in hot.items():
            self.parts[self.plain(np.array([doc_id], np.int64))[0]] = -(-n // limit)
        self.before = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def plain(self, ids: np.ndarray) -> np.ndarray:
        return len(self.cuts) - np.searchsorted(self.cuts, ids, side="right")

    def places(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = self.plain(ids)
        high = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return self.before[at] + (high * self.parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def ordered_ranges(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of descending doc_id, each followed by a copy of the row after its last.

    Columns place (range), guest (the copied row), doc_id, h, text; partition ``place`` holds its
    rows in order: descending doc_id, null ids last, equal ids by a hash of the text, then the
    guests, of which the first counts.  After the last document comes the first.  The driver
    gets the ranges' limits, the ids with more rows than a range should hold and the ranges'
    first rows' keys, as many as partitions at most, never as documents.
    """
    low = -(2**63)
    frame = text_of(docs).withColumn("h", F.xxhash64("text"))
    total = frame.count()
    parts = min(MOST_PARTITIONS, max(1, -(-total // PARTITION_ROWS)))
    limit = max(PARTITION_ROWS, -(-total // MOST_PARTITIONS))
    cuts = frame.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    counts = frame.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect() if parts > 1 else []
    ranges = Ranges([int(x) for x in cuts], {low if r["doc_id"] is None else r["doc_id"]: r["n"] for r in counts}, limit)

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("doc_id").fill_null(low).to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids, hashes = keys(batch)
            for place, doc_id, h in zip(ranges.places(ids, hashes).tolist(), ids.tolist(), hashes.tolist(), strict=True):
                first[place] = max(first.get(place, (low, low)), (doc_id, ~h))
        yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int32()), *(pa.array([v[i] for v in first.values()], pa.int64()) for i in (0, 1))], names=["place", "most", "least"])

    leads = frame.select("doc_id", "h").mapInArrow(top, "place int, most long, least long").groupBy("place").agg(F.max(F.struct("most", "least")).alias("lead")).collect()
    firsts = {r["place"]: (r["lead"]["most"], ~r["lead"]["least"]) for r in leads}
    used = np.array(sorted(firsts), np.int64)
    lead_id, lead_h = (np.array([firsts[p][i] for p in used.tolist()], np.int64) for i in (0, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = keys(batch)
            at = np.searchsorted(used, ranges.places(ids, hashes))
            leading = np.flatnonzero((ids == lead_id[at]) & (hashes == lead_h[at])) if len(ids) else np.zeros(0, np.int64)
            # of equal rows one copy is enough
            copied = leading[np.unique(at[leading], return_index=True)[1]]
            rows = batch.take(pa.array(np.concatenate([np.arange(len(ids)), copied])))
            place = np.concatenate([used[at], used[at[copied] - 1]]).astype(np.int32)
            guest = np.arange(len(place)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(guest), *(rows.column(c) for c in ("doc_id", "h", "text"))], names=["place", "guest", "doc_id", "h", "text"])

    dealt = frame.mapInArrow(deal, "place int, guest boolean, doc_id long, h long, text string").repartitionById(ranges.count, "place")
    return dealt.sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "h", "text")


def edit(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and how far it is contained in that and in the next one's.

    The next document is the one with the next smaller doc_id, after the last the first; rows
    with one doc_id are in order of a hash of their texts, and null ids come last.  A null
    text is empty; a single document is its own next one; other columns are left out; an empty
    table gives no rows.
    """

    def row(doc_id, text: str, own: dict[int, int], after: str, following: dict[int, int]) -> tuple:
        changed = edit(text, after)
        other = chunk_weights(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, to_string(own), to_string(other), containment(own, other), containment(own, following)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for guest, doc_id, text in zip(batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if guest and before is None:
                    continue
                text = text.as_py()
                weights = chunk_weights(text)
                if before is not None:
                    rows.append(row(*before, text, weights))
                before = None if guest else (doc_id, text, weights)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return ordered_ranges(docs).select("guest", "doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of all documents and of their edited texts."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
