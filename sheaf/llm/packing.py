"""Cost-balanced packing of documents into training sequences.

A sequence's cost is estimated as ``linear * tokens + quadratic * sum of squared piece
lengths`` (attention does not cross pieces).  Within a block of documents the pieces go, in
descending length, to the lowest-cost sequence that still has room for them.  A piece that
fits nowhere is cut.  Full-length pieces of long documents are sequences by themselves.

Every input partition packs its own documents, block by block, and hands what is left of a
block to the next.  What is left at the end, under one sequence a partition, is packed in the
same way with the rests of FAN - 1 other partitions, their rests again with others, and so on:
a tree whose tasks never hold more than FAN sequences, whatever the number of partitions.  Only
the last rest of all, under one sequence, does not fill a whole one; it is cut into sequences
whose sizes are powers of two, which need no padding.  Documents are not shuffled, only rests
are, and a retried task yields the same pieces for the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize, shared_dir, text_of, trimmed
from sheaf.llm.tokens import default_tokenizer, encoder, slices

CAPACITY = 1024
#: Sequences that are open at once.
BLOCK_SEQUENCES = 256
#: Partitions whose rests are packed together.
FAN = 64
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

#: A piece: (document's number in the partition's table, first id in the document, length).
Piece = tuple[int, int, int]


def pack_block(pieces: list[Piece], capacity: int, sequences: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill ``sequences`` sequences wholly; returns them and the pieces left over.

    The pieces must have at least ``sequences * capacity`` tokens.
    """
    room = np.full(sequences, capacity, np.int64)
    cost = np.zeros(sequences)
    filled: list[list[Piece]] = [[] for _ in range(sequences)]
    queue = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    rest: list[Piece] = []
    left = sequences * capacity
    for doc, start, size in queue:
        while size and left:
            fits = np.where(room >= size, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(size, int(room[at]))
            filled[at].append((doc, start, take))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start, size, left = start + take, size - take, left - take
        if size:
            rest.append((doc, start, size))
    return filled, rest


def power_sizes(n: int) -> list[int]:
    """Powers of two that sum to n, descending."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_tail(pieces: list[Piece]) -> list[list[Piece]]:
    """The last pieces of all, cut into sequences with sizes that are powers of two."""
    out: list[list[Piece]] = []
    queue = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))[::-1]
    for size in power_sizes(sum(p[2] for p in pieces)):
        row: list[Piece] = []
        while size:
            doc, start, n = queue.pop()
            take = min(n, size)
            row.append((doc, start, take))
            size -= take
            if take < n:
                queue.append((doc, start + take, n - take))
        out.append(row)
    return out


class Packer:
    """Packs the documents of one partition; ``add`` and ``finish`` yield rows of pieces."""

    def __init__(self, capacity: int, block: int, linear: float, quadratic: float, base: int):
        self.capacity, self.block, self.weights = capacity, block, (linear, quadratic)
        #: number -> document's id, its ids from ``first`` on, ``first``, its tokens
        self.docs: dict[int, tuple[object, np.ndarray, int, int]] = {}
        self.open: list[Piece] = []
        self.tokens, self.next_doc, self.next_sequence = 0, 0, base

    def rows(self, sequences: list[list[Piece]]) -> Iterator[tuple]:
        for pieces in sequences:
            at = 0
            cost = sum(self.weights[0] * n + self.weights[1] * n * n for _, _, n in pieces)
            for doc, start, n in pieces:
                doc_id, ids, first, size = self.docs[doc]
                yield doc_id, start, n, zlib.crc32(ids[start - first : start - first + n]), size, self.next_sequence, at, cost, None
                at += n
            self.next_sequence += 1

    def hold(self, doc_id, ids: np.ndarray, first: int, size: int) -> int:
        doc, self.next_doc = self.next_doc, self.next_doc + 1
        self.docs[doc] = doc_id, ids, first, size
        return doc

    def piece(self, doc: int, start: int, n: int) -> None:
        self.open.append((doc, start, n))
        self.tokens += n

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        doc = self.hold(doc_id, ids, 0, len(ids))
        full = len(ids) // self.capacity
        yield from self.rows([[(doc, i * self.capacity, self.capacity)] for i in range(full)])
        if size := len(ids) - full * self.capacity:
            # of a long document the rest alone is kept
            self.docs[doc] = doc_id, ids[full * self.capacity :].copy(), full * self.capacity, len(ids)
            self.piece(doc, full * self.capacity, size)
        else:
            del self.docs[doc]
        if self.tokens >= self.block * self.capacity:
            yield from self.close(self.block)

    def close(self, sequences: int) -> Iterator[tuple]:
        filled, self.open = pack_block(self.open, self.capacity, sequences, *self.weights)
        yield from self.rows(filled)
        self.tokens = sum(p[2] for p in self.open)
        self.docs = {p[0]: self.docs[p[0]] for p in self.open}

    def finish(self, last: bool) -> Iterator[tuple]:
        """Whole sequences while there are tokens for one; then the rest, as pieces with their ids or, if ``last``, as short sequences."""
        if self.tokens >= self.capacity:
            yield from self.close(self.tokens // self.capacity)
        if last:
            yield from self.rows(pack_tail(self.open))
            return
        for doc, start, n in self.open:
            doc_id, ids, first, size = self.docs[doc]
            yield doc_id, start, n, None, size, None, None, None, ids[start - first : start - first + n].astype("<u4").tobytes()


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64())])
#: A piece that is not in a sequence yet has its ids and the group that it was left over by.
SCHEMA = pa.schema([*PIECES, pa.field("ids", pa.binary()), pa.field("group", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double, ids binary, group long"


def _table(rows: list[tuple], group: int) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] + [[group] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _first(level: int, group: int) -> int:
    """The first sequence_id of a group of a level."""
    return (level << 56) + (group << 32)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, block_sequences: int = BLOCK_SEQUENCES, linear: float = LINEAR, quadratic: float = QUADRATIC, fan: int = FAN, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost.

    ``capacity`` is a power of two.  ``sequence_id`` is the level of the tree times 2**56, plus
    the number of the partition or group times 2**32, plus the sequence's number in it.  A null
    text counts as empty: one piece, the end id.  Null and repeated doc_ids are packed as the
    rows they are; other columns are left out; an empty table gives no rows; a text of any
    length is cut into as many pieces as it needs.  Pieces are written below ``folder`` (a new
    one by default) level by level.
    """
    path = tokenizer_path or default_tokenizer()
    folder = folder or shared_dir(docs.sparkSession)
    settings = capacity, block_sequences, linear, quadratic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        coder, packer = encoder(path, end_id), Packer(*settings, _first(0, group))
        for doc_ids, texts in slices(batches):
            ids, offsets = coder.encode(texts)
            rows = [row for i, doc_id in enumerate(doc_ids) for row in packer.add(doc_id, ids[offsets[i] : offsets[i + 1]].copy())]
            if rows:
                yield _table(rows, group)
        if rows := list(packer.finish(False)):
            yield _table(rows, group)

    done = [materialize(text_of(docs).mapInArrow(trimmed(run), DDL), f"{folder}/level0")]
    while True:
        rest = done[-1].where("ids is not null")
        most = rest.agg(F.max("group").alias("most")).first()["most"]
        if most is None:
            break
        level, groups = len(done), most // fan + 1
        grouped = rest.withColumn("group", F.floor(F.col("group") / fan)).repartition(groups, "group").sortWithinPartitions("group", "doc_id", "start", "doc_tokens", "ids")
        done.append(materialize(grouped.mapInArrow(_rests(settings, level, groups == 1), DDL), f"{folder}/level{level}"))
        if groups == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.where("ids is null").select(*PIECES.names)


def _rests(settings: tuple, level: int, last: bool):
    """Pack the rests of each group of partitions; a group's rows are consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            for doc_id, start, n, size, ids, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids", "group")), strict=True):
                if own != group:
                    if packer and (rows := list(packer.finish(last))):
                        yield _table(rows, group)
                    group, packer = own, Packer(*settings, _first(level, own))
                packer.piece(packer.hold(doc_id, np.frombuffer(ids, "<u4"), start, size), start, n)
        if packer and (rows := list(packer.finish(last))):
            yield _table(rows, group)

    return run


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
