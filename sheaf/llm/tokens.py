"""Token-id output: Arrow IPC files whose batches hold equal-length sequences and their masks.

Each task writes one file in the Arrow *file* format.  A file has two columns of fixed-size
lists, ``ids`` and ``mask`` (a bit per id, lowest first: 1 for a real id and 0 for padding; the
bits of a sequence fill whole bytes), and record batches of exactly ``batch_sequences`` rows (the last may be shorter), so sequence ``i`` is row
``i % batch_sequences`` of batch ``i // batch_sequences``: a reader maps the file and gets numpy
views of both without copying (``unpack`` makes booleans of a mask).  Ids stand in ascending ``doc_id`` order, within a file and over
the files by number.  Files have about ``SHARD_BYTES`` of text each, whatever the input's size.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import claim, materialize, shared_dir, text_of, trimmed

SEQUENCE = 1024
BATCH_SEQUENCES = 256
#: Texts are encoded together up to about this many characters.
SLICE_CHARS = 2_000_000
#: Bytes of text that go into one file, about.
SHARD_BYTES = 32 << 20
#: Files whose sizes are added up together; the driver gets one sum for so many.
SHARD_BLOCK = 1_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Units that an encoder keeps before it starts anew.
UNITS = 700_000
#: Marks, in a cut text, a unit without a space before it.
MARK = "\x01"


class _Units(dict):
    """unit -> number; a new unit is noted as pending.

    ``first`` units begin a text; the others have a space before them unless marked.
    """

    def __init__(self, owner: Encoder, first: bool):
        self.owner, self.first = owner, first

    def __missing__(self, unit: str) -> int:
        number = self[unit] = self.owner.note(unit, self.first)
        if len(unit) > 48:
            self.owner.long_units.append((self, unit))
        return number


class Encoder:
    """Encodes whole texts with a byte-level BPE tokenizer, end id appended, through a bounded unit cache.

    The pre-tokenizer's pattern never joins what stands on the two sides of these places: before
    a single space between characters that are no white space; before a full stop or comma that
    follows a letter or number; around a single line feed between characters that are no white
    space.  So a text cut there has the ids of its units one after another, and a unit seen
    before needs no second encoding.  Any other white space, or a stop or comma after other
    characters, makes the whole text be encoded at once.  All encoding is done by the tokenizers
    library: new units go there together, a line feed between them.  With other kinds of
    pre-tokenizers every text is encoded whole.
    """

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        pre = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        feed = self._encode_raw(["\n"])[0]
        self.by_units = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(feed) == 1 and self.tokenizer.normalizer is None
        self.feed = feed[0] if feed else -1
        self.reset()

    def reset(self) -> None:
        self.first, self.inner = _Units(self, True), _Units(self, False)
        self.long_units: list[tuple[_Units, str]] = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        # per unit: 1 its text must be encoded whole; 2 it must follow a letter or number; 4 it ends with one
        self.flags = np.zeros(1 << 14, np.uint8)
        self.used, self.count = 0, 0
        self.pending: list[str] = []
        self.kinds: list[int] = []
        self.pending.append("")
        self.kinds.append(0)
        self._flush()
        self.flat[0], self.lens[0], self.used = self.end_id, 1, 1  # unit 0: the end id

    def note(self, unit: str, first: bool) -> int:
        marked = unit[:1] == MARK
        text = unit[1:] if marked else unit
        if not text or marked and first:
            kind = 1
        elif text == "\n" and marked:
            kind = 0
        else:
            kind = (text[0].isspace() or text[-1].isspace()) | (marked and text[0] in ".,") << 1 | text[-1].isalnum() << 2
        self.pending.append(text if marked or first else " " + text)
        self.kinds.append(kind)
        return self.count + len(self.pending) - 1

    def _encode_raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in turn, and how many each has."""
        ids = np.array(self._encode_raw(["\n".join(units)])[0], np.uint32)
        edges = np.flatnonzero(ids == self.feed)
        if len(edges) == len(units) - 1:
            lens = np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1
            return np.delete(ids, edges), lens
        coded = self._encode_raw(units)
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lens.sum())), lens

    def _flush(self) -> None:
        """Encode the pending units; the lone ones are those that can't be joined with others."""
        if not self.pending:
            return
        kinds = np.array(self.kinds, np.uint8)
        n = len(kinds)
        while self.count + n > len(self.starts):
            self.starts, self.lens, self.flags = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens, self.flags))
        self.flags[self.count : self.count + n] = kinds
        joined = [i for i, (text, kind) in enumerate(zip(self.pending, self.kinds, strict=True)) if not kind & 1 and "\n" not in text and text]
        parts = [joined[i : i + 1000] for i in range(0, len(joined), 1000)]
        alone = [[i] for i, (text, kind) in enumerate(zip(self.pending, self.kinds, strict=True)) if not kind & 1 and "\n" in text]
        for part in parts + alone:
            if len(part) > 1:
                ids, lens = self._encode_units([self.pending[i] for i in part])
            else:
                ids = np.array(self._encode_raw([self.pending[part[0]]])[0], np.uint32)
                lens = np.array([len(ids)])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            at = self.count + np.array(part)
            self.starts[at] = self.used + np.cumsum(lens) - lens
            self.lens[at] = lens
            self.used += len(ids)
        self.count, self.pending, self.kinds = self.count + n, [], []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the offsets of the texts in them (one more than texts)."""
        if not self.by_units:
            return self._joined([np.array([*ids, self.end_id], np.uint32) for ids in self._encode_raw(texts)])
        if self.count > UNITS or self.used > 16 * UNITS:
            self.reset()
        numbers, ends, whole = [], [], []
        inner = self.inner.__getitem__
        for i, text in enumerate(texts):
            if MARK in text:
                whole.append(i)
            elif text:
                parts = text.replace(".", " \x01.").replace(",", " \x01,").replace("\n", " \x01\n \x01").split(" ")
                numbers.append(self.first[parts[0]])
                numbers += map(inner, parts[1:])
            numbers.append(0)
            ends.append(len(numbers))
        self._flush()
        units, ends = np.array(numbers, np.int64), np.array(ends, np.int64)
        lens = self.lens[units]
        edges = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(edges[-1]) + np.repeat(self.starts[units] - edges[:-1], lens)]
        offsets = np.concatenate([[0], edges[ends]])
        flags = self.flags[units]
        bad = np.flatnonzero((flags & 1).astype(bool) | (flags & 2).astype(bool) & ~np.concatenate([[False], (flags[:-1] & 4).astype(bool)]))
        whole = sorted({*whole, *np.searchsorted(ends, bad, "right").tolist()})
        if whole:
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i, own in zip(whole, self._encode_raw([texts[i] for i in whole]), strict=True):
                parts[i] = np.array([*own, self.end_id], np.uint32)
            ids, offsets = self._joined(parts)
        for cache, unit in self.long_units:
            cache.pop(unit, None)
        self.long_units = []
        return ids, offsets

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder; kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    claim(_ENCODERS[path, end_id])
    return _ENCODERS[path, end_id]


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows, about ``chars`` characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def qualified(spark, folder: str) -> str:
    """The folder with its scheme; a path without one lies on Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def filesystem(uri: str):
    """The pyarrow file system and path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _dtype(tokenizer_path: str) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype(np.uint16 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else np.uint32)


class ShardWriter:
    """Writes ids to one Arrow file, sequence after sequence; the last sequence is padded and masked."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch_sequences: int):
        self.dtype, self.length, self.rows = dtype, length, batch_sequences
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)
        self.schema = pa.schema([pa.field("ids", ids, nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), nullable=False), -(-length // 8)), nullable=False)])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.left: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids.astype(self.dtype, copy=False))
        self.held += len(ids)
        step = self.length * self.rows
        if self.held >= step:
            every = np.concatenate(self.left)
            for at in range(0, self.held - step + 1, step):
                self._write(every[at : at + step], step)
            self.left, self.held = [every[self.held // step * step :].copy()], self.held % step

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits((np.arange(len(ids)) < real).reshape(-1, self.length), axis=1, bitorder="little").ravel()
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type) for values, field in zip((ids, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.length) * self.length, self.dtype)
            ids[: self.held] = np.concatenate(self.left)
            self._write(ids, self.held)
        self.writer.close()


class ShardReader:
    """Random access to a file that ShardWriter made; local files are mapped, not read."""

    def __init__(self, uri: str, batch_sequences: int = BATCH_SEQUENCES):
        system, path = filesystem(uri)
        local = system.type_name == "local"
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = batch_sequences
        self.number, self.kept = -1, (np.zeros(0), np.zeros(0))

    def batch(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bits of one record batch: views of the file's memory."""
        if self.number != number:
            columns = self.reader.get_batch(number).columns
            self.number, self.kept = number, tuple(c.flatten().to_numpy(zero_copy_only=True) for c in columns)
        return self.kept

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask bits: views, too."""
        at, wide = i % self.rows, -(-self.length // 8)
        ids, mask = self.batch(i // self.rows)
        return ids[at * self.length : (at + 1) * self.length], mask[at * wide : (at + 1) * wide]

    def unpack(self, mask: np.ndarray) -> np.ndarray:
        """The mask bits of a sequence as booleans."""
        return np.unpackbits(mask, count=self.length, bitorder="little").astype(bool)

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids at places start to start + count, over the borders of batches."""
        step, parts = self.rows * self.length, []
        while count > 0:
            part = self.batch(start // step)[0][start % step : start % step + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.source.close()


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 0, length: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the shards and return their index.

    Index: doc_id, shard (number), file, local_start, n_tokens.  A null text counts as empty
    and gives the end id alone; null ids come first; repeated ids stay, ordered by a hash of
    the text and may lie in several files; other columns are left out; an empty table gives no
    shard.  A retried task writes a file of another name and only the file that the committed
    index names is read.
    """
    folder = qualified(docs.sparkSession, folder)
    path = tokenizer_path or default_tokenizer()
    dtype = _dtype(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, writer = TaskContext.get().partitionId(), 0, None
        coder = encoder(path, end_id)
        for doc_ids, texts in slices(batches):
            if writer is None:
                system, root = filesystem(folder)
                system.create_dir(root, recursive=True)
                file = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.arrow"
                uri, sink = f"{folder}/{file}", system.open_output_stream(f"{root}/{file}")
                writer = ShardWriter(sink, dtype, length, batch_sequences)
            ids, offsets = coder.encode(texts)
            writer.add(ids)
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([uri] * n), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets))],
                names=["doc_id", "shard", "file", "local_start", "n_tokens"],
            )
            at += len(ids)
        if writer is not None:
            writer.close()
            sink.close()

    frame = text_of(docs)
    size = frame.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = ("doc_id", F.xxhash64("text"))  # the hash parts the rows of one id
    ordered = frame.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInArrow(trimmed(write), "doc_id long, shard int, file string, local_start long, n_tokens long"), f"{folder}-index")


def shard_starts(index: DataFrame, block: int = SHARD_BLOCK) -> DataFrame:
    """shard, shard_start: how many ids stand before each file.

    Files are added up within blocks of ``block`` files, and the blocks' sums on the driver.
    """
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / block).cast("int"))
    before, total = [], 0
    for row in sorted(sizes.groupBy("block").agg(F.sum("n").alias("n")).collect()):
        before.append((row["block"], total))
        total += row["n"]
    blocks = index.sparkSession.createDataFrame(before, "block int, block_start long")
    earlier = F.sum("n").over(Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.join(F.broadcast(blocks), "block").select("shard", (F.col("block_start") + F.coalesce(earlier, F.lit(0))).alias("shard_start"))


def read_shards(index: DataFrame, batch_sequences: int = BATCH_SEQUENCES) -> DataFrame:
    """Read every document's ids back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, reader = None, None
        for batch in batches:
            crcs = []
            for file, start, n in zip(batch.column("file").to_pylist(), batch.column("local_start").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if file != open_file:
                    if reader:
                        reader.close()
                    open_file, reader = file, ShardReader(file, batch_sequences)
                crcs.append(zlib.crc32(reader.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    placed = index.join(shard_starts(index), "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "file", "local_start")
    return placed.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids of all documents written to shards and read back."""
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)))
