"""Helpers shared by the training-data operators.

Everything that outlives a job (written tables, token shards, archives) goes below the
folder named by ``spark.checkpoint.dir``, which every executor can reach.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache may hold before it starts anew.
CACHE_ENTRIES = 250_000
#: Texts in one Arrow batch at most.
TEXT_ROWS = 2_000
#: Parts into which the rows of one key are dealt.
SALTS = 32
#: A key is hot with more than HOT_ROWS rows and more than one in MOST_HOT of all, so at most MOST_HOT are.
HOT_ROWS, MOST_HOT = 10_000, 1_000

try:
    _LIBC = ctypes.CDLL(None)
except OSError:
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``.

    The setting is read from the session.  Where it is unset a local session gets a folder
    of its own; any other master is refused, since a machine-local folder would not be
    visible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheaf-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it back: the lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns only, so extra columns never clash."""
    modest(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def group_value(rows: DataFrame, key: str, by: tuple[str, ...], value: Column, merge: Callable[[str], Column], name: str, salts: int = SALTS) -> DataFrame:
    """The rows with ``name``, an aggregate over all rows of their ``key``; a hot key meets in no task.

    Rows are dealt by key and a salt (a hash of the columns ``by``) and aggregated there with
    ``value``; ``merge`` joins the parts, at most ``salts`` for a key, and each part takes the
    result back to its rows.  Rows with a null key are left out.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    part = salted.groupBy(key, "__salt").agg(value.alias("__part"))
    total = part.groupBy(key).agg(merge("__part").alias(name))
    return salted.join(part.select(key, "__salt").join(total, key), [key, "__salt"]).drop("__salt")


def hot_keys(sizes: DataFrame, key: str, total: int) -> DataFrame | None:
    """Of ``sizes`` (key, n) the keys with so many of ``total`` rows that one task should not get them.

    They are at most MOST_HOT, so they fit in the driver; None if there are none.
    """
    found = sizes.where(F.col("n") > max(HOT_ROWS, total // MOST_HOT)).select(key).collect()
    return sizes.sparkSession.createDataFrame(found, sizes.select(key).schema) if found else None


def spread_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (one light row a key); rows of hot keys stay where they are.

    ``hot`` comes from ``hot_keys``, so what is broadcast is bounded by MOST_HOT rows.
    """
    if hot is None:
        return rows.join(side, key)
    often = side.join(F.broadcast(hot), key, "left_semi")
    seldom = rows.join(F.broadcast(hot), key, "left_anti").join(side, key)
    return rows.join(F.broadcast(often), key).select(*seldom.columns).union(seldom)


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: tuple[str, ...], salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``side`` (one light row a key); no task gets more than one in ``salts`` of a key's rows.

    Rows are dealt by key and a salt (a hash of the columns ``by``); the side meets each key and
    salt that there is, and these meet the rows.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    return salted.join(salted.select(key, "__salt").distinct().join(side, key), [key, "__salt"], how).drop("__salt")


def held_out(doc_id):
    """Rows that no training may see: crc32(doc_id as text) mod 5 is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_limits(rows: DataFrame, group: str, wanted: int) -> dict:
    """group -> limit of xxhash64(doc_id) below which about ``wanted`` of the group's rows lie.

    Hashes are spread evenly, so a group's count gives its limit: no row is ranked and the
    draw is the same on every run.  Which rows are drawn does not depend on how many machines
    there are; the driver gets one count per group.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).collect()
    return {r[group]: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, wanted / r["n"]))) for r in counts}


_HOLDER: list = [None]


def claim(cache) -> None:
    """Let only one large cache live in a worker: the last holder is emptied.

    Spark hands a worker from stage to stage, and with it all that its modules keep.
    """
    if _HOLDER[0] is not cache:
        if _HOLDER[0] is not None:
            _HOLDER[0].reset()
        _HOLDER[0] = cache
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back after each of them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            trim()

    return over


def modest(spark: SparkSession) -> None:
    """Texts may be long: workers of this session get at most TEXT_ROWS of them in one Arrow batch.

    The setting stays, for the frames that operators return run later; the session's bound on a
    batch's bytes holds besides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > TEXT_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, TEXT_ROWS)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: int):
    """Arrow batches of at most so many rows and, about, so many bytes for the jobs that run inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class HashCache(dict):
    """word (bytes) -> 64-bit hash; filled on demand, emptied when it grows past its bound."""

    def reset(self) -> None:
        self.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        claim(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: bytes.translate table: A-Z to a-z, and every ASCII byte that is no letter or digit to a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes look random in every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, given the word hashes; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = (total + words[i : i + n]) * _ODD[i % len(_ODD)] + np.uint64(i)
        total ^= total >> np.uint64(29)
    return mix(total)
