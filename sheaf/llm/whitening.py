"""Whitening of embeddings: exact sums, Chan's merged covariance, eigenvectors, a checked identity.

Vectors are rounded down to a grid of whole numbers.  What is fitted is each distinct vector
once.  Every partition gives its count, exact sums, and the scatter about its own mean; two such
parts are merged by Chan's formula, in a tree over the executors, so the driver gets a few parts
of the size of the covariance, however many vectors there are.  The driver takes the
eigenvectors.  A second pass over the fitted vectors whitens them and computes the covariance of
the result, whose distance from the identity is returned with the model.

Vectors are packed to the narrowest whole numbers that hold them before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize, shared_dir

#: Steps of the grid to 1.
STEPS = 64
COMPONENTS = 16
#: Rows whose matrices a task has in memory at once, at most, by their entries.
ENTRIES = 1 << 20
#: Parts that the last merge gets, about; those before merge as many each.
FAN = 8
WIDTHS = (np.int16, np.int32, np.int64)
LARGEST = 2.0**62


def usable(vector: Column) -> Column:
    """Neither null nor with a null or a value that is not finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))


def grid(values: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """floor(steps * c); beyond 2^62 the bound.

    Adding one number to all entries, as the contract does with 1,000,000, changes neither
    n*x - S nor the covariance.
    """
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * steps), -LARGEST, LARGEST).astype(np.int64)


def blocks(batch: pa.RecordBatch, column: str, dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batch with their vectors as a matrix; slices have vectors of one length."""
    lists = batch.column(column)
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        if dim is not None and d != dim:
            continue
        for at in range(0, len(rows), max(1, ENTRIES // max(int(d), 1))):
            part = batch.take(pa.array(rows[at : at + max(1, ENTRIES // max(int(d), 1))]))
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, int(d))


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the width of an entry, then the entries; equal rows have equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    out: list[bytes] = [b""] * len(x)
    for k, kind in enumerate(WIDTHS):
        low = -1 if k == 0 else np.iinfo(WIDTHS[k - 1]).max
        for i in np.flatnonzero((most > low) & (most <= np.iinfo(kind).max)):
            out[i] = bytes([k]) + x[i].astype(np.dtype(kind).newbyteorder("<")).tobytes()
    return out


def unpack(packed: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.dtype(WIDTHS[p[0]]).newbyteorder("<"), offset=1).astype(np.int64) for p in packed])


@dataclass
class Moments:
    """Count, sums of the entries (exact ones of whole numbers), and the scatter about the mean."""

    n: int
    sums: list[int] | list[float]
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters and the outer product of the difference of the means."""
        n = self.n + other.n
        # the difference of the means from whole numbers, so that large means do not cancel digits
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter)


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2**62:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)] if len(x) else []


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """n*x - S, exact: whole numbers of 64 bits, or Python's where these could overflow."""
    largest = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if largest < 2**61:
        return n * x - np.array(sums, np.int64), True
    return n * x.astype(object) - np.array(sums, object), False


def moments(x: np.ndarray) -> Moments:
    sums = exact_sums(x)
    apart, _ = centred(x, len(x), sums)
    apart = apart.astype(np.float64) / len(x)
    return Moments(len(x), sums, apart.T @ apart)


def total(parts: DataFrame, run: Callable[[list[bytes]], Moments]) -> Moments:
    """The moments of all rows of ``parts`` (at least one), each partition's by ``run``, merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                found = run(batch.column("packed").slice(at, 2048).to_pylist())
                mine = found if mine is None else mine.merged(found)
        if mine is not None:
            sums = [s.hex() if isinstance(s, float) else str(s) for s in mine.sums]
            yield pa.RecordBatch.from_arrays([pa.array([mine.n], pa.int64()), pa.array([sums], pa.list_(pa.string())), pa.array([mine.scatter.tobytes()], pa.binary())], names=["n", "sums", "scatter"])

    found = parts.mapInArrow(local, "n long, sums array<string>, scatter binary").rdd
    number = lambda s: float.fromhex(s) if "x" in s else int(s)
    found = found.map(lambda r: Moments(r["n"], [number(s) for s in r["sums"]], np.frombuffer(r["scatter"]).reshape(len(r["sums"]), len(r["sums"]))))
    depth = max(2, math.ceil(math.log(max(found.getNumPartitions(), 2), FAN)))
    return found.treeReduce(lambda a, b: a.merged(b), depth)


@dataclass
class Model:
    """What whitening needs: count and sums of the fitted vectors, components by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    #: Components with a variance above rounding.
    rank: int
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Whitened rows for components with a variance; n*x - S and whether it is of machine numbers."""
        apart, machine = centred(x, self.n, self.sums)
        mean = apart.astype(np.float64) / self.n if self.n else apart.astype(np.float64)
        return mean @ self.vectors[:, : self.rank] / np.sqrt(self.values[: self.rank]), apart, machine


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> Model:
    """The model of the distinct vectors of ``rows``, and its identity error from a second pass.

    Vectors that are null or hold null or values that are not finite are left out.  If there are
    vectors of several lengths those of the length with the most distinct vectors count (ties:
    the longest).  Without any vector the model is empty.  Very common vectors meet once per
    task before the shuffle.
    """
    spark = rows.sparkSession
    wanted = rows.where(usable(F.col(column))).select(F.col(column).cast("array<double>").alias("vector"))

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in blocks(batch, "vector"):
                yield pa.RecordBatch.from_arrays([pa.array([values.shape[1]] * len(values), pa.int32()), pa.array(pack(grid(values, steps)), pa.binary())], names=["dim", "packed"])

    distinct = materialize(wanted.mapInArrow(packing, "dim int, packed binary").distinct(), f"{shared_dir(spark)}/fitted")
    most = distinct.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return Model(0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    dim = most["dim"]
    fitted = distinct.where(F.col("dim") == dim).select("packed")
    found = total(fitted, lambda packed: moments(unpack(packed)))
    covariance = found.scatter / found.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    # one sign for all rows and runs: the largest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if dim else vectors
    trace = float(np.trace(covariance))
    rank = int((values > max(trace, 0.0) * dim * np.finfo(float).eps).sum())
    model = Model(dim, found.n, found.sums, vectors, values, trace, rank)
    if rank:
        shared = spark.sparkContext.broadcast(model)

        def second(packed: list[bytes]) -> Moments:
            white, _, _ = shared.value.whitened(unpack(packed))
            apart = white - white.mean(axis=0)
            return Moments(len(white), [float(s) for s in white.sum(axis=0)], apart.T @ apart)

        check = total(fitted, second)
        model.identity_error = float(np.abs(check.scatter / check.n - np.eye(rank)).max())
    return model


def whiten(rows: DataFrame, model: Model, key: str = "vec_id", column: str = "embedding", steps: int = STEPS) -> DataFrame:
    """One row per vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null or values that are not finite, or have another length than
    the model's are dropped.  Every other row is kept, repeated and without a key too; other
    columns are not looked at.  ``deviation`` is null where it exceeds 64 bits.  A component
    without variance (fewer distinct vectors than components) explains 0 and whitens to null.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = len(model.values)
        explained = np.where(np.arange(m) < model.rank, model.values / model.trace if model.trace > 0 else 0.0, 0.0)
        for batch in batches:
            for part, values in blocks(batch, "vector", model.dim):
                if not m:
                    continue
                white, apart, machine = model.whitened(grid(values, steps))
                if machine and float(np.abs(apart).max(initial=0)) ** 2 * model.dim < 2**62:
                    deviation = pa.array((apart * apart).sum(axis=1), pa.int64())
                else:
                    exact = apart.astype(object)
                    deviation = pa.array([d if d < 2**63 else None for d in (exact * exact).sum(axis=1)], pa.int64())
                k, size = part.num_rows, part.num_rows * m
                full = np.full((k, m), np.nan)
                full[:, : model.rank] = white
                each = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(each),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(size, model.n, np.int64)),
                        deviation.take(each),
                        pa.array(full.ravel(), pa.float64(), from_pandas=True),
                        pa.array(np.tile(explained, k)),
                        pa.array(np.full(size, model.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    given = rows.where(usable(F.col(column))).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    return given.mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings on the 16 first components of their distinct vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(rows)
    return whiten(rows, model)
