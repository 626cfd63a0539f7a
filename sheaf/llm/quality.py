"""Quality classifier: learned vectors of hashed word and character n-grams.

A document is the mean of the vectors of its words and their character n-grams and the mean of
the vectors of its word bigrams, in equal parts; all are hashed into one table.  In a bigram a
word that repeats the one before it is written as a back-reference, so that repeats of rare
words share what is learned.  A linear layer with softmax gives the classes.  Vectors and layer
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  As
the model is linear in the means, a feature's part in the score is one number: workers keep it
per token, and look it up per bigram.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import hash_limits, held_out, text_of, trimmed
from sheaf.llm.features import TokenTable, bigrams, ngrams, token_hashes
from sheaf.llm.tokens import slices

#: About how many labelled rows are drawn per class, those with the smallest hashes of doc_id.
TRAIN_ROWS = 1500
BITS, SIZES, DIM = 17, (1, 2, 3), 8
#: Steps of gradient descent, whatever the number of rows drawn.
STEPS, RATE = 24_000, 0.4
CUT = 0.3


class Model:
    """What scoring needs: a number per bucket and the offset that restores the classes' shares."""

    def __init__(self, weights: np.ndarray, bias: float, empty: float):
        # tells models apart in a worker, where the address of a broadcast may be used again
        self.token = uuid.uuid4().hex
        self.weights, self.bias, self.empty = weights.astype(np.float32), bias, empty

    def score(self, tokens: list[str]) -> np.ndarray:
        """Per token: the sum of its features' numbers, and how many features it has."""
        buckets, owners = ngrams([t.encode("utf-8", "surrogatepass") for t in tokens], SIZES, BITS)
        return np.stack([np.bincount(owners, self.weights[buckets], len(tokens)), np.bincount(owners, minlength=len(tokens))], 1).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], prior: tuple[int, int], dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Train on (label, distinct buckets, shares).  ``prior``: rows with label 0 and 1 in all of the training data."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    bags = [b for b in bags if len(b[1])]
    done = 0
    while bags and done < steps:
        for i in rng.permutation(len(bags))[: steps - done]:
            label, buckets, share = bags[i]
            mean = share @ vectors[buckets]
            out = np.exp((z := mean @ layer) - z.max())
            grad = out / out.sum()
            grad[label] -= 1
            step = rate * (1 - done / steps)
            inner = layer @ grad
            layer -= step * np.outer(mean, grad)
            vectors[buckets] -= (step * share)[:, None] * inner[None, :]
            done += 1
    weights = vectors @ (layer[:, 1] - layer[:, 0])
    labels = Counter(b[0] for b in bags)
    drawn = np.log((labels[1] + 1) / (labels[0] + 1))
    real = np.log((prior[1] + 1) / (prior[0] + 1))
    return Model(weights, float(real - drawn), float(_sigmoid(real)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their shares, which sum to 1."""
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    numbers: dict[str, int] = {}
    at = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    words = list(numbers)
    buckets, owners = ngrams([w.encode("utf-8", "surrogatepass") for w in words], SIZES, BITS)
    shares = np.bincount(buckets, np.bincount(at)[owners], 1 << BITS)
    shares /= shares.sum()
    if len(tokens) > 1:
        hashes = token_hashes(words)[at]
        shares = (shares + np.bincount(bigrams(hashes[:-1], hashes[1:], BITS), minlength=1 << BITS) / (len(tokens) - 1)) / 2
    used = np.flatnonzero(shares)
    return used, shares[used]


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS, label: str = "quality") -> Model:
    """Learn from labelled documents that are not held out.

    About ``rows_per_class`` rows a class are drawn and sent to the driver, each as the distinct
    features of the whole text; the classes' shares are counted over all labels.  A document
    with several labels counts with each; of rows with one doc_id the smallest text counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    prior = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    limits = hash_limits(known, "label", rows_per_class)
    below = F.element_at(F.create_map(*(F.lit(x) for pair in (limits or {0: 0}).items() for x in pair)), F.col("label"))
    drawn = known.where(F.xxhash64("doc_id") <= below).distinct()

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for text in batch.column("text"):
                buckets, shares = features(text.as_py())
                ids.append(buckets.astype(np.int32).tobytes())
                values.append(shares.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["label", "doc_id", "buckets", "shares"])

    # about 2 * rows_per_class ids
    texts = text_of(docs).join(F.broadcast(drawn), "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(trimmed(bag), "label int, doc_id long, buckets binary, shares binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["buckets"]))
    return fit([(r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows], (prior.get(0, 0), prior.get(1, 0)))


_TABLES: dict[str, tuple[Model, TokenTable]] = {}


def _table(shared) -> tuple[Model, TokenTable]:
    model = shared.value
    if model.token not in _TABLES:
        _TABLES.clear()
        _TABLES[model.token] = model, TokenTable(model.score, 2)
    return _TABLES[model.token]


def predict(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, score (probability of label 1) and predicted.

    A text without tokens (or null) gets the share of label 1 among the training labels.
    Only ``text`` is an input, so repeated rows and null ids are scored as the rows they are
    and other columns make no difference; a text of any length counts whole; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _table(shared)
        for batch in batches:
            scores = []
            for _, texts in slices(iter([batch])):
                parts = [t.split() for t in texts]
                lengths = np.fromiter(map(len, parts), np.int64, len(parts))
                rows, at = table.lookup([w for p in parts for w in p])
                owner = np.repeat(np.arange(len(parts)), lengths)
                total, n = (np.bincount(owner, rows[:, i], len(parts)) for i in (0, 1))
                pairs = np.flatnonzero(owner[1:] == owner[:-1])
                hashes = table.hashes[at]
                joint = np.bincount(owner[pairs], model.weights[bigrams(hashes[pairs], hashes[pairs + 1], BITS)], len(parts))
                mean = total / np.maximum(n, 1)
                mean = np.where(lengths > 1, (mean + joint / np.maximum(lengths - 1, 1)) / 2, mean)
                scores += np.where(n > 0, _sigmoid(mean + model.bias), model.empty).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = text_of(docs).mapInArrow(trimmed(run), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: quality of all documents, learned from labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return predict(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
