"""Model replies as a table: each prompt is asked once, whoever asks it and however often.

A prompt is known by the digest of model, system text, schema and its own text.  Replies, and
failures with their kind, are kept in a folder; a run asks what has no reply yet, equal prompts
once, and leaves what failed for a reason that will not pass.  Runs are written part by part, so
one that is cut short repeats at most a part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.adaptors import ChatClient
from sheaf.storage import Files

SCHEMA = "key string, payload string, failure string, run long"
#: Kinds of failures that may pass.
PASSING = ("TimeoutError", "URLError", "HTTPError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "OSError")
#: Runs in which a prompt is asked at most while it fails with a passing kind.
MOST_RUNS = 3


def key_of(text: Column, model: str, system: str, schema: dict) -> Column:
    """The digest that names a prompt; the parts have lengths before them, so none runs into the next."""
    parts = [model, system, json.dumps(schema, sort_keys=True, separators=(",", ":"))]
    head = "".join(f"{len(p)}:{p}" for p in parts)
    return F.sha2(F.concat(F.lit(head), text).cast("binary"), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """key, payload, failure, run of all finished parts in a folder."""
    files = Files(spark, folder)
    done = [n for n in files.names("") if n.startswith("part-") and files.exists(f"{n}/_SUCCESS")]
    return spark.read.schema(SCHEMA).parquet(*(f"{folder}/{n}" for n in done)) if done else spark.createDataFrame([], SCHEMA)


def latest(replies: DataFrame) -> DataFrame:
    """key, payload, failure, runs: a reply if there is one, else the last failure, and how often it was asked."""
    order = F.struct(F.col("payload").isNotNull().cast("int"), "run")
    return replies.groupBy("key").agg(F.max_by("payload", order).alias("payload"), F.max_by("failure", order).alias("failure"), F.count("*").alias("runs"))


def ask(prompts: DataFrame, folder: str, factory: Callable[[], ChatClient], model: str, system: str, schema: dict, passing: tuple[str, ...] = PASSING, most_runs: int = MOST_RUNS, parts: int = 1) -> DataFrame:
    """qid, query, payload, failure of prompts (qid, query): from the folder where it is known, else from the model.

    A null or blank prompt is not asked and has neither.  The key's first digits deal the
    prompts to ``parts``, which are asked and written one after another.
    """
    spark = prompts.sparkSession
    keyed = prompts.select("qid", "query", F.when(F.length(F.trim("query")) > 0, key_of(F.col("query"), model, system, schema)).alias("key"))
    known = latest(stored(spark, folder))
    settled = known.where(F.col("payload").isNotNull() | ~F.col("failure").isin(*passing) | (F.col("runs") >= most_runs)).select("key")
    run = max((int(n.split("-")[1]) for n in Files(spark, folder).names("") if n.startswith("part-")), default=-1) + 1
    wanted = keyed.where("key is not null").groupBy("key").agg(F.first("query").alias("query")).join(settled, "key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            payloads, failures = [], []
            for text in batch["query"]:
                try:
                    payloads.append(client.complete_json(system, text, schema))
                    failures.append(None)
                except Exception as error:
                    payloads.append(None)
                    # the kind alone: messages may hold parts of the prompt
                    failures.append(type(error).__name__)
            yield pd.DataFrame({"key": batch["key"], "payload": payloads, "failure": failures, "run": run})

    for part in range(parts):
        mine = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        mine.mapInPandas(call, SCHEMA).write.parquet(f"{folder}/part-{run}-{part}-{uuid.uuid4().hex}")
    return keyed.join(latest(stored(spark, folder)).select("key", "payload", "failure"), "key", "left").select("qid", "query", "payload", "failure")
