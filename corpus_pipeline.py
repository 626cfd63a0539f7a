"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes the documents its predecessor kept and returns documents with the same
columns; the last returns the packed pieces.  Only what is wrong with a document removes it:
a text without any letter or without a known language, a copy, a contaminated text.  Secrets
are taken out of texts, which stay.

All stages take null and empty texts, texts of any length, repeated rows, null ids, empty tables
and columns of any names; what becomes of them is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontam, langid, neardup, packing, secrets
from sheaf.llm.common import materialize, shared_dir

#: Share of a text's letters that must lie in spans of known languages.
LEAST_COVERED = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts of which known languages cover less than LEAST_COVERED.

    A text of several known languages stays.  Null and empty texts have no letters and go;
    repeated rows and null ids are judged row by row.  Where no row has a language nothing is
    known, and every text with a letter stays.  An empty table gives no rows.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # the text goes to the workers once; the other columns travel in one struct
    own = [c for c in docs.columns if c != "text"]
    boxed = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("text"), *(F.col(f"`{c}`") for c in own)).alias("own"))
    judged = langid.predict(boxed, model, keep=("text", "own"))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("covered") >= LEAST_COVERED))
    return kept.select(*(F.when(~F.col("own.text"), F.col("text")).alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group: five-word shingles, similarity 0.8.

    Null and empty texts are linked with nothing and stay, as do all rows with a null id.  Of
    rows with the same doc_id and text one stays; with other texts they are other documents.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are benchmark passages.

    Null and empty texts have no words and stay; repeated rows and null ids are judged row by
    row; an empty benchmark drops nothing.
    """
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every row stays, null and empty texts as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts in sequences of at most 1024; a null or empty text is its end id, and every row is packed."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Near duplicates, language and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
