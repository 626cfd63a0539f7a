"""Small tables that hold what is awkward: nulls, empties, long texts, ties, clashing columns."""

AWKWARD = [None, "", " ", "\n", "é", "a", "word " * 4000, "x\ty\r\nz", "ünï çödé ß 好的 漢字", "a  b   c", "<|endoftext|> in text", "AKIA secret: token", "the end.", "the end."]


def documents(spark, texts, **extra):
    """doc_id, text and extra literal columns; ids from 1."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    for name, value in extra.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
