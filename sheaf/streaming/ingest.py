"""Incremental ingestion with Structured Streaming.

A micro-batch replaces papers by content hash, so replaying one after a failure changes
nothing: together with the checkpointed offsets that gives exactly-once results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import chunking


def folder_of(path: str) -> tuple[str, dict[str, str]]:
    """A table's path as a folder to watch, and the option that picks the table in it."""
    parent, _, name = path.rpartition("/")
    return parent, {"pathGlobFilter": name}


def _read_stream(spark: SparkSession, path: str):
    schema = spark.read.parquet(path).schema
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = probe.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(probe).isFile()
    folder, options = folder_of(path) if is_file else (path, {})
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def run_once(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Ingest all documents there are as micro-batches into papers (paper_id, doc_id, batch); returns what is stored.

    Each batch is one folder named by its number and written whole, so a replay overwrites
    itself.  Of equal texts over all batches the largest doc_id stays.
    """

    def put(batch: DataFrame, number: int) -> None:
        papers = batch.groupBy(chunking.paper_id(F.col("text")).alias("paper_id")).agg(F.max("doc_id").alias("doc_id"))
        papers.write.mode("overwrite").parquet(f"{target}/papers/batch={number}")

    stream = _read_stream(spark, path).select("doc_id", "text").writeStream.foreachBatch(put).option("checkpointLocation", f"{target}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()
    stored = spark.read.parquet(f"{target}/papers")
    return stored.groupBy("paper_id").agg(F.max("doc_id").alias("doc_id"))


def event_windows(spark: SparkSession, path: str, target: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of events per tumbling window and type, as a stream with a watermark; returns what it wrote.

    Complete windows only reach an append sink once the watermark has passed them, so the
    totals are written in update mode by batch and the last value of a window counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/windows/batch={number}")

    events = _read_stream(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    stream = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{target}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()
    stored = spark.read.parquet(f"{target}/windows")
    return stored.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
