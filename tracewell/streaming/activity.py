"""Structured Streaming: continuous ingest, late data, deduplication and activity windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 seconds"


def log_stream(spark: SparkSession, root: str, glob: str, *, wholetext: bool = False) -> DataFrame:
    """New log files of one engine as a stream; each engine has its own query and checkpoint."""
    reader = spark.readStream.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("wholetext", str(wholetext).lower()).load(root).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def ingest(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``write`` on what is new since the last run; a batch that fails is done again."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Usage records once per key, across batches, while the watermark keeps them."""
    return usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def action_windows(facts: DataFrame, minutes: int, slide: int | None = None) -> DataFrame:
    """Facts per type in tumbling or sliding windows; also on batches."""
    f = facts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    w = F.window("ts", f"{minutes} minutes", f"{slide or minutes} minutes")
    return f.groupBy(w.alias("w"), "fact_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "fact_type", "n")


def session_sums(usage: DataFrame) -> DataFrame:
    """Running token sums and peak of each session, for update mode."""
    return usage.groupBy("session_id").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.max(F.col("input") + F.col("cache_read")).alias("peak_context"))
