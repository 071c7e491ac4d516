"""Writes: upserts, replacement, pruning and dated sinks over plain parquet tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest version of each row."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def replaced_facts(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Facts where those of the touched sessions (``session_id``) are the new ones."""
    return old.join(touched.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)


def without_sessions(sessions: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and facts after some sessions (``id``) are deleted."""
    ids = gone.select("id").distinct()
    return sessions.join(ids, "id", "left_anti"), facts.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def pruned(facts: DataFrame, before: datetime) -> tuple[DataFrame, DataFrame]:
    """Facts from a time on, and the number of those older."""
    old = F.col("ts") < F.lit(before)
    return facts.filter(~old), facts.agg(F.count_if(old).alias("pruned"))


def fact_ids(facts: DataFrame) -> DataFrame:
    """Adds ids that stay the same when a log is read again."""
    return facts.withColumn("id", F.xxhash64("session_id", "ord", "sub_ord"))


def write_replacing(df: DataFrame, path: str, partition_by: str) -> None:
    """Overwrites only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def advanced(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """``engine, seen_to`` after some runs (``engine, seen_to, failed``): only an engine without a failure moves on."""
    done = runs.groupBy("engine").agg(F.max("seen_to").alias("new"), F.max("failed").alias("failed"))
    both = cursors.join(done, "engine", "full")
    return both.select("engine", F.when(F.coalesce("failed", F.lit(True)), F.col("seen_to")).otherwise(F.greatest("seen_to", "new")).alias("seen_to"))


def ingest_report(found: DataFrame, known: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``engine, indexed, skipped, errors``: of the logs ``found`` (``engine, id, size, error``) those new or grown since
    ``known`` (``id, size``) are indexed, unchanged ones skipped. The columns ``more`` of both tell logs of one id apart."""
    f = found.join(known.select("id", *more, F.col("size").alias("old")), ["id", *more], "left")
    bad, same = F.col("error").isNotNull(), F.coalesce(F.col("size") == F.col("old"), F.lit(False))
    return f.groupBy("engine").agg(F.count_if(~bad & ~same).alias("indexed"), F.count_if(~bad & same).alias("skipped"), F.count_if(bad).alias("errors"))
