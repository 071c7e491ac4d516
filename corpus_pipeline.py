"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, BPE.

Each stage takes all that the one before it kept, as the columns of ``documents``. Every stage but the
last returns these columns. ``run`` writes each stage's rows to the shared folder and reads them again.

For all stages: a null text counts as an empty one (which the quality rules reject); rows with one id and one text are judged
alike, and near-dedup leaves one of them; null ids are ids like others in every join; an empty table gives an empty table;
texts of any length are read whole; further columns, of any name, pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, neardup, quality, secrets
from tracewell.llm.common import free_name, stored



def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the rows of ``rows`` (id and text key); null ids are equal.

    The columns of ``docs`` stay as they are, whatever their names.
    """
    own, other, key = (free_name(docs, n) for n in ("__text_key", "__id", "__key"))
    wanted = rows.select(F.col("doc_id").alias(other), F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), how).drop(own)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    # The rules look at the text and, beyond it, only at sums over all documents, so equal texts are judged equally.
    # The verdicts are a table of their own: a filter on them would repeat all their expressions.
    verdicts = stored(quality.quality_rules(docs).select("doc_id", "text_key", "kept"), "verdicts")
    return _chosen(docs, verdicts.filter(~F.col("kept")), "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the smallest id stays, one with a null id if there is no other.

    Rows with a null id and no words are in no group and all stay.
    """
    rows = neardup.near_duplicates(docs, shingle=5, percent=80)
    alone = F.col("doc_id").isNull() & (F.col("n_shingles") == 0)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (F.col("n_shingles") == 0).alias("no_words"), "text_key")
    # Groups are told by the smallest id; where there is none, by the number of the group. Words or not, an id is one document.
    first = rows.filter(~alone).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("component")).alias("group")).agg(F.min(order).alias("x")).select("x.doc_id", "x.text_key")
    loose = stored(rows.filter(alone).select("doc_id", "text_key").distinct(), "loose")
    key = free_name(docs, "__text_key")
    one = _chosen(docs, first, "left_semi").withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", key]).drop(key)
    return one.unionByName(_chosen(docs, loose, "left_semi"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _chosen(docs, decontam.contamination(docs, items, window=10).filter("contaminated"), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; ``n_chars`` follows."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode_documents(docs, ranks_path=path, decode=True))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe", bpe_stage),
]

#: No SQL expresses MinHash groups and merges by rank; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
