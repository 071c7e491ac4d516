"""The training-data operators over the ``documents`` and ``benchmark`` tables, and SQL for their results."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, katz, langid, licenses, neardup, quality, secrets, spelling, substrings, tokencount, turns, vectors
from .common import ship


#: Arrow batches of so many bytes keep the memory of a task's JVM and Python sides small.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set(*BATCH_BYTES)
        return query(spark, sf_dir)

    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = katz.katz_scores(_documents(spark, sf_dir), training=_remainder(7) != 2)
    return rows.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode_documents(_documents(spark, sf_dir), ranks_path=path, decode=True))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir)).drop("text_key")


def op4_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(_documents(spark, sf_dir), window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontam.contamination(_documents(spark, sf_dir), items, window=10, slop=2)
    near = F.array_join("near_item_ids", ",").alias("near_items")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_near", near)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secret_scan(_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify_languages(_documents(spark, sf_dir), training=_remainder(5) != 0)
    return rows.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def damaged_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: conversations with faults that a checksum of conversation and turn deals out."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", given("conv_id"), given("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(given("text"), "[.!?]", "")).otherwise(given("text"))
    role = F.when(fault == 4, "user").otherwise(given("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = turns.report(turns.repaired(damaged_turns(rows))).withColumnRenamed("conv_id", "c")
    named = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def misspelt_words(docs: DataFrame) -> DataFrame:
    """``word``: the runs of letters of all texts; one in 199, by a checksum of document and run, lacks a character."""
    said = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.runs(F.col("text"))).alias("run")).filter(F.length("run") >= 6)
    h, size = F.crc32(F.concat_ws(":", "id", "run")), F.length("run")
    at = F.pmod(h, size).cast("int")
    return said.select(F.when(h % 199 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(misspelt_words(_documents(spark, sf_dir)), length=6, least=5, factor=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_katz_scores,
        op2_bpe_roundtrip,
        op3_quality_divergence,
        op4_minhash_groups,
        op5_license_scan,
        op6_substring_dedup,
        op7_decontamination,
        op8_token_counts,
        op9_secret_scan,
        op10_language_id,
        op11_conversation_repair,
        op12_vector_groups,
        op13_spelling_variants,
        pipeline,
    )
}

ORACLES: dict[str, str] = {}
