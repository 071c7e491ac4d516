"""Sessions, facts, handoffs and tags derived from the event, conversation and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The five command texts of the fixture.
COMMANDS = ("cargo build", "git commit -m wip && cargo test", "RUST_LOG=1 sudo rg todo | head -5", "rm -rf target; ls", 'echo "a && b" | wc')
MODELS = ("opus-x", "haiku-x", "gpt-5.4", "gpt-5.4-mini")
ENGINES = ("claude", "codex", "gemini")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(index, values):
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, v) if out is None else out.when(index == i, v)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "dd": F.dayofmonth("ts")})
    return e.withColumn("session_id", F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("d"), F.lpad(F.col("dd").cast("string"), 2, "0")))


def fx_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("view", "file_read", "click", "file_write", "purchase", "command", "error", "error", "signup", "user_prompt")))
    e = _events(spark, sf_dir).withColumn("fact_type", kinds[F.col("event_type")])
    k, is_file = F.col("k"), F.col("fact_type").isin("file_read", "file_write")
    path = F.concat(F.lit("/repo"), (F.col("user_id") % 5).cast("string"), F.lit("/src/mod"), (k % 10).cast("string"), F.lit("/file"), k.cast("string"), F.lit(".rs"))
    command = _choice(k % 5, COMMANDS)
    has_exit = F.col("fact_type").isin("command", "error")
    subject = F.when(is_file, path).when(has_exit, command)
    old = F.when((F.col("fact_type") == "file_write") & (k % 2 == 0), ',"old_string":"x"').otherwise("")
    detail = F.when(is_file, F.concat(F.lit('{"file_path":"'), path, F.lit('"'), old, F.lit("}"))).when(F.col("fact_type") == "command", command).when(F.col("fact_type") == "error", F.concat(F.lit("Process exited with code "), (k % 4).cast("string"))).otherwise(F.concat(F.lit("Please fix item "), k.cast("string")))
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.nullif(F.sum(F.when(F.col("fact_type") == "user_prompt", 1).otherwise(0)).over(w), F.lit(0))
    return e.select(
        F.col("event_id").alias("id"), "session_id", "ts", turn.cast("int").alias("turn_number"), "fact_type", subject.alias("subject"), detail.alias("detail"),
        F.when(has_exit, k % 4).alias("exit_code"), F.when(has_exit, k % 4 == 0).alias("success"),
    )


def fx_sessions(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Sessions by user and day. Ids keep four digits of the user, so that from user 10,000 on several sessions have one id; ``user_id`` tells them apart."""
    e = _events(spark, sf_dir)
    k, cents = F.col("k"), F.round(F.col("value") * 100).cast("bigint")
    prompts = F.count_if(F.col("event_type") == "signup")
    s = e.groupBy("session_id", "user_id", "dd").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("n"), F.sum(cents).alias("total_input_tokens"), F.sum(10 * k).alias("total_output_tokens"),
        F.sum(100 * k).alias("cache_read_tokens"), F.sum(7 * k).alias("cache_creation_tokens"), F.sum(k % 3).cast("bigint").alias("reasoning_tokens"), F.max(cents + 107 * k).alias("peak_context"),
        (F.count("*") - prompts).alias("total_tools"), prompts.alias("total_turns"),
    )
    user, dd = F.col("user_id"), F.col("dd")
    parent = F.when((dd % 5 != 0) & (dd > 5), F.concat(F.lit("u"), F.lpad(user.cast("string"), 4, "0"), F.lit("d"), F.lpad((dd - dd % 5).cast("string"), 2, "0")))
    s = s.withColumn("parent_id", parent)
    parents = s.select(F.col("parent_id").alias("p")).filter("p IS NOT NULL").distinct()
    s = s.join(parents, s["session_id"] == F.col("p"), "left")
    kind = F.when(F.col("parent_id").isNotNull(), "subagent").when(F.col("p").isNotNull(), "coordinator").otherwise("standalone")
    return s.select(
        F.col("session_id").alias("id"), _choice(user % 3, ENGINES).alias("engine"), _choice(user % 5, MODELS).alias("model"),
        F.concat(F.lit("/work/team"), (user % 4).cast("string"), F.lit("/Proj"), (user % 5).cast("string")).alias("cwd"), "started_at", F.when(F.col("n") % 7 != 0, F.col("last_event_at")).alias("ended_at"), "last_event_at", "parent_id", kind.alias("session_type"),
        "total_input_tokens", F.col("total_output_tokens").cast("bigint"), F.col("cache_read_tokens").cast("bigint"), F.col("cache_creation_tokens").cast("bigint"), "reasoning_tokens", F.col("peak_context").cast("bigint"), "total_tools", "total_turns",
        F.lit(None).cast("string").alias("subagent_type"), F.lit(None).cast("string").alias("root_summary"), *more,
    )


def fx_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("k % 4 = 0").select("session_id", F.concat(F.lit("t"), (F.col("k") % 6).cast("string")).alias("tag")).distinct()


def fx_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(labels, "doc_id", "left").withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return d.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("session_id"), F.array_join(F.slice("w", 1, 8), " ").alias("headline"), F.array("source", "lang").alias("projects"), F.slice("w", 9, 6).alias("keywords"),
        (2 * F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0))).cast("int").alias("substance"), F.floor(F.col("n_chars") / 50).cast("bigint").alias("duration_minutes"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("started_on"),
    )


def fx_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; repeated rows of one turn are kept apart by their order."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_prompt").when(F.col("role") == "assistant", "assistant_reply").otherwise("info")
    return t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("ord"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
