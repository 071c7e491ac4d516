"""Drill-down into sessions: files, commands, errors, git, tokens, children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from .listing import cost, first_prompts

# Keys of a tool's input that show an edit, and those that name its path.
EDIT_KEYS = ("old_string", "replace_all", "oldText", "newText")
PATH_KEYS = ("file_path", "path", "target_file", "filepath")


def _place() -> Column:
    return F.struct("ts", "id")


def files(facts: DataFrame) -> DataFrame:
    """Each session's distinct files per action (read, written, edited), with their first-seen order."""
    f = facts.filter(F.col("fact_type").isin("file_read", "file_write"))
    keys = F.json_object_keys("detail")
    edited = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, EDIT_KEYS))), F.lit(False))
    action = F.when(F.col("fact_type") == "file_read", "read").when(edited, "edited").otherwise("written")
    path = F.coalesce(F.nullif(ws_trim(F.col("subject")), F.lit("")), *(F.get_json_object("detail", f"$.{k}") for k in PATH_KEYS))
    seen = f.select("session_id", "ts", "id", action.alias("action"), path.alias("path")).filter("path IS NOT NULL").groupBy("session_id", "action", "path").agg(F.min(_place()).alias("first"))
    w = Window.partitionBy("session_id", "action").orderBy("first")
    return seen.withColumn("nth", F.row_number().over(w)).select("session_id", "action", "nth", "path")


def commands(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("fact_type") == "command").select("session_id", "id", F.coalesce("detail", "subject").alias("command"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"))


def wrapped_command(detail: Column) -> Column:
    """The command in an error text that starts with a wrapping shell, without its quotes; else null."""
    raw = ws_trim(F.regexp_extract(detail, r"^\s*Command: /bin/bash -lc ([^\n]*)", 1))
    single, double = F.regexp_extract(raw, r"^'(.*)'$", 1), F.regexp_extract(raw, r'^"(.*)"$', 1)
    bare = F.when(raw.rlike(r"^'.*'$"), single).when(raw.rlike(r'^".*"$'), F.replace(double, F.lit('\\"'), F.lit('"'))).otherwise(raw)
    return F.when(detail.rlike(r"^[^\S\n]*Command: /bin/bash -lc "), bare)


def errors(facts: DataFrame, snippet: int = 280) -> DataFrame:
    """Error facts and failed commands, once per session, text and exit code.

    An error fact replaces an earlier entry of its key, a failed command only fills a gap; the entry
    keeps the place where its key was first seen.
    """
    failed = (F.col("fact_type") == "command") & F.coalesce(F.col("exit_code") != 0, F.lit(False))
    f = facts.filter((F.col("fact_type") == "error") | failed)
    is_error = F.col("fact_type") == "error"
    key = F.coalesce(F.nullif(ws_trim(F.col("subject")), F.lit("")), F.when(is_error, wrapped_command(F.col("detail"))), "detail", F.lit(""))
    # What is shown is an error's text, or a command as it was given.
    shown = F.coalesce("detail", F.when(~is_error, F.col("subject")), F.lit(""))
    f = f.select("session_id", "ts", "id", "fact_type", shown.alias("detail"), key.alias("key"), F.coalesce("exit_code", F.lit(1)).alias("code"), is_error.alias("is_error"))
    best = F.when(F.col("is_error"), F.struct(F.lit(1).alias("p"), F.unix_micros("ts").alias("t"), F.col("id").alias("i"))).otherwise(F.struct(F.lit(0).alias("p"), (-F.unix_micros("ts")).alias("t"), (-F.col("id")).alias("i")))
    merged = f.groupBy("session_id", "key", "code").agg(F.min(_place()).alias("first"), F.max_by("detail", best).alias("detail"), F.max_by("fact_type", best).alias("source"))
    w = Window.partitionBy("session_id").orderBy("first", "key")
    return merged.select("session_id", F.row_number().over(w).alias("nth"), "key", F.col("code").alias("exit_code"), F.substring("detail", 1, snippet).alias("snippet"), "source")


def git_operations(facts: DataFrame) -> DataFrame:
    f = facts.filter(F.col("fact_type") == "git_op")
    text = F.coalesce("detail", "subject")
    return f.select("session_id", "id", F.get(F.split(F.trim(text), r"\s+"), F.lit(1)).alias("operation"), text.alias("message"))


def counts_card(facts: DataFrame, git: DataFrame) -> DataFrame:
    """Files, commands, errors and git operations of each session with any of them, in one aggregation."""
    one = lambda df, what: df.select("session_id", what.alias("what"))
    rows = one(files(facts), F.col("action")).unionByName(one(commands(facts), F.lit("commands"))).unionByName(one(errors(facts), F.lit("errors"))).unionByName(one(git, F.lit("git")))
    names = {"read": "files_read", "written": "files_written", "edited": "files_edited", "commands": "commands", "errors": "errors", "git": "git"}
    return rows.groupBy("session_id").agg(*(F.count_if(F.col("what") == k).alias(v) for k, v in names.items()))


def token_breakdown(sessions: DataFrame) -> DataFrame:
    per_turn = lambda c: F.when(F.col("total_turns") == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col(c) / F.col("total_turns")))
    return sessions.select(
        "id", "total_input_tokens", "total_output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "peak_context", cost().alias("cost"),
        per_turn("total_input_tokens").alias("input_per_turn"), per_turn("total_output_tokens").alias("output_per_turn"),
    )


def children(sessions: DataFrame, *, show_empty: bool = False) -> DataFrame:
    """Children with tokens and duration; those without turns, or without tokens and tools, are hidden."""
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    c = sessions.filter("parent_id IS NOT NULL").withColumn("tokens", tokens)
    if not show_empty:
        c = c.filter((F.col("total_turns") > 0) & ((F.col("tokens") > 0) | (F.col("total_tools") > 0)))
    secs = F.greatest(F.unix_timestamp(F.coalesce("ended_at", "last_event_at")) - F.unix_timestamp("started_at"), F.lit(0))
    return c.select("parent_id", "id", "tokens", secs.alias("duration_secs"), "total_tools", "total_turns")


def children_rollup(sessions: DataFrame) -> DataFrame:
    return children(sessions).groupBy("parent_id").agg(F.count("*").alias("children"), F.sum("tokens").alias("tokens"), F.max("duration_secs").alias("longest_secs"), F.sum("total_tools").alias("tools"))


def child_activity(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files read and written and commands of the children of each parent, distinct, in order."""
    kids = sessions.filter("parent_id IS NOT NULL").select(F.col("id").alias("session_id"), "parent_id")
    f = facts.join(kids, "session_id").filter(F.col("fact_type").isin("file_read", "file_write", "command"))
    ordered = lambda kind: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("fact_type") == kind, F.struct("ts", "id", "subject")))), lambda x: x["subject"])), ",")
    return f.groupBy("parent_id", "session_id").agg(ordered("file_read").alias("files_read"), ordered("file_write").alias("files_written"), F.count_if(F.col("fact_type") == "command").alias("commands"))


def trace(facts: DataFrame, session_ids: DataFrame, fact_type: str | None = None) -> DataFrame:
    """All facts of some sessions (``id``), in order of time."""
    f = facts.join(session_ids.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")
    return (f if fact_type is None else f.filter(F.col("fact_type") == fact_type)).orderBy("session_id", "ts", "id")


def cache_tokens(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """``id, cache_read_tokens, cache_creation_tokens``; where both are 0, the sums of the log's counted usage records."""
    sums = usage.groupBy(F.col("session_id").alias("id")).agg(F.sum("cache_read").alias("r"), F.sum("cache_creation").alias("c"))
    unknown = (F.col("cache_read_tokens") == 0) & (F.col("cache_creation_tokens") == 0)
    stored = lambda c, again: F.when(unknown, F.coalesce(again, F.lit(0))).otherwise(F.col(c)).cast("bigint").alias(c)
    return sessions.join(sums, "id", "left").select("id", stored("cache_read_tokens", F.col("r")), stored("cache_creation_tokens", F.col("c")))


def tasks(sessions: DataFrame, facts: DataFrame, handoffs: DataFrame, descriptions: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``id, task``: the summary's headline, a child's description by its parent, the log's summary, the first prompt.

    Descriptions and prompts are cut to 60 characters, prompts are trimmed and those that are blank passed over.
    The columns ``more`` of sessions, summaries and descriptions tell sessions of one id apart.
    """
    prompts = first_prompts(facts.filter(ws_trim(F.col("detail")) != "")).select(F.col("session_id").alias("id"), F.substring(ws_trim(F.col("first_prompt")), 1, 60).alias("prompt"))
    h, d = handoffs.select(F.col("session_id").alias("id"), *more, "headline"), descriptions.select(F.col("session_id").alias("id"), *more, F.substring(F.trim("description"), 1, 60).alias("description"))
    df = sessions.select("id", *more, "session_type", "root_summary").join(h, ["id", *more], "left").join(d, ["id", *more], "left").join(prompts, "id", "left")
    child = F.when(F.col("session_type") == "subagent", F.nullif("description", F.lit("")))
    return df.select("id", F.coalesce("headline", child, "root_summary", "prompt").alias("task"))


def of_tag(sessions: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """All sessions of a tag, the newest first."""
    ids = tags.filter(F.col("tag") == tag).select(F.col("session_id").alias("id"))
    return sessions.join(ids, "id", "left_semi").orderBy(F.col("started_at").desc_nulls_last(), "id")
