"""From ordered events to facts and session rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_trim

EXIT_PATTERN = r"(?md)^[^\S\n]*(?:Process exited with code |Exit code |exit code: )[^\S\n]*([+-]?\d+)(?=\s|$)"
# Git commands that make a fact of their own.
GIT_VERBS = ("commit", "push", "checkout", "rebase", "merge", "pull", "cherry-pick", "reset", "add")
# Tools whose failures make no error fact.
QUIET_TOOLS = ("read", "glob", "grep", "webfetch", "websearch", "write", "edit", "notebookedit")
SHELL_TOOLS = ("bash", "exec_command")


def exit_code(output: Column) -> Column:
    """The exit code that a tool's output states, as JSON metadata or in a line of its own."""
    stated = F.try_variant_get(F.try_parse_json(output), "$.metadata.exit_code", "int")
    return F.coalesce(stated, F.nullif(F.regexp_extract(output, EXIT_PATTERN, 1), F.lit("")).try_cast("int"))


def is_git_command(command: Column) -> Column:
    return F.coalesce(command.rlike(r"^\s*git (" + "|".join(GIT_VERBS) + ")"), F.lit(False))


def turn_ordinals(events: DataFrame, is_user: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``turn``: user messages count from 1, later events carry the count, null before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn", F.nullif(F.sum(F.when(is_user, 1).otherwise(0)).over(w), F.lit(0)))


def counted_usage(usage: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Usage records that count: the first of each key of a session, and all without a key."""
    w = Window.partitionBy("session_id", key).orderBy(*order)
    return usage.withColumn("__n", F.row_number().over(w)).filter(F.col(key).isNull() | (F.col("__n") == 1)).drop("__n")


def usage_sums(counted: DataFrame) -> DataFrame:
    sums = {"total_input_tokens": "input", "total_output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_creation", "reasoning_tokens": "reasoning"}
    peak = F.max(F.col("input") + F.col("cache_read") + F.col("cache_creation")).alias("peak_context")
    return counted.groupBy("session_id").agg(*(F.sum(v).alias(k) for k, v in sums.items()), peak)


def exit_backfill(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Shell calls (``session_id, call_id, ...``) with exit code and success of their last result (``ord, exit_code``)."""
    last = results.groupBy("session_id", "call_id").agg(F.max_by(F.struct("exit_code"), "ord").alias("r"))
    joined = calls.join(last, ["session_id", "call_id"], "left")
    return joined.select(*calls.columns, F.col("r.exit_code").alias("exit_code"), F.when(F.col("r").isNotNull(), F.coalesce(F.col("r.exit_code") == 0, F.lit(True))).alias("success"))


def error_facts(results: DataFrame) -> DataFrame:
    """Results that are errors: not of a quiet tool, and flagged or a shell command's non-zero exit; once per key.

    ``results``: ``session_id, ord, ts, call_id, tool, output, call_subject, call_detail, is_error, exit_code``.
    """
    tool = F.lower("tool")
    bad = F.coalesce("is_error", F.lit(False)) | (tool.isin(*SHELL_TOOLS) & F.coalesce(F.col("exit_code") != 0, F.lit(False)))
    key = F.coalesce(F.concat(F.lit("tool:"), "call_id"), F.concat(F.lit("ts:"), F.col("ts").cast("string"), F.lit("|exit:"), F.coalesce(F.col("exit_code").cast("string"), F.lit(""))))
    w = Window.partitionBy("session_id", "key").orderBy("ord")
    e = results.filter(bad & ~F.coalesce(tool.isin(*QUIET_TOOLS), F.lit(False))).withColumn("key", key).withColumn("n", F.row_number().over(w)).filter("n = 1")
    return e.select("session_id", "ord", "ts", F.lit("error").alias("fact_type"), F.col("call_subject").alias("subject"), F.coalesce(F.nullif("output", F.lit("")), "call_detail").alias("detail"), "exit_code", F.lit(False).alias("success"))


def git_facts(commands: DataFrame) -> DataFrame:
    """A git fact for each command that starts with one of the git verbs; ``sub_ord`` puts it before the command."""
    return commands.filter(is_git_command(F.col("detail"))).withColumns({"fact_type": F.lit("git_op"), "sub_ord": F.lit(-1)})


def session_bounds(events: DataFrame, order: list[str]) -> DataFrame:
    """First and last times in log order (not the smallest and largest)."""
    place = F.struct(*order)
    timed = events.filter("ts IS NOT NULL")
    return timed.groupBy("session_id").agg(F.min_by("ts", place).alias("started_at"), F.max_by("ts", place).alias("last_event_at"), F.count("*").alias("events"))


def first_text(blocks: Column) -> Column:
    """The first block that isn't blank, trimmed."""
    return F.get(F.filter(F.transform(blocks, lambda b: ws_trim(b)), lambda b: b != ""), F.lit(0))


def delta_merge(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Session rows of a tail merged into those there are: sums added, peak the largest, newer text, start kept. ``keys`` tell sessions apart."""
    sums = ["total_input_tokens", "total_output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "total_tools", "total_turns"]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys], "full")
    zero = F.lit(0).cast("bigint")
    columns = [*(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keys), F.coalesce("n.model", "o.model").alias("model"), F.coalesce("n.cwd", "o.cwd").alias("cwd"), F.coalesce("o.started_at", "n.started_at").alias("started_at"), F.coalesce("n.last_event_at", "o.last_event_at").alias("last_event_at")]
    columns += [(F.coalesce(f"o.{c}", zero) + F.coalesce(f"n.{c}", zero)).alias(c) for c in sums]
    return both.select(*columns, F.greatest("o.peak_context", "n.peak_context").alias("peak_context"))


def ingest_plan(found: DataFrame, sessions: DataFrame, *, force: bool = False, largest_peak: int = 10_000_000, more: tuple[str, ...] = ()) -> DataFrame:
    """What to do with each log (``id, size, has_tool_blocks, bad_errors``): skip, tail or full.

    ``sessions`` has ``id, last_indexed_offset, peak_context, total_tools``; the columns ``more`` of both tell logs of one id apart.
    """
    s = sessions.select("id", *more, F.col("last_indexed_offset").alias("offset"), "peak_context", "total_tools")
    redo = F.lit(force) | (F.col("peak_context") > largest_peak) | ((F.col("total_tools") == 0) & F.col("has_tool_blocks")) | F.col("bad_errors")
    action = F.when(F.col("offset").isNull(), "full").when(redo, "full").when(F.col("size") == F.col("offset"), "skip").when(F.col("size") > F.col("offset"), "tail").otherwise("full")
    return found.join(s, ["id", *more], "left").select("id", "size", action.alias("action"))


def doubtful_sessions(facts: DataFrame) -> DataFrame:
    """Sessions with error facts whose exit code is 0: their logs are read again."""
    return facts.filter((F.col("fact_type") == "error") & (F.col("exit_code") == 0)).select("session_id").distinct()
