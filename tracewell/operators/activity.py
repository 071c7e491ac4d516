"""Rolling activity: latest actions, counts in windows, token rates, activity sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fact type -> name of the action.
ACTIONS = {"file_read": "Read", "file_write": "Write", "command": "Bash", "task_spawn": "Task", "git_op": "Git"}


def action(fact_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in ACTIONS.items() for x in (k, v)))[fact_type]


def latest_action(facts: DataFrame) -> DataFrame:
    f = facts.filter(F.col("fact_type").isin(*ACTIONS))
    newest = F.max_by(F.struct(action(F.col("fact_type")).alias("kind"), F.substring(F.coalesce("detail", "subject", F.lit("action")), 1, 120).alias("summary"), "ts"), F.struct("ts", "id"))
    return f.groupBy("session_id").agg(newest.alias("a")).select("session_id", "a.kind", "a.summary", "a.ts")


def actions_in_window(facts: DataFrame, anchor: datetime, minutes: int) -> DataFrame:
    """Actions per session from ``minutes`` before the anchor up to it, both included."""
    span = F.col("ts").between(F.lit(anchor - timedelta(minutes=minutes)), F.lit(anchor))
    return facts.filter(F.col("fact_type").isin(*ACTIONS) & span).groupBy("session_id").agg(F.count("*").alias("actions"))


def tokens_per_minute(usage: DataFrame, minutes: int) -> DataFrame:
    """Mean tokens a minute in tumbling windows, with one decimal; ``usage`` has ``session_id, ts, tokens``."""
    w = usage.groupBy("session_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum("tokens").alias("t"))
    return w.select("session_id", F.col("w.start").alias("window_start"), (F.round(F.col("t") / minutes * 10) / 10).alias("tokens_per_minute"))


def activity_sessions(facts: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Spans of activity of each key that pauses of at least ``gap`` end; works on streams too."""
    s = facts.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def is_stale(last_event: Column, as_of: datetime, minutes: int) -> Column:
    return F.coalesce(last_event < F.lit(as_of - timedelta(minutes=minutes)), F.lit(True))


def age_seconds(ts: Column, as_of: datetime) -> Column:
    return F.greatest(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts), F.lit(0))
